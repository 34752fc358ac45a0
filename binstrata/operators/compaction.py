"""Partition-local compaction of small files.

A table is a registry of files and the records in them. Each version of its compaction names, for every
partition rewritten so far, one folder of packed files, and the files that went into them. A run counts the
files of each partition, packed ones and those not yet consumed, takes the partitions that hold too many
small ones, and rewrites these and no others: it reads their files, and their last pack if that is still
below good size, and writes the partition's folder by dynamic partition overwrite.

A partition has two folders by turns, so an overwrite replaces the pack before the last one, while readers
of the version before keep theirs. A full pack is sealed, and the partition goes on with the next pair. The
commit publishes packs and consumed files together, by one exclusive pointer; before it the registry is read
again, and partitions of which a consumed file is gone or was written anew are left out. A claim of the next
version keeps a second writer out before it can overwrite anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from binstrata.session import few_listing_tasks, observed
from binstrata.sources.store import VersionedStore

PACKS = "__part string, __slot int, files bigint, bytes bigint"
#: Measured bytes of names up to which the files of a run are broadcast.
BROADCAST_NAMES = 32 << 20
#: Folders of packs up to which the driver holds their listing at once.
LISTED_FOLDERS = 50_000


class KeyedRecords:
    """Records that carry the name of their file in a column of one large table, which a compaction scans once."""

    at_once = None

    def __init__(self, rows: DataFrame, file: str = "key"):
        self.rows, self.file, self.columns = rows, file, rows.columns

    def of(self, names: DataFrame) -> DataFrame:
        """The records of the files ``__file`` of ``names``, with its other columns."""
        return self.rows.join(names, self.rows[self.file] == F.col("__file")).drop("__file")


class PathRecords:
    """Records in Parquet files of their own: a file's name is its path below ``root``. Only the files asked
    for are opened. Their names are listed on the driver, as Spark does for any scan; a compaction reads and
    packs about ``at_once`` of them, those of whole partitions, one lot after the other until all are packed.
    Adds the file's name as the column ``file``."""

    def __init__(self, spark: SparkSession, root: str, schema, file: str = "key", at_once: int = 1_000_000):
        self.spark, self.root, self.file, self.at_once = spark, root.rstrip("/"), file, at_once
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = [*[c for c in self.schema.names if c != file], file]

    def of(self, names: DataFrame) -> DataFrame:
        paths = [f"{self.root}/{r[0]}" for r in names.select("__file").distinct().toLocalIterator()]
        if not paths:
            df = self.spark.createDataFrame([], self.schema).withColumn(self.file, F.lit(None).cast("string"))
        else:
            at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            df = self.spark.read.schema(self.schema).parquet(*paths)
            path = self.root.split(":", 1)[-1].lstrip("/")
            df = df.withColumn(self.file, F.substring_index(at, f"{path}/", -1))
        return df.select(*self.columns).join(names, F.col(self.file) == F.col("__file")).drop("__file")


class Compactor:
    """Finds and rewrites partitions that hold too many small files.

    ``by``: the partition columns of the registry; ``file``: the column that names a file, in the
    registry and in the records; ``size``: the bytes of a file, null where unknown (such a file counts
    as neither small nor large, and as one of mean size); ``identity``: the column that identifies a record.
    ``good_bytes``: files of this size are left as they are, and packs are cut to it. A run takes all
    partitions found; only where ``files_per_run`` is given, it takes a share of about so many files, whole
    partitions, and the next runs take the rest.

    Nulls in partition columns form partitions of their own. An empty registry gives no partition.
    Registry rows are expected once per file (see ``live_rows``), and a file is known by all of its
    row's values: registered anew with another size or time, it is another file. Records may be repeated:
    rows alike in all columns come out once. Extra columns of registry and records are kept.
    """

    def __init__(self, store: VersionedStore, by: tuple[str, ...], file: str = "key", size: str = "n_bytes", identity: str = "rec_id", small_bytes: int = 65_536, least_small: int = 10, good_bytes: int = 128 << 20, files_per_run: int | None = None):
        self.store, self.by, self.file, self.size, self.identity = store, by, file, size, identity
        self.small_bytes, self.least_small, self.good_bytes, self.files_per_run = small_bytes, least_small, good_bytes, files_per_run
        self.spark, self.data = store.spark, f"{store.root}/packed"

    # -- what a version holds

    def _named(self, files: DataFrame) -> DataFrame:
        """Registry rows as ``(*by, __file, __size, __stamp, __part)``: ``__stamp`` tells registrations apart."""
        part = F.md5(F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(self.by)])))
        stamp = F.xxhash64(*[F.col(c) for c in sorted(files.columns)])
        return files.select(*self.by, F.col(self.file).alias("__file"), F.col(self.size).cast("long").alias("__size"), stamp.alias("__stamp"), part.alias("__part"))

    def _table(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def consumed(self, version: int | None = None) -> DataFrame:
        """``(__file, __stamp)``: the files whose records are in packs, and which readers of this and later
        versions need no more."""
        return self._table(self.store.meta(version).get("consumed", []), "__file string, __stamp bigint")

    def packs(self, version: int | None = None) -> DataFrame:
        """``(__part, __slot, files, bytes)``: the folders of packed files that a version names."""
        meta = self.store.meta(version)
        return self._table([meta["packs"]] if meta else [], PACKS)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The partitions that the run of a version rewrote (``conflict`` = false) or had to leave."""
        return self.spark.read.parquet(self.store.meta(version)["manifest"])

    def partitions(self, files: DataFrame) -> DataFrame:
        """Each partition as it is now, with ``files``, ``small_files`` and known ``bytes``: files not yet
        consumed and packed ones."""
        plain = self._unconsumed(self._named(files)).select("__part", F.struct(*self.by).alias("__by"), F.lit(1).alias("n"), (F.col("__size") < self.small_bytes).cast("int").alias("s"), F.col("__size").alias("b"))
        names = self._named(files).select("__part", F.struct(*self.by).alias("__by")).distinct()
        packed = self.packs().join(names, "__part").select("__part", "__by", F.col("files").alias("n"), F.when(F.col("bytes") < self.small_bytes, F.col("files")).otherwise(0).alias("s"), F.col("bytes").alias("b"))
        rows = plain.unionByName(packed) if self.store.latest() else plain
        total = rows.groupBy("__part", "__by").agg(F.sum("n").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("small_files"), F.sum("b").alias("bytes"))
        return total.select("__part", "__by.*", "files", "small_files", "bytes")

    def _unconsumed(self, named: DataFrame) -> DataFrame:
        if not self.store.latest():
            return named
        done = self.consumed().select(F.col("__file").alias("__d"), F.col("__stamp").alias("__e"))
        return named.join(done, (F.col("__file") == F.col("__d")) & (F.col("__stamp") == F.col("__e")), "left_anti")

    def find(self, files: DataFrame) -> DataFrame:
        """The partitions that exceed the small-file count."""
        return self.partitions(files).where(F.col("small_files") >= self.least_small).drop("__part")

    # -- rewriting

    def _plan(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(targets, members)``: the partitions of this run with the folder to write, and their files."""
        seen = Observation()
        found = self.partitions(files).where(F.col("small_files") >= self.least_small)
        found = self._written(found.observe(seen, F.coalesce(F.sum("files"), F.lit(0)).alias("n")), "found")
        shares = -(-observed(seen, "n") // self.files_per_run) if self.files_per_run else 1
        if shares > 1:
            share = F.pmod(F.xxhash64("__part"), F.lit(shares))
            found = found.where(share == (found.select(F.min(share)).first()[0]))
        last = self.packs().groupBy("__part").agg(F.max(F.struct("__slot", "bytes")).alias("l"))
        last = last.select(F.col("__part").alias("__q"), F.col("l.__slot").alias("last"), (F.col("l.bytes") < self.good_bytes).alias("open"), F.col("l.bytes").alias("had"))
        targets = found.join(last, F.col("__part") == F.col("__q"), "left").drop("__q")
        pair = F.floor(F.coalesce("last", F.lit(-2)) / 2).cast("int")
        slot = F.when(F.col("open"), F.col("last").bitwiseXOR(1)).otherwise((pair + 1) * 2)
        targets = targets.withColumn("__slot", slot.cast("int")).withColumn("__old", F.when(F.col("open"), F.col("last")).cast("int"))
        # a file of good size stays where it is
        mine = self._unconsumed(self._named(files)).where(F.coalesce(F.col("__size") < self.good_bytes, F.lit(True)))
        keys = targets.select(F.col("__part").alias("__q"), "__slot", "had", "open")
        members = self._written(mine.join(keys, F.col("__part") == F.col("__q")).select("__part", "__slot", "__file", "__stamp", "__size", F.when(F.col("open"), F.col("had")).alias("had")), "members")
        mean = members.agg(F.avg("__size")).first()[0] or 0.0
        sized = members.groupBy("__part").agg(((F.sum(F.coalesce("__size", F.lit(mean))) + F.coalesce(F.max("had"), F.lit(0))) / self.good_bytes).alias("x")).select(F.col("__part").alias("__q"), F.greatest(F.lit(1), F.ceil("x")).cast("int").alias("__bins"))
        return self._written(targets.join(sized, F.col("__part") == F.col("__q"), "left").withColumn("__bins", F.coalesce("__bins", F.lit(1))).drop("__q"), "targets"), members

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        self._paths.append(self.store.write(df, name))
        return self.spark.read.schema(df.schema).parquet(self._paths[-1])

    def _packed(self, schema, packs: DataFrame) -> DataFrame:
        """The records in the folders ``(__part, __slot)`` of ``packs``, with its other columns."""
        rows = self.spark.read.schema(schema).parquet(self.data)
        folders = packs.withColumnsRenamed({"__part": "__pp", "__slot": "__ps"})
        return rows.join(folders, (F.col("__part") == F.col("__pp")) & (F.col("__slot") == F.col("__ps"))).drop("__pp", "__ps")

    def _stale(self, files: DataFrame, version: int | None = None) -> DataFrame:
        """Consumed files that are registered no more, or were since written anew."""
        now = self._named(files).select(F.col("__file").alias("__n"), F.col("__stamp").alias("__m"))
        gone = self.consumed(version).join(now, (F.col("__file") == F.col("__n")) & (F.col("__stamp") == F.col("__m")), "left_anti")
        return gone.select(F.col("__file").alias("__gone"), F.col("__stamp").alias("__gs"))

    def _live(self, packed: DataFrame, files: DataFrame, version: int | None = None) -> DataFrame:
        return packed.join(self._stale(files, version), (F.col(self.file) == F.col("__gone")) & (F.col("__stamp") == F.col("__gs")), "left_anti")

    def _schema(self, records) -> str:
        types = dict(records.rows.dtypes) if isinstance(records, KeyedRecords) else {**{f.name: f.dataType.simpleString() for f in records.schema}, self.file: "string"}
        return ", ".join([*(f"`{c}` {types[c]}" for c in records.columns), "`__stamp` bigint", "`__part` string", "`__slot` int"])

    def compact(self, files: DataFrame, records, current: Callable[[], DataFrame] | None = None, lease_s: int = 6 * 3600) -> int:
        """Rewrite the found partitions and commit; returns the new version.

        ``records``: a DataFrame with the column ``file``, :class:`KeyedRecords` or :class:`PathRecords`.
        ``current`` gives the registry as it is at commit time (default: ``files``). Raises
        ``CommitConflict`` if another compaction committed or is at work; the claim of one that died is
        taken over ``lease_s`` seconds after it was made, which must be longer than any run takes.
        """
        records = KeyedRecords(records, self.file) if isinstance(records, DataFrame) else records
        base = self.store.latest()
        claim = self.store.claim(base, lease_s)
        self._paths: list[str] = []
        try:
            targets, members = self._plan(files)
            self._rewrite(files, records, targets, members, base)
            return self._commit(targets, members, (current or (lambda: files))(), base)
        finally:
            self.store.release(claim)

    def _rewrite(self, files: DataFrame, records, targets: DataFrame, members: DataFrame, base: int) -> None:
        n, size = members.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("__file") + 100), F.lit(0))).first()
        lots = max(1, -(-n // records.at_once)) if records.at_once else 1
        for k in range(lots):
            # another hash than that of the shares of a run
            mine = F.pmod(F.xxhash64("__part", F.lit("lot")), F.lit(lots)) == k if lots > 1 else F.lit(True)
            self._rewrite_lot(files, records, targets.where(mine), members.where(mine), size, base)

    def _rewrite_lot(self, files: DataFrame, records, targets: DataFrame, members: DataFrame, size: int, base: int) -> None:
        bins = targets.select(F.col("__part").alias("__q"), "__bins")
        names = members.select("__part", "__slot", "__file", "__stamp").join(bins, F.col("__part") == F.col("__q")).drop("__q")
        rows = records.of(F.broadcast(names) if size <= BROADCAST_NAMES else names)
        old = targets.where(F.col("__old").isNotNull())
        if base and not old.isEmpty():
            again = self._packed(self._schema(records), old.select("__part", F.col("__old").alias("__slot"), F.col("__slot").alias("__new"), "__bins"))
            rows = rows.unionByName(self._live(again, files).drop("__slot").withColumnRenamed("__new", "__slot"))
        # copies are combined before the shuffle
        once = rows.distinct()
        (
            once.repartition("__part", F.pmod(F.xxhash64(self.identity), F.col("__bins")))
            .drop("__bins")
            .sortWithinPartitions("__part", "__slot", self.file)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("__part", "__slot")
            .parquet(self.data)
        )

    def _sizes(self, folders: int) -> DataFrame:
        """``(__part, __slot, files, bytes)`` of all folders, from the file listing: where there are very many
        ``folders``, that of one leading digit of ``__part`` (or several) after the other."""
        digits = 0
        while folders > LISTED_FOLDERS * 16**digits:
            digits += 1
        if not digits:
            return self._listed(self.data)
        paths = []
        for k in range(16**digits):
            try:
                self._written(self._listed(f"{self.data}/__part={k:0{digits}x}*"), "sizes")
                paths.append(self._paths[-1])
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return self._table(paths, PACKS)

    def _listed(self, path: str) -> DataFrame:
        with few_listing_tasks(self.spark):
            listing = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        at = lambda name, kind: F.regexp_extract("path", rf"{name}=([^/]+)/", 1).cast(kind)
        return listing.groupBy(at("__part", "string").alias("__part"), at("__slot", "int").alias("__slot")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))

    def _commit(self, targets: DataFrame, members: DataFrame, files: DataFrame, base: int) -> int:
        now = self._named(files).select(F.col("__file").alias("__n"), F.col("__stamp").alias("__m"))
        lost = members.join(now, (F.col("__file") == F.col("__n")) & (F.col("__stamp") == F.col("__m")), "left_anti").select(F.col("__part").alias("__q")).distinct().withColumn("conflict", F.lit(True))
        seen = Observation()
        manifest = targets.join(lost, F.col("__part") == F.col("__q"), "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
        manifest = self._written(manifest.select("__part", "__slot", *self.by, "files", "small_files", "bytes", "conflict").observe(seen, F.count(F.lit(1)).alias("n")), "manifest")
        mine, meta = self._paths[-1], self.store.meta(base)
        done = manifest.where(~F.col("conflict")).select(F.col("__part").alias("__q"), F.col("__slot").alias("__t"))
        kept = self.packs(base).join(done, (F.col("__part") == F.col("__q")) & (F.col("__slot").bitwiseXOR(1) == F.col("__t")), "left_anti")
        n = observed(seen, "n")
        new = self._sizes(n + 2 * self.packs(base).count()).join(done, (F.col("__part") == F.col("__q")) & (F.col("__slot") == F.col("__t")), "left_semi") if n else kept.where(F.lit(False))
        self._written(kept.unionByName(new), "packs")
        packs = self._paths[-1]
        self._written(members.join(done, F.col("__part") == F.col("__q"), "left_semi").select("__file", "__stamp"), "consumed")
        consumed = [*meta.get("consumed", []), self._paths[-1]]
        if len(consumed) > 20:  # few files here as well
            self._written(self._table(consumed, "__file string, __stamp bigint").coalesce(max(1, len(consumed) // 10)), "consumed")
            consumed = [self._paths[-1]]
        named = {"manifest": mine, "packs": packs, "consumed": consumed}
        version = self.store.commit(base, {**named, "paths": [mine, packs, *consumed]})
        for p in self._paths:
            if p not in (mine, packs, *consumed):
                self.store.discard(p)
        return version

    # -- reading

    def read(self, files: DataFrame, records, version: int | None = None) -> DataFrame:
        """All records as of a version, each once: those of consumed files from the packs, all others from
        their files. Adds the partition columns (as ``partition_x`` where the records have an ``x``) and
        ``rewritten``. A file registered since is read in place; of a consumed file that is registered no
        more, or anew, the packed records count no more. A version is readable until a partition that it
        names has been rewritten twice since."""
        records = KeyedRecords(records, self.file) if isinstance(records, DataFrame) else records
        named = self._named(files)
        names = {c: (f"partition_{c}" if c in records.columns else c) for c in self.by}
        cols = [*[F.col(c) for c in records.columns], *[F.col(f"__by.{c}").alias(names[c]) for c in self.by]]
        done = self.consumed(version).select(F.col("__file").alias("__d"), F.col("__stamp").alias("__e"))
        rest = named.join(done, (F.col("__file") == F.col("__d")) & (F.col("__stamp") == F.col("__e")), "left_anti")
        out = records.of(rest.select("__file", F.struct(*self.by).alias("__by"))).select(*cols).distinct().withColumn("rewritten", F.lit(False))
        meta = self.store.meta(version)
        if not meta or self.packs(version).isEmpty():
            return out
        homes = named.select(F.col("__part").alias("__h"), F.struct(*self.by).alias("__by")).distinct()
        folders = self.packs(version).select("__part", "__slot").join(homes, F.col("__part") == F.col("__h")).drop("__h")
        moved = self._live(self._packed(self._schema(records), folders), files, version)
        return moved.select(*cols).withColumn("rewritten", F.lit(True)).unionByName(out)


def month_of(c: str) -> Column:
    """``YYYY-MM`` of a timestamp in the session's zone (UTC)."""
    return F.date_format(F.col(c), "yyyy-MM")

"""Sources and sinks of shards: tiles read by period, a registry table, files beside the registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.operators.registry import SLOT, live_rows
from binstrata.sources.store import CommitConflict, VersionedStore


class Registry:
    """The shard registry as a versioned table: rows are appended, the newest of a slot counts."""

    SCHEMA = "pyramid string, tier string, shard_dur string, period_start bigint, period_end bigint, key string, written_at bigint, n_rows bigint"

    def __init__(self, store: VersionedStore):
        self.store = store

    def rows(self) -> DataFrame:
        """The live row of each slot."""
        paths = self.store.meta().get("paths", [])
        spark = self.store.spark
        df = spark.read.schema(self.SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], self.SCHEMA)
        return live_rows(df, SLOT)

    def record(self, rows: DataFrame, attempts: int = 5) -> int:
        """Append rows by one commit; of two writers at once one tries again on top of the other. Shards
        without rows are recorded like others (``n_rows`` 0): an empty shard is no gap."""
        path = self.store.write(rows.select(*[c.split()[0] for c in self.SCHEMA.split(", ")]), "registry")
        for k in range(attempts):
            base = self.store.latest()
            try:
                return self.store.commit(base, {"paths": [*self.store.meta(base).get("paths", []), path]})
            except CommitConflict:
                if k == attempts - 1:
                    raise
        raise AssertionError

    def drop(self, rows: DataFrame) -> int:
        """Take slots out of the registry, as they are in ``rows``: one registered anew since then stays."""
        base, cols = self.store.latest(), [*SLOT, "key", "written_at"]
        gone = rows.select(*[F.col(c).alias(f"__{c}") for c in cols])
        on = F.lit(True)
        for c in cols:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        path = self.store.write(self.rows().join(gone, on, "left_anti"), "registry")
        return self.store.commit(base, {"paths": [path]})

    def compact(self) -> int:
        """Replace the appended files by one with the live rows."""
        base = self.store.latest()
        path = self.store.write(self.rows(), "registry")
        return self.store.commit(base, {"paths": [path]})


def tiled_source(spark: SparkSession, root: str, tile: str, schema, lo: int, hi: int, parse: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, list[str]]:
    """Rows of the tiles, named by period, that cover ``[lo, hi)``, and the labels of those missing. All
    present tiles are read by one scan."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    labels = [lab for _, _, lab in ta.periods(lo, hi, tile)]
    paths = {lab: f"{root}/{lab}.parquet" for lab in labels}
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = {s.getPath().getName() for s in fs.listStatus(fs_path(root))} if fs.exists(fs_path(root)) else set()
    have = [p for lab, p in paths.items() if f"{lab}.parquet" in names]
    df = spark.read.schema(schema).parquet(*have) if have else spark.createDataFrame([], schema)
    return parse(df), [lab for lab in labels if f"{lab}.parquet" not in names]


def widest_present(rungs: Sequence[str], lo: int, hi: int, exists: Callable[[str, int], bool]) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """For each instant of ``[lo, hi)`` the largest rung that is present, as ``(shard, from, to)``, and the
    stretches where none is."""
    from binstrata.plans.cover import overlap_cover
    from binstrata.plans.spec import Tier

    picks, holes = overlap_cover(Tier("source", rungs[0], tuple(rungs)), lo, hi, exists)
    return [(s, a, b) for s, _, a, b in picks], holes


def content_key(template: str, rows: DataFrame, **values: str) -> str:
    """A key whose ``{hash}`` is the digest of the rows, the same for the same rows in any order, so that
    writing them again writes nothing new."""
    import hashlib

    from binstrata.functions.monoids import digest
    from binstrata.plans.spec import expand_key

    n, d = rows.agg(*digest(rows.columns)).first()
    return expand_key(template, hash=hashlib.md5(f"{n}:{d}".encode()).hexdigest(), **values)


def write_shard(df: DataFrame, path: str, sort: Sequence[str], files: int = 1, rows_per_group: int | None = None) -> None:
    """Write one shard sorted, so that row groups have narrow ranges; ``files`` parts it by range."""
    out = df.repartitionByRange(files, *sort) if files > 1 else df.coalesce(1)
    writer = out.sortWithinPartitions(*sort).write.mode("overwrite").option("compression", "snappy")
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    writer.parquet(path)


def write_tiles(df: DataFrame, root: str, label: str, sort: Sequence[str]) -> None:
    """Write one sorted tile for each value of the column ``label``, under the names that
    :func:`tiled_source` reads, by one job parted by it. Rows without a label have no tile."""
    spark, staged = df.sparkSession, f"{root}/_staged-{uuid.uuid4().hex}"
    df.where(F.col(label).isNotNull()).repartition(label).sortWithinPartitions(label, *sort).write.option("compression", "snappy").partitionBy(label).parquet(staged)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(fs_path(staged)):
        if s.isDirectory():
            tile = fs_path(f"{root}/{s.getPath().getName().split('=', 1)[1]}.parquet")
            fs.delete(tile, True)
            if not fs.rename(s.getPath(), tile):
                raise OSError(f"could not move {tile}")
    fs.delete(fs_path(staged), True)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """A table of one of the built-in formats (parquet, orc, csv, json) or of a JDBC source."""
    reader = spark.read.format(kind).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load() if kind == "jdbc" else reader.load(path)

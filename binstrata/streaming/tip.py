"""The live end of a pyramid: streams into the smallest rung, and watermarked bins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.plans.spec import PyramidSpec
from binstrata.session import Scratch
from binstrata.sources.store import VersionedStore


def dedupe(df: DataFrame, keys: Sequence[str], order: str, keep: str = "last") -> DataFrame:
    """One row for each key: the first or the last by ``order`` (ties: by all columns)."""
    cols = [F.col(c) for c in [order, *[c for c in df.columns if c != order]]]
    w = Window.partitionBy(*keys).orderBy(*[c.asc() if keep == "first" else c.desc() for c in cols])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def tip_writer(spec: PyramidSpec, root: str, identity: Sequence[str], order: str, keep: str = "last", invalidate: Callable[[int, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: merges each micro-batch into the open shards of the base tier's smallest
    rung and rewrites only these, by dynamic overwrite; then reports their range as invalid, so that
    coarser shards are built again. A batch that is delivered again changes nothing, as rows are told
    apart by ``identity``. The stream needs a checkpoint location."""
    tier, shard = spec.tiers[0], spec.tiers[0].shards[0]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("period", ta.label_col(ta.floor_col(spec.bin_col, shard), shard))
        touched = [r[0] for r in new.select("period").distinct().collect()]  # the open periods of one batch
        if not touched:
            return
        path = f"{root}/tier={tier.name}/shard={shard}"
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            old = spark.read.schema(new.schema).parquet(path).where(F.col("period").isin(touched))
            new = old.unionByName(new)
        # the old rows are read from the folder that is overwritten: they are set aside first
        merged = Scratch(spark, "tip").write(dedupe(new, identity, order, keep), "merged")
        merged.hint("rebalance", "period").sortWithinPartitions("period", spec.bin_col, *spec.dims).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)
        if invalidate:
            lo, hi = merged.agg(F.min(spec.bin_col), F.max(spec.bin_col)).first()
            invalidate(ta.floor(lo, shard), ta.add(ta.floor(hi, shard), shard))

    return write


def tumbling(stream: DataFrame, ts: str, width: str, late: str, dims: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Bins of a stream (or a table), closed when the watermark passes them; rows later than ``late`` are
    dropped by the stream."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(ts, width).alias("w"), *dims).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), *dims, *aggs)


def sliding(stream: DataFrame, ts: str, width: str, step: str, late: str, dims: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """As :func:`tumbling`, with windows that start every ``step``."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(ts, width, step).alias("w"), *dims).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), *dims, *aggs)


def sessions(stream: DataFrame, ts: str, gap: str, late: str, dims: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Sessions of each dims, ended by a pause of ``gap``."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *dims).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), *dims, *aggs)


class Journal:
    """Repair requests ``(pyramid, a, b, r)`` in a versioned store: appended, and rewritten when spent ones go."""

    SCHEMA = "pyramid string, a bigint, b bigint, r bigint"

    def __init__(self, store: VersionedStore):
        self.store = store

    def rows(self) -> DataFrame:
        return self.store.read(self.store.meta().get("paths", []), self.SCHEMA)

    def invalidate(self, pyramid: str, lo: int, hi: int, at: int) -> int:
        """Append one request for ``[lo, hi)``; returns the version."""
        base = self.store.latest()
        path = self.store.write(self.store.spark.createDataFrame([(pyramid, lo, hi, at)], self.SCHEMA).coalesce(1), "journal")
        return self.store.commit(base, {"paths": [*self.store.meta(base).get("paths", []), path]})

    def prune(self, gone: DataFrame) -> int:
        """Drop requests; those that came since the newest version was read make the commit fail, and stay."""
        base = self.store.latest()
        names = gone.select(*[F.col(c).alias(f"__{c}") for c in ("pyramid", "a", "b", "r")])
        on = F.lit(True)
        for c in ("pyramid", "a", "b", "r"):
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        path = self.store.write(self.rows().join(names, on, "left_anti").coalesce(1), "journal")
        return self.store.commit(base, {"paths": [path]})

"""Sweep line over time intervals: merged periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from binstrata.session import Scratch, observed


def periods_and_gaps(df: DataFrame, by: tuple[str, ...], start: str, end: str, block_rows: int = 1_000_000, scratch: Scratch | None = None) -> DataFrame:
    """``(*by, kind, lo, hi)``: each continuous ``period`` and each ``gap`` between two neighbours.

    ``start`` and ``end`` are whole numbers (such as epoch milliseconds), half-open. Rows with a null
    bound or ``end <= start`` are ignored. Touching intervals are continuous. Null groups are groups.

    Boundaries become plus and minus events, summed by instant before the shuffle, and the running
    sum of active intervals is taken in two steps, so that no group has to fit a task: the events are
    parted by range over group and instant into blocks of about ``block_rows``, by their quantiles, so that
    neither a large group nor one with most of its events at one time makes a large block; the sums of a
    group's blocks are accumulated, then each block is swept on its own from the count it starts with. Only
    block summaries are ordered per group.
    """
    by, scratch, seen = list(by), scratch or Scratch(df.sparkSession, "sweep"), Observation()
    valid = df.where(F.col(end) > F.col(start)).select(*by, F.col(start).cast("long").alias("__a"), F.col(end).cast("long").alias("__b"))
    events = (
        valid.select(*by, F.explode(F.array(F.struct(F.col("__a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("__b").alias("t"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy(*by, F.col("e.t").alias("t"))
        .agg(F.sum("e.d").alias("d"))
    )
    events = scratch.write(events.observe(seen, F.count(F.lit(1)).alias("n")), "events")
    blocks = -(-observed(seen, "n") // block_rows)
    if blocks > 1:  # written, so that every reader sees the same blocks
        cut = scratch.write(events.repartitionByRange(blocks, *by, "t").withColumn("block", F.spark_partition_id()), "blocks")
    else:
        cut = events.withColumn("block", F.lit(0))

    group = Window.partitionBy(*by).orderBy("block")
    before = cut.groupBy(*by, "block").agg(F.sum("d").alias("s"))
    before = before.select(*[F.col(c).alias(f"__h_{c}") for c in by], F.col("block").alias("__block"), (F.sum("s").over(group) - F.col("s")).alias("__before"))
    on = cut["block"] == F.col("__block")
    for c in by:
        on = on & cut[c].eqNullSafe(F.col(f"__h_{c}"))
    inside = Window.partitionBy(*by, "block").orderBy("t")
    swept = cut.join(before, on).select(*by, "block", "t", "d", (F.sum("d").over(inside) + F.col("__before")).alias("active"))
    bounds = swept.where((F.col("d") != 0) & ((F.col("active") == 0) | (F.col("active") == F.col("d"))))

    # the next boundary is the next of the block or else the first of the group's next block
    bounds = bounds.select(*by, "block", "t", (F.col("active") > 0).alias("opens"), F.lead("t").over(inside).alias("hi"))
    first = bounds.groupBy(*by, "block").agg(F.min("t").alias("t"))
    nxt = first.select(*[F.col(c).alias(f"__i_{c}") for c in by], F.col("block").alias("__block"), F.lead("t").over(group).alias("__next"))
    on = bounds["block"] == F.col("__block")
    for c in by:
        on = on & bounds[c].eqNullSafe(F.col(f"__i_{c}"))
    out = bounds.join(nxt, on).select(*by, F.when(F.col("opens"), "period").otherwise("gap").alias("kind"), F.col("t").alias("lo"), F.coalesce("hi", "__next").alias("hi"))
    return out.where(F.col("hi").isNotNull())

"""Fill mode: build what the expected cover lacks, tier by tier, and register it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.operators.build import EmptySourceError, SourceCoverageError, rebin, write_tier
from binstrata.operators.inventory import gaps, spent_requests, stale
from binstrata.plans.cover import expected_table, source_tier
from binstrata.plans.spec import PyramidSpec
from binstrata.session import broadcast_if_small, folder_exists
from binstrata.sources.shards import Registry


def classify_gaps(todo: DataFrame, spec: PyramidSpec, tiles: DataFrame, tile: str, lo: int, source_end: int, to: int, max_missing: float = 0.0) -> DataFrame:
    """Gaps ``(tier, shard_dur, period_start, period_end, ...)`` with ``status``, judged before anything is written.

    ``tiles``: the source's tiles that are present, by ``period_start``; ``tile`` is their duration, ``[lo,
    source_end)`` what the source covers, ``to`` the end of the range asked for. ``unfillable``: the gap reaches
    beyond the source, or its tier's bins are no whole tiles' parts; ``deferred``: a tile it needs is absent and
    still open (ends after ``to``), so a later run builds it; ``held``: a tile it needs is absent and closed;
    else ``fillable``. Absent closed tiles beyond the share ``max_missing`` of those needed raise
    :class:`SourceCoverageError`; a share within it lets the held gaps be built over the holes: they are
    ``fillable``.
    """
    spark = todo.sparkSession
    # the tiles of a range are planned on the driver, like its shards
    spans = spark.createDataFrame([(a, b) for a, b, _ in ta.periods(lo, source_end, tile)], "t0 bigint, t1 bigint")
    there = tiles.select(F.col("period_start").alias("__t")).distinct()
    marked = spans.join(there, F.col("t0") == F.col("__t"), "left").select("t0", "t1", F.col("__t").isNull().alias("absent"))
    key = ["tier", "shard_dur", "period_start"]
    at = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / ta.DAY), F.floor((F.col(b) - 1) / ta.DAY)))
    need = todo.select(*key, "period_end").withColumn("__c", at("period_start", "period_end"))
    have = marked.withColumn("__d", at("t0", "t1"))
    on = (F.col("__c") == F.col("__d")) & (F.col("period_start") < F.col("t1")) & (F.col("t0") < F.col("period_end"))
    read = need.join(have, on).select(*key, "t0", "t1", "absent").distinct()
    beyond = F.col("period_end") > source_end
    fits = [t.name for t in spec.tiers if ta.divides(t.bin, tile) or ta.divides(tile, t.bin)]
    hard = beyond | ~F.col("tier").isin(fits)
    flags = read.groupBy(*key).agg(F.max(F.col("absent") & (F.col("t1") > to)).alias("open"), F.max(F.col("absent") & (F.col("t1") <= to)).alias("closed"))
    out = todo.join(flags, key, "left")
    status = F.when(hard, "unfillable").when(F.col("open"), "deferred").when(F.col("closed"), "held").otherwise("fillable")
    out = out.withColumn("status", status)
    used = read.join(out.where(F.col("status").isin("held", "fillable")).select(*key), key, "left_semi").select("t0", "absent").distinct()
    n, gone = used.agg(F.count(F.lit(1)), F.count_if("absent")).first()
    if gone > max_missing * n:
        raise SourceCoverageError(f"{gone} of {n} source tiles are missing")
    return out.withColumn("status", F.when(F.col("status") == "held", "fillable").otherwise(F.col("status"))).drop("open", "closed")


def fill(base: DataFrame, spec: PyramidSpec, root: str, registry: Registry, lo: int, hi: int, now: int, requests: DataFrame | None = None, max_gaps: int | None = None, time_budget_s: float | None = None) -> DataFrame:
    """Build every expected shard of ``[lo, hi)`` that is not registered, or that a later repair request
    overlaps, and register it; returns the registry rows that were added.

    Sources come before what is built from them. All missing shards of a rung are built by one job: the
    source tier's rows are kept that lie in a gap (a semi join on the period they belong to), merged to
    the tier's bins, and written over exactly these partitions. A shard without rows is registered with
    ``n_rows`` 0 and is no gap any more. ``max_gaps`` and ``time_budget_s`` end a run after that many shards or before the next rung;
    the next run goes on where it stopped, as it starts from the registry. :func:`spent` tells which requests
    can be dropped then.
    """
    spark, began = base.sparkSession, time.monotonic()
    expected = expected_table(spark, spec, lo, hi)
    done = 0
    for tier in spec.tiers:
        for shard in tier.shards:
            if time_budget_s is not None and time.monotonic() - began > time_budget_s:
                break
            have = registry.rows().where(F.col("pyramid") == spec.name)
            if requests is not None:
                have = have.join(stale(have, requests.where(F.col("pyramid") == spec.name)).select("key"), "key", "left_anti")
            todo = gaps(expected.where((F.col("tier") == tier.name) & (F.col("shard_dur") == shard)), have)
            if max_gaps is not None:
                todo = todo.orderBy("period_start").limit(max(0, max_gaps - done))
            # fixed for this run: a later look at the registry would see it filled
            todo = spark.read.schema(todo.schema).parquet(registry.store.write(todo, "todo"))
            n = todo.count()
            if not n:
                continue
            done += n
            rows = _source(base, spec, root, tier.name)
            period = ta.floor_col(spec.bin_col, shard)
            wanted = broadcast_if_small(todo.select(F.col("period_start").alias("__p"), "effective_start", "effective_end"))
            inside = (period == F.col("__p")) & (F.col(spec.bin_col) >= F.col("effective_start")) & (F.col(spec.bin_col) < F.col("effective_end"))
            part = rebin(rows.join(wanted, inside).select(rows.columns), spec, tier.bin)
            write_tier(part, spec, tier.name, shard, root)
            path = f"{root}/tier={tier.name}/shard={shard}"
            fresh = todo.withColumn("__l", ta.label_col("period_start", shard))
            if folder_exists(spark, path):
                sizes = spark.read.schema(_with_period(base)).parquet(path).groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"))
                counts = fresh.join(sizes, F.col("__l") == F.col("period"), "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
            else:
                counts = fresh.select("*", F.lit(0).cast("long").alias("n_rows"))
            new = counts.select(F.lit(spec.name).alias("pyramid"), "tier", "shard_dur", "period_start", "period_end", "key", F.lit(now).cast("long").alias("written_at"), "n_rows")
            registry.record(new)
    return registry.rows().where((F.col("pyramid") == spec.name) & (F.col("written_at") == now))


def spent(requests: DataFrame, spec: PyramidSpec, registry: Registry, lo: int, hi: int) -> DataFrame:
    """Requests for a pyramid that no registered shard waits for any more and that lie within the range a fill
    has looked at: they can be dropped from the journal."""
    mine = requests.where((F.col("pyramid") == spec.name) & (F.col("a") >= lo) & (F.col("b") <= hi))
    return spent_requests(mine, registry.rows())


def _source(base: DataFrame, spec: PyramidSpec, root: str, tier: str) -> DataFrame:
    """Rows to build a tier from: what was written of its source tier, or the base rows."""
    src = source_tier(spec, tier)
    if src is None:
        return base
    out = written_tier(base.sparkSession, spec, root, src.name, base.schema)
    if out is None:
        raise EmptySourceError(f"nothing is written of tier {src.name}")
    return out


def written_tier(spark, spec: PyramidSpec, root: str, tier: str, schema) -> DataFrame | None:
    """The rows of every rung of a tier that was written, a bin once (the largest rung that has it), or None."""
    out = None
    for k, shard in enumerate(spec.tier(tier).shards):
        path = f"{root}/tier={tier}/shard={shard}"
        if folder_exists(spark, path):
            one = spark.read.schema(schema).parquet(path).withColumn("__rung", F.lit(k))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    keys = [spec.bin_col, *spec.dims]
    rest = [c for c in out.columns if c not in (*keys, "__rung")]
    # maps have no order, but max_by orders by the rung alone
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__rung").alias("__r")).select(*keys, "__r.*")


def _with_period(base: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*base.schema, T.StructField("period", T.StringType())])


def insert_statements(rows: DataFrame, table: str = "pyramid_shards") -> DataFrame:
    """``(sql)``: one INSERT for each registry row, for registries kept in a database."""
    text = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.col(c).cast("string"), "'", "''"), F.lit("'"))
    value = {"string": text}
    cells = [F.coalesce(value.get(t, lambda c: F.col(c).cast("string"))(c), F.lit("NULL")) for c, t in rows.dtypes]
    head = f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES ("
    return rows.select(F.concat(F.lit(head), F.concat_ws(", ", *cells), F.lit(");")).alias("sql"))

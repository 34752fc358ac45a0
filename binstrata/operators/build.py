"""Building a pyramid: raw rows to the base tier, each tier to the next, shards to Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.functions.monoids import MONOIDS, explode_histogram, histogram_json
from binstrata.operators.registry import null_safe
from binstrata.plans.cover import build_order, source_tier
from binstrata.plans.spec import PyramidSpec


class EmptySourceError(RuntimeError):
    """There is nothing to build from."""


class SourceCoverageError(RuntimeError):
    """Too much of the source is missing."""


def _split(spec: PyramidSpec) -> tuple[list, list]:
    scalars = [m for m in spec.metrics if m.monoid != "histogram"]
    return scalars, [m for m in spec.metrics if m.monoid == "histogram"]


def _framed(spec: PyramidSpec) -> tuple[list, list]:
    """Metrics whose states are made by aggregates, and those whose are made from whole tables."""
    return tuple([m for m in spec.metrics if MONOIDS[m.monoid].framed == f] for f in (False, True))


def _join_states(parts: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        p = p.withColumnsRenamed({k: f"__r_{k}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & out[k].eqNullSafe(F.col(f"__r_{k}"))
        rest = [c for c in p.columns if not c.startswith("__r_")]
        mine = [c for c in out.columns if c not in keys]
        out = out.join(p, on, "full_outer").select(*[F.coalesce(out[k], F.col(f"__r_{k}")).alias(k) for k in keys], *mine, *rest)
    return out


def from_raw(raw: DataFrame, spec: PyramidSpec, ms: Column, values: Mapping[str, Column], bin_: str | None = None) -> DataFrame:
    """The base tier: ``(bin, *dims, *states)``. ``ms`` gives a row's instant in epoch milliseconds,
    ``values`` each metric's value (a histogram's category). Rows without an instant are left out."""
    keys = [spec.bin_col, *spec.dims]
    rows = raw.select(ta.floor_col(ms, bin_ or spec.tiers[0].bin).alias(spec.bin_col), *spec.dims, *[values[m.name].alias(f"__v_{m.name}") for m in spec.metrics]).where(F.col(spec.bin_col).isNotNull())
    scalars, framed = _framed(spec)
    parts = []
    if scalars or not framed:
        aggs = [a for m in scalars for a in MONOIDS[m.monoid].from_raw(m.name, F.col(f"__v_{m.name}"))]
        parts.append(rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct())
    parts += [MONOIDS[m.monoid].states(rows, keys, f"__v_{m.name}", m.name) for m in framed]
    return _join_states(parts, keys).select(*keys, *spec.state_columns)


def rebin(states: DataFrame, spec: PyramidSpec, bin_: str) -> DataFrame:
    """Merge states to coarser bins; also combines repeated ``(bin, dims)``. One shuffle for scalars;
    histograms travel as one row for each category."""
    keys = [spec.bin_col, *spec.dims]
    rows = states.withColumn(spec.bin_col, ta.floor_col(spec.bin_col, bin_))
    scalars, framed = _framed(spec)
    parts = []
    if scalars or not framed:
        aggs = [a for m in scalars for a in MONOIDS[m.monoid].merge(m.name)]
        parts.append(rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct())
    parts += [MONOIDS[m.monoid].merge_states(rows, keys, m.name) for m in framed]
    return _join_states(parts, keys).select(*keys, *spec.state_columns)


def cascade(base: DataFrame, spec: PyramidSpec) -> dict[str, DataFrame]:
    """Every tier, each from the coarsest finer tier whose bins divide its own."""
    tiers: dict[str, DataFrame] = {}
    for name, src in build_order(spec):
        tiers[name] = base if src is None and name == spec.tiers[0].name else rebin(tiers[src] if src else base, spec, spec.tier(name).bin)
    return tiers


def with_periods(tier_df: DataFrame, spec: PyramidSpec, shard: str) -> DataFrame:
    """Adds ``shard`` and ``period``: a rung only parts the rows of a tier differently."""
    return tier_df.withColumn("shard", F.lit(shard)).withColumn("period", ta.label_col(ta.floor_col(spec.bin_col, shard), shard))


def write_tier(tier_df: DataFrame, spec: PyramidSpec, tier: str, shard: str, root: str) -> None:
    """Write the shards of one rung, each a partition, replacing those that have rows here and no other.

    Rows are sorted by bin and dims within files, so that row groups can be pruned by range. Shards too
    large for a task are spread by AQE over several files.
    """
    rows = with_periods(tier_df, spec, shard).withColumn("tier", F.lit(tier))
    rows = rows.hint("rebalance", "period").sortWithinPartitions("period", spec.bin_col, *spec.dims)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier", "shard", "period").parquet(root)


def build(base: DataFrame, spec: PyramidSpec, root: str, lo: int, hi: int, skip: Sequence[tuple[str, str]] = (), min_rows: int = 0) -> DataFrame:
    """Build and write all rungs of all tiers over ``[lo, hi)``; returns the registry rows.

    Each tier is read back from what was written of its source, so no tier is computed twice. Only
    periods that have closed within the range are written (a rung's open period is left to smaller
    rungs). Raises :class:`EmptySourceError` before anything is written if the range has fewer than
    ``min_rows`` rows.
    """
    spark = base.sparkSession
    inside = (F.col(spec.bin_col) >= lo) & (F.col(spec.bin_col) < hi)
    base = base.where(inside)
    if min_rows and base.limit(min_rows).count() < min_rows:
        raise EmptySourceError(f"fewer than {min_rows} rows from {lo} to {hi}")
    records = []
    for tier in spec.tiers:
        src = source_tier(spec, tier.name)
        if src is None:
            df = base if tier is spec.tiers[0] else rebin(base, spec, tier.bin)
        else:
            finest = spark.read.schema(base.schema).parquet(f"{root}/tier={src.name}/shard={src.shards[0]}")
            df = rebin(finest.where(inside), spec, tier.bin)
        for shard in tier.shards:
            if (tier.name, shard) in skip:
                continue
            a, b = ta.floor(lo, shard), ta.floor(hi, shard)
            part = df.where((F.col(spec.bin_col) >= a) & (F.col(spec.bin_col) < b)) if shard != tier.shards[0] else df
            write_tier(part, spec, tier.name, shard, root)
            df = spark.read.schema(base.schema).parquet(f"{root}/tier={tier.name}/shard={tier.shards[0]}")
            records += [(spec.name, tier.name, shard, s, e) for s, e, _ in ta.periods(lo, hi, shard) if e <= hi or shard == tier.shards[0]]
    return spark.createDataFrame(records, "pyramid string, tier string, shard_dur string, period_start bigint, period_end bigint")


def check_coverage(spark_periods: DataFrame, present: DataFrame, keys: Sequence[str], max_missing: int = 0) -> DataFrame:
    """Source tiles that are expected and not present; more than ``max_missing`` raise an error."""
    gone = spark_periods.join(present.select(*keys).distinct(), list(keys), "left_anti")
    if gone.limit(max_missing + 1).count() > max_missing:
        raise SourceCoverageError(f"more than {max_missing} source tiles are missing")
    return gone


def to_long(wide: DataFrame, spec: PyramidSpec) -> DataFrame:
    """``(*dims, bin, metric, state, count)``: one row for each non-null scalar state and each category
    of a histogram. Scalars have a null ``state``."""
    keys = [*spec.dims, spec.bin_col]
    scalars, hists = _split(spec)
    out = []
    cols = [c for m in scalars for c in m.columns]
    if cols:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("count")) for c in cols])
        out.append(wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", F.lit(None).cast("string").alias("state"), "p.count").where(F.col("count").isNotNull()))
    for m in hists:
        rows = explode_histogram(wide, m.name, keys, "state", "count")
        out.append(rows.select(*keys, F.lit(m.name).alias("metric"), "state", F.col("count").cast("double").alias("count")))
    res = out[0]
    for more in out[1:]:
        res = res.unionByName(more)
    return res


def to_wide(long: DataFrame, spec: PyramidSpec, as_json: bool = False) -> DataFrame:
    """The inverse of :func:`to_long`, by one aggregation; metrics without rows are null columns."""
    keys = [*spec.dims, spec.bin_col]
    scalars, hists = _split(spec)
    sums = long.groupBy(*keys, "metric", "state").agg(F.sum("count").alias("count"))
    aggs = []
    for m in scalars:
        for c in m.columns:
            kind = "bigint" if c == m.name or c.endswith("_n") else "double"
            aggs.append(F.sum(F.when(F.col("metric") == c, F.col("count"))).cast(kind).alias(c))
    for m in hists:
        pair = F.when((F.col("metric") == m.name) & F.col("state").isNotNull(), F.struct(F.col("state").alias("key"), F.col("count").cast("bigint").alias("value")))
        h = F.map_from_entries(F.sort_array(F.collect_list(pair)))
        aggs.append((histogram_json(h) if as_json else h).alias(m.name))
    return sums.groupBy(*keys).agg(*aggs).select(spec.bin_col, *spec.dims, *spec.state_columns)


def identity_rollup(states: DataFrame, spec: PyramidSpec, column: str, mapping: DataFrame, prefix: str = "c:") -> DataFrame:
    """Add rows that sum the leaves of each canonical identity, named ``prefix`` + identity.

    ``mapping``: ``(raw, canonical)``, unique by ``raw``. Earlier rollup rows are dropped first, so the
    operation is idempotent; leaves stay as they are, also those the mapping does not name.
    """
    keys = [spec.bin_col, *spec.dims]
    leaves = states.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))
    m = mapping.select(F.col("raw").alias("__raw"), F.col("canonical").alias("__canon"))
    mapped = leaves.join(m, F.col(column) == F.col("__raw")).withColumn(column, F.concat(F.lit(prefix), F.col("__canon"))).drop("__raw", "__canon")
    rolled = rebin(mapped, spec, spec.tiers[0].bin)
    return leaves.select(*keys, *spec.state_columns).unionByName(rolled)


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, verdict)``: rows of only one side or of other values, null equal to null; empty if the
    tables are equal as sets of keyed rows. Maps are compared by their canonical text."""
    def plain(df: DataFrame) -> DataFrame:
        return df.select(*[histogram_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])

    x, y = plain(a), plain(b).withColumnsRenamed({c: f"__b_{c}" for c in b.columns})
    on = F.lit(True)
    for k in keys:
        on = on & x[k].eqNullSafe(F.col(f"__b_{k}"))
    x = x.withColumn("__in_a", F.lit(True))
    y = y.withColumn("__in_b", F.lit(True))
    both = x.join(y, on, "full_outer")
    rest = [c for c in a.columns if c not in keys]
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    verdict = F.when(F.col("__in_b").isNull(), "only_a").when(F.col("__in_a").isNull(), "only_b").when(~same, "different")
    return both.select(*[F.coalesce(F.col(k), F.col(f"__b_{k}")).alias(k) for k in keys], verdict.alias("verdict")).where(F.col("verdict").isNotNull())


__all__ = ["EmptySourceError", "SourceCoverageError", "build", "cascade", "check_coverage", "compare", "from_raw", "identity_rollup", "null_safe", "rebin", "to_long", "to_wide", "with_periods", "write_tier"]

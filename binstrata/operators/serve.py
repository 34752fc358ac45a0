"""Executing plans: filtered scans of the tiers, one aggregation, rolling smoothing, trim."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.functions.monoids import MONOIDS
from binstrata.operators.build import rebin
from binstrata.plans.planner import Plan, Smoothing, plan_query
from binstrata.plans.spec import PyramidSpec


def where_in(df: DataFrame, column: str, values: Sequence, limit: int = 1000) -> DataFrame:
    """Rows whose ``column`` is in ``values``: a pushed-down filter for few values, a semi join for many.
    An empty set gives no rows; null is in no set."""
    if len(values) <= limit:
        return df.where(F.col(column).isin(list(values))) if values else df.where(F.lit(False))
    other = df.sparkSession.createDataFrame([(v,) for v in set(values)], df.select(F.col(column).alias("__v")).schema)
    return df.join(other, F.col(column) == F.col("__v"), "left_semi")


def where_range(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    """Rows with ``lo <= column <= hi``; None leaves a side open."""
    out = df if lo is None else df.where(F.col(column) >= lo)
    return out if hi is None else out.where(F.col(column) <= hi)


def lexicographic(columns: Sequence[str], lo: Sequence | None, hi: Sequence | None) -> Column:
    """Rows of ``[lo, hi)`` by the columns in order, as disjunctions of plain comparisons that a scan can
    prune by; None leaves a side open."""
    def beyond(bound: Sequence, strict_less: bool) -> Column:
        out = F.lit(False)
        for k in range(len(bound)):
            same = F.lit(True)
            for c, v in zip(columns[:k], bound[:k]):
                same = same & (F.col(c) == F.lit(v))
            c, v = F.col(columns[k]), F.lit(bound[k])
            last = k == len(bound) - 1
            out = out | (same & ((c < v) if strict_less else ((c >= v) if last else (c > v))))
        return out

    cond = F.lit(True)
    if lo is not None:
        cond = cond & beyond(lo, False)
    return cond if hi is None else cond & beyond(hi, True)


def balanced_ranges(df: DataFrame, column: str, k: int, error: float = 0.001) -> list[tuple]:
    """``k`` ranges of about equal numbers of rows, as ``(lo, hi)`` with open ends, from approximate
    quantiles of the whole column."""
    cuts = sorted(set(df.approxQuantile(column, [i / k for i in range(1, k)], error))) if k > 1 else []
    edges = [None, *cuts, None]
    return list(zip(edges, edges[1:]))


def fetch(tiers: Mapping[str, DataFrame], spec: PyramidSpec, plan: Plan, filters: Sequence[Column] = ()) -> DataFrame:
    """The rows of a plan's segments: each tier is scanned once, with its ranges and the filters pushed
    down. A tier that does not exist gives no rows."""
    parts = []
    for name in dict.fromkeys(s.tier for s in plan.segments):
        cond = F.lit(False)
        if name not in tiers:
            continue
        df, rung = tiers[name], spec.tier(name).shards[0]
        for s in plan.segments:
            if s.tier == name:
                one = (F.col(spec.bin_col) >= s.lo) & (F.col(spec.bin_col) < s.hi)
                if "period" in df.columns:  # labels of a rung sort like their starts, so partitions are pruned
                    one = one & F.col("period").between(ta.label(ta.floor(s.lo, rung), rung), ta.label(ta.floor(s.hi - 1, rung), rung))
                cond = cond | one
        df = df.where(cond)
        for f in filters:
            df = df.where(f)
        parts.append(df.select(spec.bin_col, *spec.dims, *spec.state_columns))
    if not parts:
        some = next(iter(tiers.values()))
        return some.where(F.lit(False)).select(spec.bin_col, *spec.dims, *spec.state_columns)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def smooth(df: DataFrame, spec: PyramidSpec, sm: Smoothing) -> DataFrame:
    """Adds ``<metric>_smooth<suffix>``: the states merged over a window of rows around each row of its
    dims. The window counts rows, so missing bins make it cover more time; at the edges it shrinks.

    A window holds ``count`` rows at most, so the categories of a histogram's window fit a row."""
    w = Window.partitionBy(*spec.dims).orderBy(spec.bin_col).rowsBetween(-sm.lead, sm.tail)
    out = df
    for m in spec.metrics:
        if m.monoid == "histogram":
            merge = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
            empty = F.create_map().cast("map<string,bigint>")
            out = out.withColumn(f"{m.name}_smooth", F.aggregate(F.collect_list(m.name).over(w), empty, merge))
            continue
        for suffix in MONOIDS[m.monoid].suffixes:
            out = out.withColumn(f"{m.name}_smooth{suffix}", F.sum(f"{m.name}{suffix}").over(w))
    return out


def execute(tiers: Mapping[str, DataFrame], spec: PyramidSpec, plan: Plan, filters: Sequence[Column] = ()) -> DataFrame:
    """The records of a plan: bins that start in the visible range."""
    out = rebin(fetch(tiers, spec, plan, filters), spec, plan.output_bin)
    if plan.smoothing:
        out = smooth(out, spec, plan.smoothing)
    return out.where((F.col(spec.bin_col) >= plan.lo) & (F.col(spec.bin_col) < plan.hi))


def query(tiers: Mapping[str, DataFrame], spec: PyramidSpec, lo: int, hi: int, dims: Mapping[str, object] | None = None, **options) -> tuple[DataFrame, dict]:
    """Plan and execute: ``(records, plan metadata)``. ``dims`` are filters by equality, or by a list."""
    plan = plan_query(spec, lo, hi, **options)
    filters = [F.col(d).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(d) == F.lit(v) for d, v in (dims or {}).items()]
    return execute(tiers, spec, plan, filters), plan.describe()


def reader(spark, spec: PyramidSpec, root: str, schema) -> dict[str, DataFrame]:
    """Tiers as :func:`binstrata.operators.build.build` wrote them, from the smallest rung of each; the
    plan's ranges prune partitions by period and row groups by bin."""
    from pyspark.sql import types as T

    full = T.StructType([*schema, T.StructField("period", T.StringType())])
    return {t.name: spark.read.schema(full).parquet(f"{root}/tier={t.name}/shard={t.shards[0]}") for t in spec.tiers}


class QueryError(ValueError):
    """A parameter of a query can't be understood."""


def query_params(spec: PyramidSpec, params: Mapping[str, str]) -> dict:
    """The arguments of :func:`query` from texts: ``from`` and ``to`` (ISO instants, required, ``from`` before
    ``to``), ``bin_budget`` (a whole number above 0, 1024 by default), ``smooth`` (a duration) with ``smooth_mode``
    (``trailing`` or ``centered``), and one text for each dimension, several values parted by commas. Anything
    else raises :class:`QueryError`."""
    from datetime import datetime, timezone

    known = {"from", "to", "bin_budget", "smooth", "smooth_mode", *spec.dims}
    if odd := sorted(set(params) - known):
        raise QueryError(f"unknown parameter {odd[0]!r}")

    def instant(name: str) -> int:
        try:
            at = datetime.fromisoformat(params[name])
        except KeyError:
            raise QueryError(f"{name} is missing") from None
        except ValueError:
            raise QueryError(f"{name} is no instant: {params[name]!r}") from None
        return ta.to_ms(at if at.tzinfo else at.replace(tzinfo=timezone.utc))

    lo, hi = instant("from"), instant("to")
    if lo >= hi:
        raise QueryError("from must lie before to")
    budget = params.get("bin_budget", "1024")
    if not budget.isdecimal() or int(budget) < 1:
        raise QueryError(f"bin_budget is no whole number above 0: {budget!r}")
    out: dict = {"lo": lo, "hi": hi, "bin_budget": int(budget)}
    mode = params.get("smooth_mode", "centered")
    if mode not in ("trailing", "centered"):
        raise QueryError(f"unknown smooth_mode {mode!r}")
    if "smooth" in params:
        try:
            ta.parse(params["smooth"])
        except ValueError:
            raise QueryError(f"smooth is no duration: {params['smooth']!r}") from None
        out |= {"smoothing": params["smooth"], "mode": mode}
    kinds = {"int": int, "integer": int, "bigint": int, "int64": int, "double": float, "float": float}
    dims = {}
    for d in spec.dims:
        if d in params:
            try:
                values = [kinds.get(spec.dim_types.get(d, "string"), str)(v) for v in params[d].split(",")]
            except ValueError:
                raise QueryError(f"{d}: {params[d]!r}") from None
            dims[d] = values if len(values) > 1 else values[0]
    return out | ({"dims": dims} if dims else {})

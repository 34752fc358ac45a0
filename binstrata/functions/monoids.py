"""Mergeable aggregate states.

A monoid names its state columns and gives the aggregates that make a state from raw rows and merge
states. Scalar states are plain columns; a histogram is a map from category to count, merged by way
of one row for each category, so that no state has to fit a buffer before it is combined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """A metric of a pyramid. ``monoid`` is a name in :data:`MONOIDS`."""

    name: str
    monoid: str

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}{s}" for s in MONOIDS[self.monoid].suffixes]


@dataclass(frozen=True)
class Monoid:
    suffixes: tuple[str, ...]
    additive: bool = True
    #: Whether states are made from whole tables (``states``, ``merge_states``), not by aggregates.
    framed: bool = False

    def from_raw(self, name: str, value: Column) -> list[Column]:
        raise NotImplementedError

    def merge(self, name: str) -> list[Column]:
        return [F.sum(f"{name}{s}").alias(f"{name}{s}") for s in self.suffixes]

    def finish(self, name: str) -> dict[str, Column]:
        return {}


class SumMonoid(Monoid):
    """``_n``, ``_sum``, ``_sumsq`` of the non-null values."""

    def __init__(self):
        super().__init__(("_n", "_sum", "_sumsq"))

    def from_raw(self, name, value):
        v = value.cast("double")
        return [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_sum"), F.sum(v * v).alias(f"{name}_sumsq")]

    def finish(self, name):
        """Mean, sample variance and standard deviation from the state; null where undefined. See
        :func:`exact_variance` for states of whole numbers."""
        n, s, q = (F.col(f"{name}{x}") for x in self.suffixes)
        var = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
        return {"mean": F.when(n > 0, s / n), "var": var, "std": F.sqrt(var)}


def exact_variance(name: str, digits: int = 6) -> Column:
    """Sample variance times ``10 ** digits``, rounded half up, from a sum state of whole numbers below 2^53, by
    whole numbers only; null below two values."""
    n, s, q = (F.col(f"{name}_{x}").cast("decimal(18,0)") for x in ("n", "sum", "sumsq"))
    spread, pairs = n * q - s * s, n * (n - 1)
    scaled = (spread * F.lit(10**digits).cast("decimal(7,0)") * 2 + pairs).cast("decimal(38,0)")
    return F.when(n > 1, F.call_function("div", scaled, (pairs * 2).cast("decimal(38,0)")))


class CountMonoid(Monoid):
    """Number of rows."""

    def __init__(self):
        super().__init__(("",))

    def from_raw(self, name, value):
        return [F.count(F.lit(1)).alias(name)]


class MinMonoid(Monoid):
    def __init__(self):
        super().__init__(("",), additive=False)

    def from_raw(self, name, value):
        return [F.min(value).alias(name)]

    def merge(self, name):
        return [F.min(name).alias(name)]


class MaxMonoid(MinMonoid):
    def from_raw(self, name, value):
        return [F.max(value).alias(name)]

    def merge(self, name):
        return [F.max(name).alias(name)]


class HllMonoid(Monoid):
    """Approximate number of distinct values, as a mergeable sketch."""

    def __init__(self):
        super().__init__(("_hll",), additive=False)

    def from_raw(self, name, value):
        return [F.hll_sketch_agg(value).alias(f"{name}_hll")]

    def merge(self, name):
        return [F.hll_union_agg(f"{name}_hll").alias(f"{name}_hll")]

    def finish(self, name):
        return {"distinct": F.hll_sketch_estimate(f"{name}_hll")}


class QuantileMonoid(Monoid):
    """Approximate quantiles, as a mergeable KLL sketch."""

    def __init__(self):
        super().__init__(("_kll",), additive=False)

    def from_raw(self, name, value):
        return [F.kll_sketch_agg_double(value.cast("double")).alias(f"{name}_kll")]

    def merge(self, name):
        return [F.kll_merge_agg_double(f"{name}_kll").alias(f"{name}_kll")]

    def finish(self, name):
        return {f"p{q}": F.kll_sketch_get_quantile_double(f"{name}_kll", F.lit(q / 100)) for q in (50, 90, 95)}


class TopMonoid(Monoid):
    """The ``k`` greatest (or least) values, exact, as an array in order; nulls don't count, ties stay. Values
    are ranked by a window that cuts every task's rows to ``k`` a group before they are shuffled, so a
    group of any size sends ``k`` rows for each task."""

    def __init__(self, k: int = 10, greatest: bool = True):
        super().__init__(("_top",), additive=False, framed=True)
        object.__setattr__(self, "k", k)
        object.__setattr__(self, "up", greatest)

    def states(self, df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
        """``(*by, name_top)``; groups of nothing but nulls have an empty array."""
        order = F.col(value).desc_nulls_last() if self.up else F.col(value).asc_nulls_last()
        ranked = df.select(*by, F.col(value), F.row_number().over(Window.partitionBy(*by).orderBy(order)).alias("__rank")).where(F.col("__rank") <= self.k)
        return ranked.groupBy(*by).agg(F.sort_array(F.collect_list(value), asc=not self.up).alias(f"{name}_top"))

    def merge_states(self, df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        return self.states(df.select(*by, F.explode_outer(f"{name}_top").alias("__v")), by, "__v", name)


class HistogramMonoid(Monoid):
    """Counts by category, as a map; see :func:`histogram` and :func:`merge_histograms`."""

    def __init__(self):
        super().__init__(("",), framed=True)

    def states(self, df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
        return histogram(df, by, value, None, name)

    def merge_states(self, df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        return merge_histograms(df, by, name)


#: Open registry of monoids; add to it to extend the engine.
MONOIDS: dict[str, Monoid] = {
    "sum": SumMonoid(),
    "count": CountMonoid(),
    "histogram": HistogramMonoid(),
    "min": MinMonoid(),
    "max": MaxMonoid(),
    "hll": HllMonoid(),
    "quantiles": QuantileMonoid(),
    "tdigest": QuantileMonoid(),  # the declared name; the sketch is KLL
    "topk": TopMonoid(),
    "botk": TopMonoid(greatest=False),
}

def register(name: str, monoid: Monoid) -> None:
    """Add a monoid under a new name."""
    if name in MONOIDS:
        raise ValueError(f"monoid {name!r} exists")
    MONOIDS[name] = monoid


def histogram(df: DataFrame, by: Sequence[str], category: str, count: str | None = None, out: str = "hist") -> DataFrame:
    """``(*by, out)``: counts by category of each group as a map. Duplicate categories add up; null
    categories are left out, groups of nothing else keep an empty map. Two levels: categories are
    summed first, with map-side combine, then one small map is made of each group."""
    n = F.lit(1) if count is None else F.col(count)
    sums = df.groupBy(*by, F.col(category).cast("string").alias("__cat")).agg(F.sum(n).cast("long").alias("__n"))
    return sums.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("__cat").isNotNull(), F.struct(F.col("__cat").alias("key"), F.coalesce("__n", F.lit(0)).alias("value")))))).alias(out))


def explode_histogram(df: DataFrame, column: str, keep: Sequence[str], category: str = "category", count: str = "count") -> DataFrame:
    """One row for each category of a histogram column, a map or its JSON."""
    m = F.from_json(column, "map<string,bigint>") if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.select(*keep, F.explode(m).alias(category, count))


def merge_histograms(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """``(*by, column)``: union of the maps of each group, counts added. Null maps add nothing; groups
    without any category drop out."""
    return histogram(explode_histogram(df, column, by, "__c", "__k"), by, "__c", "__k", column)


def histogram_json(column: str | Column) -> Column:
    """Canonical text of a map: compact JSON, keys in numeric order if all are integers, else by text."""
    m = F.col(column) if isinstance(column, str) else column
    entries = F.map_entries(m)
    integers = F.forall(F.map_keys(m), lambda k: k.rlike(r"^-?\d{1,18}$"))
    numeric = F.array_sort(entries, lambda a, b: F.when(a["key"].cast("long") < b["key"].cast("long"), -1).when(a["key"].cast("long") > b["key"].cast("long"), 1).otherwise(0))
    return F.to_json(F.map_from_entries(F.when(integers, numeric).otherwise(F.array_sort(entries))))


def digest(columns: Sequence[str]) -> list[Column]:
    """Order-insensitive digest of a table: number of rows, and the sum of the rows' hashes mod 2^64.

    The hash is the first half of the md5 of the values joined by a unit separator, nulls spelled
    ``\\N``, so other engines can compute it."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n"), (total % F.lit(Decimal(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias("digest")]

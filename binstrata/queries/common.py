"""Shared pieces of the queries: a registry of queries and SQL, and the pyramid over ``events``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.functions.monoids import Metric
from binstrata.operators import build
from binstrata.plans.spec import PyramidSpec, Tier
from binstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries of a module, in order, with their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep


#: Events by hour, day and month; values in whole cents, so that sums are exact in any order.
EVENTS = PyramidSpec(
    "events",
    (Tier("q", "15min", ("6h", "1d")), Tier("h", "1h", ("1d", "4d")), Tier("d", "1d", ("4d",)), Tier("m", "1mo", ("1mo", "1y"))),
    ("event_type",),
    (Metric("n", "count"), Metric("v", "sum")),
    bin_col="dt",
)
#: The same with a histogram of the users' last digit.
EVENTS_HIST = PyramidSpec("events_hist", EVENTS.tiers, ("event_type",), (Metric("n", "count"), Metric("digits", "histogram")), bin_col="dt")
#: Line items by ship date, with calendar tiers; prices in whole units, so that sums of squares stay exact.
SHIPPED = PyramidSpec(
    "shipped",
    (Tier("d", "1d", ("1mo", "1y")), Tier("m", "1mo", ("1y",)), Tier("y", "1y", ("4y",))),
    ("l_returnflag",),
    (Metric("n", "count"), Metric("price", "sum")),
    bin_col="dt",
)

EVENT_MS = "(epoch_us(ts) // 1000)"
CENTS = "CAST(round(value * 100) AS BIGINT)"


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def events_base(spark: SparkSession, d: str, spec: PyramidSpec = EVENTS) -> DataFrame:
    """The base tier of the events pyramid."""
    values = {"n": F.lit(1), "v": cents("value"), "digits": F.pmod("user_id", F.lit(10))}
    return build.from_raw(table(spark, d, "events"), spec, ta.ms_of("ts"), {m.name: values[m.name] for m in spec.metrics})


def events_tiers(spark: SparkSession, d: str, spec: PyramidSpec = EVENTS) -> dict[str, DataFrame]:
    return build.cascade(events_base(spark, d, spec), spec)


def shipped_tiers(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    base = build.from_raw(table(spark, d, "lineitem"), SHIPPED, ta.ms_of("l_shipdate"), {"n": F.lit(1), "price": F.floor("l_extendedprice")})
    return build.cascade(base, SHIPPED)


def states(df: DataFrame, bin_col: str = "dt", dims: tuple[str, ...] = ("event_type",), name: str = "v") -> DataFrame:
    """Exact, engine-neutral form of a wide table of ``n`` and a sum state in cents."""
    return df.select(bin_col, *dims, F.col("n").cast("long").alias("n"), F.col(f"{name}_n").cast("long").alias(f"{name}_n"), F.col(f"{name}_sum").cast("long").alias(f"{name}_sum"), F.col(f"{name}_sumsq").cast("decimal(38,0)").cast("string").alias(f"{name}_sumsq"))


def states_sql(bin_sql: str, source: str = "events", dims: str = "event_type", value: str = CENTS, name: str = "v", where: str = "") -> str:
    """SQL of :func:`states` straight from the raw rows."""
    return f"SELECT {bin_sql} AS dt, {dims}, count(*) AS n, count({value}) AS {name}_n, CAST(sum({value}) AS BIGINT) AS {name}_sum, CAST(CAST(sum({value} * {value}) AS HUGEINT) AS VARCHAR) AS {name}_sumsq FROM {source} {where} GROUP BY ALL"


def sql_floor(ms: str, span: str) -> str:
    """SQL of :func:`binstrata.functions.timeaxis.floor`."""
    s = ta.parse(span)
    if not s.calendar:
        return f"CAST(floor({ms} / {s.fixed_ms}.0) AS BIGINT) * {s.fixed_ms}"
    t = f"make_timestamp({ms} * 1000)"
    k = f"((year({t}) * 12 + month({t}) - 1) // {s.months} * {s.months})"
    return f"epoch_ms(make_timestamp({k} // 12, {k} % 12 + 1, 1, 0, 0, 0))"

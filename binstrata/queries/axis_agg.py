"""Queries of the time axis (T), aggregation (A), reshaping (P) and windows (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from binstrata.functions import monoids as mo
from binstrata.functions import timeaxis as ta
from binstrata.functions.monoids import Metric
from binstrata.operators import build, scans, serve
from binstrata.plans.spec import PyramidSpec
from binstrata.queries.common import CENTS, EVENT_MS, EVENTS, EVENTS_HIST, Book, cents, events_base, events_tiers, sql_floor, states, states_sql
from binstrata.session import table
from binstrata.streaming.tip import dedupe

book = Book()
DAY = ta.DAY

_UNIT = "regexp_extract(shard_dur, '([a-z]+)$', 1)"
_COUNT = "CAST(regexp_extract(shard_dur, '^([0-9]+)', 1) AS BIGINT)"


@book.add("T1_parse_durations", f"SELECT ladder, tier, rung_no, {_COUNT} AS count, {_UNIT} AS unit, {_COUNT} * CASE {_UNIT} WHEN 'min' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 WHEN 'mo' THEN 2592000000 ELSE 31536000000 END AS nominal_ms, span_ms AS fixed_ms FROM tier_rungs")
def t1(spark, d):
    """Durations as count, unit, nominal and fixed width."""
    return table(spark, d, "tier_rungs").select("ladder", "tier", "rung_no", ta.parse_col("shard_dur").alias("p")).select("ladder", "tier", "rung_no", "p.*")


_SPANS = ("15min", "1h", "7d")


@book.add("T4_floor_fixed", " UNION ALL ".join(f"SELECT '{s}' AS span, {sql_floor(EVENT_MS, s)} AS bin, count(*) AS n FROM events GROUP BY ALL" for s in _SPANS))
def t4(spark, d):
    ms = table(spark, d, "events").select(ta.ms_of("ts").alias("ms"))
    each = F.array(*[F.struct(F.lit(s).alias("span"), ta.floor_col("ms", s).alias("bin")) for s in _SPANS])
    return ms.select(F.explode(each).alias("e")).groupBy("e.span", "e.bin").agg(F.count(F.lit(1)).alias("n"))


_CAL = ("1mo", "3mo", "5mo", "18mo", "1y", "2y", "4y")
_ORDER_MS = "epoch_ms(o_orderdate)"


@book.add("T5_floor_calendar", " UNION ALL ".join(f"SELECT '{s}' AS span, {sql_floor(_ORDER_MS, s)} AS bin, count(*) AS n FROM orders GROUP BY ALL" for s in _CAL))
def t5(spark, d):
    """Months and years, anchored at year 0."""
    ms = table(spark, d, "orders").select(ta.ms_of("o_orderdate").alias("ms"))
    each = F.array(*[F.struct(F.lit(s).alias("span"), ta.floor_col("ms", s).alias("bin")) for s in _CAL])
    return ms.select(F.explode(each).alias("e")).groupBy("e.span", "e.bin").agg(F.count(F.lit(1)).alias("n"))


def _sql_next(ms: str, span: str, n: int = 1) -> str:
    s = ta.parse(span)
    if not s.calendar:
        return f"({ms} + {n * s.fixed_ms})"
    return f"epoch_ms(make_timestamp({ms} * 1000) + INTERVAL {n * s.months} MONTH)"


@book.add("T7_ceil_add", " UNION ALL ".join(f"SELECT '{s}' AS span, CASE WHEN {sql_floor(_ORDER_MS, s)} = {_ORDER_MS} THEN {_ORDER_MS} ELSE {_sql_next(sql_floor(_ORDER_MS, s), s)} END AS up, {_sql_next(sql_floor(_ORDER_MS, s), s, 2)} AS later, count(*) AS n FROM orders GROUP BY ALL" for s in ("1d", "1mo", "5mo", "1y")))
def t7(spark, d):
    """Ceil, and two spans after the floor."""
    ms = table(spark, d, "orders").select(ta.ms_of("o_orderdate").alias("ms"))
    each = F.array(*[F.struct(F.lit(s).alias("span"), ta.ceil_col("ms", s).alias("up"), ta.add_col(ta.floor_col("ms", s), s, 2).alias("later")) for s in ("1d", "1mo", "5mo", "1y")])
    return ms.select(F.explode(each).alias("e")).groupBy("e.span", "e.up", "e.later").agg(F.count(F.lit(1)).alias("n"))


_RANGES = "r AS (SELECT pyramid, tier, shard_dur, epoch_ms(period_start) AS a, epoch_ms(period_end) AS b FROM pyramid_shards WHERE period_end > period_start)"


@book.add("T9_bins_in_range", f"WITH {_RANGES} SELECT pyramid, tier, shard_dur, CAST(sum(((b - 1) // 3600000) - (a // 3600000) + 1) AS BIGINT) AS hours, CAST(sum(year(make_timestamp((b - 1) * 1000)) * 12 + month(make_timestamp((b - 1) * 1000)) - year(make_timestamp(a * 1000)) * 12 - month(make_timestamp(a * 1000)) + 1) AS BIGINT) AS months FROM r GROUP BY ALL")
def t9(spark, d):
    """Number of hours and months that each shard's period overlaps."""
    r = table(spark, d, "pyramid_shards").where("period_end > period_start").select("pyramid", "tier", "shard_dur", ta.ms_of("period_start").alias("a"), ta.ms_of("period_end").alias("b"))
    return r.groupBy("pyramid", "tier", "shard_dur").agg(F.sum(ta.bins_col("a", "b", "1h")).alias("hours"), F.sum(ta.bins_col("a", "b", "1mo")).alias("months"))


@book.add("T10_enumerate_periods", f"WITH {_RANGES}, e AS (SELECT pyramid, UNNEST(generate_series(date_trunc('month', make_timestamp(a * 1000)), date_trunc('month', make_timestamp((b - 1) * 1000)), INTERVAL 1 MONTH)) AS m FROM r) SELECT pyramid, epoch_ms(m) AS start_ms, epoch_ms(m + INTERVAL 1 MONTH) AS end_ms, strftime(m, '%Y-%m') AS label, count(*) AS n FROM e GROUP BY ALL")
def t10(spark, d):
    """The months that shards' periods touch, with end and label."""
    r = table(spark, d, "pyramid_shards").where("period_end > period_start").select("pyramid", F.explode(ta.starts_col(ta.ms_of("period_start"), ta.ms_of("period_end"), "1mo")).alias("start_ms"))
    return r.groupBy("pyramid", "start_ms").agg(F.count(F.lit(1)).alias("n")).select("pyramid", "start_ms", ta.add_col("start_ms", "1mo").alias("end_ms"), ta.label_col("start_ms", "1mo").alias("label"), "n")


@book.add("T11_period_labels", "SELECT strftime(ts, '%Y') AS y, strftime(ts, '%Y-%m') AS mo, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m-%dT%H') AS h, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%dT%H-%M') AS mi, count(*) AS n FROM events GROUP BY ALL")
def t11(spark, d):
    ms = ta.ms_of("ts")
    named = {"y": "1y", "mo": "1mo", "d": "1d", "h": "1h", "mi": "30min"}
    e = table(spark, d, "events")
    return e.groupBy(*[ta.label_col(ta.floor_col(ms, s), s).alias(n) for n, s in named.items()]).agg(F.count(F.lit(1)).alias("n"))


@book.add("T12_divides", "WITH b AS (SELECT DISTINCT bin, bin_ms FROM tier_rungs) SELECT x.bin AS fine, y.bin AS coarse, y.bin_ms % x.bin_ms = 0 AS divides, gcd(x.bin_ms, y.bin_ms) AS gcd_ms, lcm(x.bin_ms, y.bin_ms) AS lcm_ms FROM b x, b y")
def t12(spark, d):
    """Which bins divide which, with gcd and lcm of their widths."""
    bins = sorted(r[0] for r in table(spark, d, "tier_rungs").select("bin").distinct().collect())  # a fixed ladder
    w = {b: ta.parse(b).fixed_ms for b in bins}
    rows = [(a, b, ta.divides(a, b), ta.gcd(w[a], w[b]), ta.lcm(w[a], w[b])) for a in bins for b in bins]
    return spark.createDataFrame(rows, "fine string, coarse string, divides boolean, gcd_ms bigint, lcm_ms bigint")


@book.add("A1_sum_state", states_sql(sql_floor(EVENT_MS, "15min")))
def a1(spark, d):
    """Count, and n, sum and sum of squares, from raw rows."""
    return states(events_base(spark, d))


@book.add("A2_merge_states", states_sql(sql_floor(EVENT_MS, "1d")))
def a2(spark, d):
    """States of 15 minutes merged to hours, those to days."""
    t = events_tiers(spark, d)
    return states(t["d"])


@book.add("A4_histogram", f"SELECT {sql_floor(EVENT_MS, '15min')} AS dt, event_type, CAST(user_id % 10 AS VARCHAR) AS category, count(*) AS count FROM events GROUP BY ALL")
def a4(spark, d):
    return mo.explode_histogram(events_base(spark, d, EVENTS_HIST), "digits", ["dt", "event_type"])


@book.add("A5_histogram_merge", f"SELECT {sql_floor(EVENT_MS, '1mo')} AS dt, event_type, CAST(user_id % 10 AS VARCHAR) AS category, count(*) AS count FROM events GROUP BY ALL")
def a5(spark, d):
    """Histograms, as JSON, merged over three tiers."""
    base = events_base(spark, d, EVENTS_HIST).withColumn("digits", mo.histogram_json("digits"))
    base = base.withColumn("digits", F.from_json("digits", "map<string,bigint>"))
    return mo.explode_histogram(build.cascade(base, EVENTS_HIST)["m"], "digits", ["dt", "event_type"])


_D = sql_floor(EVENT_MS, "1d")


@book.add("A6_finishers", f"WITH s AS (SELECT {_D} AS dt, event_type, CAST(count(*) AS HUGEINT) AS n, CAST(sum({CENTS}) AS HUGEINT) AS s, CAST(sum({CENTS} * {CENTS}) AS HUGEINT) AS q FROM events GROUP BY ALL) SELECT dt, event_type, round(s / n, 4) AS mean, CASE WHEN n > 1 THEN CAST(((n * q - s * s) * 2000000 + n * (n - 1)) // (n * (n - 1) * 2) AS BIGINT) END AS var_millionths, CASE WHEN n > 1 THEN round(sqrt((n * q - s * s) / (n * (n - 1))), 4) END AS std, CASE WHEN n > 1 THEN true END AS var_agrees FROM s")
def a6(spark, d):
    """Mean, variance and deviation from merged states: the variance exactly, by whole numbers, and that of
    doubles against it."""
    f, exact = mo.MONOIDS["sum"].finish("v"), mo.exact_variance("v")
    agrees = F.abs(f["var"] * 1e6 - exact) <= 1.0 + exact * 1e-9
    return events_tiers(spark, d)["d"].select("dt", "event_type", F.round(f["mean"], 4).alias("mean"), exact.alias("var_millionths"), F.round(f["std"], 4).alias("std"), agrees.alias("var_agrees"))


def _top(spark, d, monoid: str):
    spec = PyramidSpec("top", EVENTS.tiers, ("event_type",), (Metric("n", "count"), Metric("x", monoid)), bin_col="dt")
    base = build.from_raw(table(spark, d, "events"), spec, ta.ms_of("ts"), {"n": F.lit(1), "x": cents("value")})
    out = mo.MONOIDS[monoid].merge_states(build.cascade(base, spec)["m"], ["event_type"], "x")
    return out.select("event_type", F.posexplode("x_top").alias("p", "cents")).select("event_type", (F.col("p") + 1).cast("long").alias("rank"), "cents")


_TOP = "SELECT event_type, rank, cents FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY event_type ORDER BY round(value * 100) {}) AS rank FROM events) WHERE rank <= 10"


@book.add("A7_top_k", _TOP.format("DESC"))
def a7(spark, d):
    """The ten greatest values by type, from the states of a pyramid, merged over its tiers."""
    return _top(spark, d, "topk")


@book.add("A7_bottom_k", _TOP.format("ASC"))
def a7_least(spark, d):
    return _top(spark, d, "botk")


@book.add("A7_distinct_sketch", "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY ALL")
def a7_hll(spark, d):
    """Approximate distinct users by type, sketches of days merged: within 5 % of the exact number."""
    hll = mo.MONOIDS["hll"]
    e = table(spark, d, "events").select("event_type", ta.floor_col(ta.ms_of("ts"), "1d").alias("dt"), "user_id")
    days = e.groupBy("event_type", "dt").agg(*hll.from_raw("u", F.col("user_id")))
    sketch = days.groupBy("event_type").agg(*hll.merge("u")).select("event_type", hll.finish("u")["distinct"].alias("estimate"))
    exact = e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("users"))
    return exact.join(sketch, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.col("users") * 0.05).alias("close"))


@book.add("A7_quantile_sketch", "SELECT event_type, UNNEST([50, 90, 95]) AS q, true AS close FROM (SELECT DISTINCT event_type FROM events)")
def a7_kll(spark, d):
    """Approximate quantiles by type, sketches of days merged: within two points of the exact rank."""
    q = mo.MONOIDS["quantiles"]
    e = table(spark, d, "events").select("event_type", ta.floor_col(ta.ms_of("ts"), "1d").alias("dt"), F.col("value").cast("double").alias("value"))
    days = e.groupBy("event_type", "dt").agg(*q.from_raw("v", F.col("value")))
    got = days.groupBy("event_type").agg(*q.merge("v")).select("event_type", *[c.alias(n) for n, c in q.finish("v").items()])
    # the rank of an estimate lies between the shares of the values below it and up to it; one row for each type
    rows = e.join(F.broadcast(got), "event_type")
    ranks = rows.groupBy("event_type").agg(F.count("value").alias("n"), *[F.count_if(F.col("value") < F.col(n)).alias(f"{n}_below") for n in ("p50", "p90", "p95")], *[F.count_if(F.col("value") <= F.col(n)).alias(f"{n}_to") for n in ("p50", "p90", "p95")])
    close = lambda p: (F.col(f"p{p}_below") / F.col("n") <= p / 100 + 0.02) & (F.col(f"p{p}_to") / F.col("n") >= p / 100 - 0.02)
    return ranks.select("event_type", F.explode(F.array(*[F.struct(F.lit(p).alias("q"), close(p).alias("close")) for p in (50, 90, 95)])).alias("r")).select("event_type", "r.*")


@book.add("A7_top_items_sketch", "SELECT event_type, UNNEST([1, 2, 3, 4, 5]) AS rank, true AS close FROM (SELECT DISTINCT event_type FROM events)")
def a7_items(spark, d):
    """Approximate most frequent users by type, states of days combined: their numbers are within a thousandth
    of all rows of those of the exact ranks."""
    e = table(spark, d, "events").withColumn("dt", ta.floor_col(ta.ms_of("ts"), "1d"))
    days = e.groupBy("event_type", "dt").agg(F.expr("approx_top_k_accumulate(user_id)").alias("s"))
    got = days.groupBy("event_type").agg(F.expr("approx_top_k_combine(s)").alias("s")).select("event_type", F.posexplode(F.expr("approx_top_k_estimate(s, 5)")).alias("p", "e"))
    got = got.select("event_type", (F.col("p") + 1).alias("rank"), F.col("e.count").alias("n"))
    exact = e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("exact"))
    exact = exact.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("exact")))).where("rank <= 5").drop("user_id")
    total = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("all"))
    return got.join(exact, ["event_type", "rank"]).join(total, "event_type").select("event_type", "rank", (F.abs(F.col("n") - F.col("exact")) <= F.greatest(F.lit(1), F.col("all") / 1000)).alias("close"))


@book.add("A12_arg_min_max", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY ALL")
def a12(spark, d):
    key = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("first_order"), F.max_by("o_orderkey", key).alias("last_order"), F.max_by("o_orderstatus", key).alias("last_status"))


@book.add("A13_min_max_merge", "SELECT l_orderkey, min(epoch_ms(l_shipdate)) AS lo, max(epoch_ms(l_shipdate)) AS hi, l_orderkey % 7 AS tag FROM lineitem GROUP BY ALL")
def a13(spark, d):
    """Runs merged by identity: least and greatest of two columns, the rest must agree."""
    li = table(spark, d, "lineitem").select("l_orderkey", ta.ms_of("l_shipdate").alias("lo"), ta.ms_of("l_shipdate").alias("hi"), F.pmod("l_orderkey", F.lit(7)).alias("tag"), "l_linenumber")
    runs = [li.where(F.col("l_linenumber") % 2 == k).drop("l_linenumber") for k in (0, 1)]
    return scans.merge_runs(runs, ["l_orderkey"], "minmax", low=["lo"], high=["hi"])


_MD5 = "CAST('0x' || substr(md5(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), coalesce(o_orderstatus, '\\N'))), 1, 16) AS UBIGINT)"


@book.add("A14_digest", f"SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST({_MD5} AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS digest FROM orders GROUP BY ALL")
def a14(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*mo.digest(["o_orderkey", "o_custkey", "o_orderstatus"])).withColumn("digest", F.col("digest").cast("string"))


_H = sql_floor(EVENT_MS, "1h")


@book.add("P1_wide_to_long", f"SELECT {_D} AS dt, event_type, 'n' AS metric, NULL AS state, CAST(count(*) AS DOUBLE) AS count FROM events GROUP BY ALL UNION ALL SELECT {_D}, event_type, 'digits', CAST(user_id % 10 AS VARCHAR), CAST(count(*) AS DOUBLE) FROM events GROUP BY ALL")
def p_long(spark, d):
    out = build.to_long(build.rebin(events_base(spark, d, EVENTS_HIST), EVENTS_HIST, "1d"), EVENTS_HIST)
    return out.select("dt", "event_type", "metric", "state", "count")


@book.add("P2_long_to_wide", f"WITH c AS (SELECT {_D} AS dt, event_type, CAST(user_id % 10 AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY ALL) SELECT dt, event_type, CAST(sum(n) AS BIGINT) AS n, '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY CAST(k AS INT)) || '}}' AS digits FROM c GROUP BY ALL")
def p_wide(spark, d):
    """Long rows back to wide ones, histograms as canonical JSON."""
    long = build.to_long(build.rebin(events_base(spark, d, EVENTS_HIST), EVENTS_HIST, "1d"), EVENTS_HIST)
    return build.to_wide(long, EVENTS_HIST, as_json=True)


@book.add("P3_pivot_histogram", "SELECT o_custkey, o_orderpriority AS category, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS count FROM orders GROUP BY ALL")
def p_pivot(spark, d):
    tall = table(spark, d, "orders").select("o_custkey", "o_orderpriority", cents("o_totalprice").alias("c"))
    return mo.explode_histogram(mo.histogram(tall, ["o_custkey"], "o_orderpriority", "c"), "hist", ["o_custkey"])


_LO, _HI = 1704844800000, 1705449600000  # fixed range: 2024-01-10 to 2024-01-17


@book.add("P5_range_and_set_filters", states_sql(_H, where=f"WHERE {_H} >= {_LO} AND {_H} < {_HI} AND event_type IN (SELECT DISTINCT event_type FROM events WHERE event_type LIKE '%c%') AND user_id BETWEEN 10 AND 90"))
def p_filters(spark, d):
    """Bin range, set and closed numeric range."""
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().where(F.col("event_type").contains("c")).collect()]
    e = serve.where_range(serve.where_in(e, "event_type", kinds), "user_id", 10, 90)
    h = build.from_raw(e, EVENTS, ta.ms_of("ts"), {"n": F.lit(1), "v": cents("value")}, "1h")
    return states(h.where((F.col("dt") >= _LO) & (F.col("dt") < _HI)))


@book.add("P8_large_set_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey < 9000")
def p_large_set(spark, d):
    """A set of thousands of values, as a semi join."""
    return serve.where_in(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", [k for k in range(0, 9000) if k % 3 == 0])


@book.add("P9_key_range", "SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders WHERE (o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND (o_orderstatus > 'F' OR (o_orderstatus = 'F' AND o_orderkey >= 500)))) AND (o_orderpriority < '4-NOT SPECIFIED' OR (o_orderpriority = '4-NOT SPECIFIED' AND (o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_orderkey < 1000))))")
def p_lex(spark, d):
    """Lexicographic range over three columns."""
    cols = ["o_orderpriority", "o_orderstatus", "o_orderkey"]
    return table(spark, d, "orders").select(*cols).where(serve.lexicographic(cols, ("2-HIGH", "F", 500), ("4-NOT SPECIFIED", "O", 1000)))


@book.add("P11_balanced_ranges", "SELECT CAST(UNNEST(range(0, 8)) AS INT) AS part, (SELECT count(*) FROM orders) AS total, true AS balanced")
def p_ranges(spark, d):
    """Eight ranges of about equal size: each has within a tenth of an eighth of the rows, together all."""
    o = table(spark, d, "orders").select("o_orderkey")
    ranges = serve.balanced_ranges(o, "o_orderkey", 8)
    k = F.lit(0)
    for lo, _ in ranges[1:]:
        k = k + (F.col("o_orderkey") >= lo).cast("int")
    parts = o.groupBy(k.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total = parts.agg(F.sum("n").alias("total"))
    return parts.join(F.broadcast(total)).select("part", "total", (F.abs(F.col("n") * 8 / F.col("total") - 1) <= 0.1).alias("balanced"))


@book.add("P13_prefix_filter", "SELECT key, count(*) AS n FROM longform WHERE NOT starts_with(key, 'avail') GROUP BY ALL")
def p_prefix(spark, d):
    return table(spark, d, "longform").where(~F.col("key").startswith("avail")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@book.add("W4_rolling_rows", f"WITH b AS ({states_sql(_D)}) SELECT dt, event_type, n, CAST(sum(n) OVER c AS BIGINT) AS n_centered, CAST(sum(n) OVER t AS BIGINT) AS n_trailing FROM b WINDOW c AS (PARTITION BY event_type ORDER BY dt ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), t AS (PARTITION BY event_type ORDER BY dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def w4(spark, d):
    from binstrata.plans.planner import Smoothing

    days = build.rebin(events_base(spark, d), EVENTS, "1d")
    c = serve.smooth(days, EVENTS, Smoothing("4d", 4)).withColumnRenamed("n_smooth", "n_centered").select("dt", "event_type", *EVENTS.state_columns, "n_centered")
    t = serve.smooth(c, EVENTS, Smoothing("4d", 4, "trailing"))
    return t.select("dt", "event_type", "n", "n_centered", F.col("n_smooth").alias("n_trailing"))


@book.add("W5_keep_last", "SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS rn FROM (SELECT DISTINCT user_id, event_type, ts FROM events)) WHERE rn = 1")
def w5(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts")
    return dedupe(e, ["user_id", "event_type"], "ts")


@book.add("W6_newest_per_identity", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c' WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a' END AS src FROM customer")
def w6(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    runs = [c.withColumn("src", F.lit("a")), c.where("c_custkey % 2 = 0").withColumn("src", F.lit("b")), c.where("c_custkey % 3 = 0").withColumn("src", F.lit("c"))]
    return scans.merge_runs(runs, ["c_custkey"], "newest")


QUERIES, SQL = book.queries, book.sql

"""Queries of building (B), planning and serving (Q), sources and sinks (S), freshness (F) and joins (J) of
the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.operators import build, inventory, serve
from binstrata.operators.canonical import canonicalize_shards
from binstrata.operators.fill import classify_gaps, fill, insert_statements, spent
from binstrata.operators.registry import live_rows
from binstrata.plans import cover, planner
from binstrata.plans.spec import PyramidSpec, Tier
from binstrata.queries.common import CENTS, EVENT_MS, EVENTS, EVENTS_HIST, SHIPPED, Book, cents, events_base, events_tiers, shipped_tiers, sql_floor, states, states_sql
from binstrata.session import Scratch, table
from binstrata.sources.shards import Registry, content_key, read_table, tiled_source, write_tiles
from binstrata.sources.store import VersionedStore
from binstrata.streaming import tip

book = Book()
H, D, MO = (sql_floor(EVENT_MS, s) for s in ("1h", "1d", "1mo"))
T0, T1 = ta.to_ms(ta.datetime(2024, 1, 5)), ta.to_ms(ta.datetime(2024, 1, 12))
ALL = (ta.to_ms(ta.datetime(2024, 1, 1)), ta.to_ms(ta.datetime(2024, 2, 1)))


def between(lo, hi, bin_sql):
    return f"WHERE {bin_sql} >= {lo} AND {bin_sql} < {hi}"


# -- build ------------------------------------------------------------------------------------------


@book.add("B1_cascade_month", states_sql(MO))
def b1(spark, d):
    """The coarsest tier, through every finer one."""
    return states(events_tiers(spark, d)["m"])


@book.add("B2_written_shards", states_sql(D))
def b2(spark, d):
    """All rungs of all tiers built and written (B2, B5, B7, S1, S2, S4), then the day tier read back."""
    root = Scratch(spark, "pyramid").root
    base = events_base(spark, d)
    build.build(base, EVENTS, root, *ALL)
    return states(serve.reader(spark, EVENTS, root, base.schema)["d"])


@book.add("B2_shard_periods", f"SELECT 'd' AS tier, '4d' AS shard, strftime(make_timestamp({sql_floor(EVENT_MS, '4d')} * 1000), '%Y-%m-%d') AS period, count(*) AS n FROM events GROUP BY ALL")
def b2_periods(spark, d):
    """Rows behind each written shard of the day tier."""
    t = build.with_periods(events_tiers(spark, d)["d"], EVENTS, "4d")
    return t.groupBy(F.lit("d").alias("tier"), "shard", "period").agg(F.sum("n").alias("n"))


@book.add("B4_plan_dot", """SELECT 'digraph build {' || chr(10) || '  "raw" -> "q";' || chr(10) || '  "q" -> "h";' || chr(10) || '  "h" -> "d";' || chr(10) || '  "d" -> "m";' || chr(10) || '}' AS dot, 'q h d m' AS layers""")
def b4(spark, d):
    """The build plan as a graph, and its layers."""
    return spark.createDataFrame([(cover.plan_dot(EVENTS), " ".join(",".join(x) for x in cover.build_layers(EVENTS)))], "dot string, layers string")


@book.add("B8_fill_missing", f"SELECT 'h' AS tier, strftime(make_timestamp({D} * 1000), '%Y-%m-%d') AS period, count(*) AS n FROM events WHERE ({D} // 86400000) % 3 = 0 GROUP BY ALL")
def b8(spark, d):
    """Fill mode: shards that are expected and not registered are built, and no others."""
    hours = build.with_periods(events_tiers(spark, d)["h"], EVENTS, "1d")
    spec = PyramidSpec("e", (Tier("h", "1h", ("1d",)),))
    expected = cover.expected_table(spark, spec, *ALL)
    registered = expected.where((F.col("period_start") / ta.DAY).cast("long") % 3 != 0)
    todo = inventory.gaps(expected, registered).select(ta.label_col("period_start", "1d").alias("__p"))
    built = hours.join(todo, F.col("period") == F.col("__p"), "left_semi")
    return built.groupBy(F.lit("h").alias("tier"), "period").agg(F.sum("n").alias("n"))


_GAP_TO, _GAP_END = ALL[0] + 20 * ta.DAY, ALL[0] + 28 * ta.DAY


@book.add("B8_gap_classes", f"""WITH have AS (SELECT DISTINCT {D} AS t FROM events WHERE ({D} // 86400000) % 5 <> 0),
tiles AS (SELECT CAST(t AS BIGINT) AS t, NOT EXISTS (SELECT 1 FROM have WHERE have.t = w.t) AS gone FROM (SELECT UNNEST(range({ALL[0]}, {_GAP_END}, 86400000)) AS t) w),
gaps AS (SELECT 'h' AS tier, '1d' AS shard_dur, CAST(a AS BIGINT) AS a, CAST(a + 86400000 AS BIGINT) AS b FROM (SELECT UNNEST(range({ALL[0]}, {ALL[1]}, 86400000)) AS a)
UNION ALL SELECT 'd', '4d', CAST(a AS BIGINT), CAST(a + 345600000 AS BIGINT) FROM (SELECT UNNEST(range({ALL[0]} // 345600000 * 345600000, {ALL[1]} // 345600000 * 345600000, 345600000)) AS a))
SELECT tier, shard_dur, a AS period_start, CASE WHEN b > {_GAP_END} THEN 'unfillable' WHEN EXISTS (SELECT 1 FROM tiles WHERE gone AND t < b AND a < t + 86400000 AND t + 86400000 > {_GAP_TO}) THEN 'deferred' ELSE 'fillable' END AS status FROM gaps""")
def b8_classes(spark, d):
    """Gaps by whether they can be filled, with every fifth tile of the source absent and a fifth tolerated."""
    spec = PyramidSpec("e", (Tier("h", "1h", ("1d",)), Tier("d", "1d", ("4d",))))
    days = events_tiers(spark, d)["d"].select(F.col("dt").alias("period_start")).where(F.floor(F.col("period_start") / ta.DAY) % 5 != 0)
    todo = cover.expected_table(spark, spec, *ALL)
    return classify_gaps(todo, spec, days, "1d", ALL[0], _GAP_END, _GAP_TO, 0.25).select("tier", "shard_dur", "period_start", "status")


@book.add("B10_missing_tiles", f"WITH have AS (SELECT DISTINCT {sql_floor(EVENT_MS, '15min')} AS a FROM events WHERE event_type = 'error' OR event_type = 'purchase'), want AS (SELECT UNNEST(generate_series({ALL[0]}, {ALL[1] - 1}, 900000)) AS a) SELECT a AS period_start FROM want WHERE a NOT IN (SELECT a FROM have)")
def b10(spark, d):
    """Source tiles that are expected and have no rows: the quarters of an hour without certain events."""
    want = spark.range(*ALL, 15 * ta.MINUTE).select(F.col("id").alias("period_start"))
    have = events_base(spark, d).where(F.col("event_type").isin("error", "purchase")).select(F.col("dt").alias("period_start"))
    return build.check_coverage(want, have, ["period_start"], max_missing=10**9)


_TIERS = PyramidSpec("shards", (Tier("q", "15min", ("6h", "1d")), Tier("h", "1h", ("1d", "4d")), Tier("d", "1d", ("4d",))))


@book.add("B13_source_cover", """WITH live AS (SELECT pyramid, tier, epoch_ms(period_start) AS a, epoch_ms(period_end) AS b FROM (SELECT *, row_number() OVER (PARTITION BY pyramid, tier, shard_dur, period_start ORDER BY written_at DESC NULLS LAST) rn FROM pyramid_shards) WHERE rn = 1 AND period_end > period_start),
edges AS (SELECT pyramid, min(a) // 345600000 AS k0, max(a) // 345600000 AS k1 FROM live WHERE pyramid IS NOT NULL GROUP BY 1),
gaps AS (SELECT pyramid, CAST(k * 345600000 AS BIGINT) AS g0, CAST((k + 1) * 345600000 AS BIGINT) AS g1 FROM (SELECT pyramid, UNNEST(range(k0, k1 + 1)) AS k FROM edges)),
p AS (SELECT pyramid, g0, g1, greatest(a, g0) AS a, least(b, g1) AS b FROM gaps JOIN live USING (pyramid) WHERE live.tier = 'h' AND a < g1 AND g0 < b),
v AS (SELECT *, max(b) OVER (PARTITION BY pyramid, g0 ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
c AS (SELECT pyramid, g0, CAST(sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS BIGINT) AS covered FROM v GROUP BY ALL)
SELECT pyramid, g0 AS period_start, g1 AS period_end, coalesce(covered, 0) AS covered, g1 - g0 - coalesce(covered, 0) AS uncovered FROM gaps LEFT JOIN c USING (pyramid, g0)""")
def b13(spark, d):
    """How much of the four-day slots of every pyramid its hour tier covers."""
    return _source_cover(table(spark, d, "pyramid_shards"))


def _source_cover(shards):
    """Cover of the four-day slots of each pyramid, from its first registered instant to its last."""
    live = live_rows(shards).where("period_end > period_start AND pyramid IS NOT NULL").select("pyramid", "tier", "shard_dur", F.unix_millis("period_start").alias("period_start"), F.unix_millis("period_end").alias("period_end"))
    w = 4 * ta.DAY
    slot = lambda c: F.floor(F.col(c) / w) * w
    edges = live.groupBy("pyramid").agg(F.min("period_start").alias("a"), F.max("period_start").alias("b"))
    gaps = edges.select("pyramid", F.lit("d").alias("tier"), F.lit("4d").alias("shard_dur"), F.explode(F.sequence(slot("a"), slot("b"), F.lit(w))).alias("period_start")).withColumn("period_end", F.col("period_start") + w)
    return inventory.source_cover(gaps, live, _TIERS, ["pyramid"]).select("pyramid", "period_start", "period_end", "covered", "uncovered")


@book.add("B15_buildable_at", "SELECT tier, CAST(e AS BIGINT) AS period_end, CAST(ceil(e / 86400000.0) * 86400000 AS BIGINT) AS ready FROM (VALUES ('h'), ('d')) t(tier), (SELECT UNNEST(range(1704067200000, 1704326400000, 21600000)) AS e) WHERE tier = 'd' UNION ALL SELECT 'h', e, CAST(ceil(e / 21600000.0) * 21600000 AS BIGINT) FROM (SELECT UNNEST(range(1704067200000, 1704326400000, 21600000)) AS e)")
def b15(spark, d):
    """When shards that end at given instants can be built."""
    rows = [(t, e, cover.buildable_at(_TIERS, t, e)) for t in ("h", "d") for e in range(1704067200000, 1704326400000, 21600000)]
    return spark.createDataFrame(rows, "tier string, period_end bigint, ready bigint")


@book.add("B16_tile_from_existing", """WITH m AS (SELECT make_timestamp(2026, CAST(k AS INT), 1, 0, 0, 0) AS a, k FROM (SELECT UNNEST(range(1, 13)) AS k)),
d AS (SELECT UNNEST(range(a, a + INTERVAL 1 MONTH, INTERVAL 1 DAY)) AS a FROM m WHERE k % 2 = 0)
SELECT 'pick' AS kind, '1mo' AS shard, epoch_ms(a) AS lo, epoch_ms(a + INTERVAL 1 MONTH) AS hi FROM m WHERE k % 2 = 1 UNION ALL
SELECT CASE WHEN day(a) = 10 THEN 'hole' ELSE 'pick' END, CASE WHEN day(a) <> 10 THEN '1d' END, epoch_ms(a), epoch_ms(a) + 86400000 FROM d""")
def b16(spark, d):
    """A year's shard of days put together from months and days that exist."""
    tier = Tier("d", "1d", ("1d", "1mo", "1y"))
    lo, hi = ta.to_ms(ta.datetime(2026, 1, 1)), ta.to_ms(ta.datetime(2027, 1, 1))
    there = lambda s, a: s == "1mo" and ta.to_datetime(a).month % 2 == 1 or s == "1d" and ta.to_datetime(a).day != 10
    picks, holes = cover.tile_existing(tier, lo, hi, "1y", there, ta.to_ms(ta.datetime(2026, 1, 20)))
    rows = [("pick", s, a, b) for s, a, b in picks] + [("hole", None, a, b) for a, b in holes]
    return spark.createDataFrame(rows, "kind string, shard string, lo bigint, hi bigint")


@book.add("B17_overlap_cover", """SELECT * FROM (VALUES ('pick', '4d', 1704499200000, 1704844800000), ('pick', '1d', 1704844800000, 1704931200000), ('pick', '1d', 1705017600000, 1705035600000),
('hole', NULL, 1704416400000, 1704499200000), ('hole', NULL, 1704931200000, 1705017600000)) t(kind, shard, lo, hi)""")
def b17(spark, d):
    """A range covered by shards that only overlap it, each clipped."""
    tier = Tier("h", "1h", ("1d", "4d"))
    picks, holes = cover.overlap_cover(tier, T0 + ta.HOUR, T1 + 5 * ta.HOUR, lambda s, a: s == "4d" and (a // ta.DAY) % 8 < 4 or s == "1d" and (a // ta.DAY) % 2 == 0)
    rows = [("pick", s, a, b) for s, _, a, b in picks] + [("hole", None, a, b) for a, b in holes]
    return spark.createDataFrame(rows, "kind string, shard string, lo bigint, hi bigint")


@book.add("B18_cross_tier_fill", states_sql(D, where=f"WHERE {D} = {T0} OR {D} >= {T0}"))
def b18(spark, d):
    """Holes of the day tier (every second day) filled from the hour tier, the rest from itself."""
    t = events_tiers(spark, d)
    hole = F.pmod(F.floor(F.col("dt") / ta.DAY), F.lit(2)) == 0
    filled = build.rebin(t["h"].where(hole), EVENTS, "1d")
    return states(t["d"].where(~hole).unionByName(filled).where(F.col("dt") >= T0))


@book.add("B20_fill_driver", states_sql(D, where=between(ALL[0], ALL[1] - 3 * ta.DAY, D)))
def b20(spark, d):
    """Gaps of the whole cover filled in two runs, the first stopped early and some shards of hours invalidated
    between, in a journal that is pruned; then the day tier read back (B8, B9, B14, B19, B20, B21, F5, F8)."""
    root, reg = Scratch(spark, "fill").root, Registry(VersionedStore(spark, Scratch(spark, "fill-registry").root))
    spec = PyramidSpec("events", EVENTS.tiers[:3], EVENTS.dims, EVENTS.metrics, bin_col="dt", key_template="{tier}/{shard}/{period}")
    base, end = events_base(spark, d), ALL[1] - 3 * ta.DAY
    lo, hi = ta.floor(ALL[0], "4d"), ta.floor(end, "4d")
    journal = tip.Journal(VersionedStore(spark, Scratch(spark, "fill-journal").root))
    fill(base, spec, root, reg, lo, hi, now=1, max_gaps=9)
    journal.invalidate("events", T0, T0 + ta.DAY, 2)
    fill(base, spec, root, reg, lo, hi, now=3, requests=journal.rows())
    journal.prune(spent(journal.rows(), spec, reg, lo, hi))
    if journal.rows().count():
        raise AssertionError("a request served is still in the journal")
    out = spark.read.schema(base.schema).parquet(f"{root}/tier=d/shard=4d").select(base.columns)
    rest = build.rebin(base.where(F.col("dt") >= hi), spec, "1d").where(F.col("dt") < end)
    return states(out.unionByName(rest))


@book.add("B27_registry_inserts", f"SELECT 'INSERT INTO pyramid_shards (key, n) VALUES (''' || o_orderpriority || ''', ' || count(*) || ');' AS sql FROM orders GROUP BY o_orderpriority")
def b27(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return insert_statements(rows)


_ROLL = "SELECT dt, who, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS v_sum FROM (SELECT {H} AS dt, 'u:' || user_id AS who, 1 AS n, CAST(round(value * 100) AS BIGINT) AS c FROM events UNION ALL SELECT {H}, 'c:' || (user_id % 7), 1, CAST(round(value * 100) AS BIGINT) FROM events WHERE user_id % 5 <> 0) GROUP BY ALL"


@book.add("B22_identity_rollup", _ROLL.replace("{H}", H))
def b22(spark, d):
    """Rows of canonical identities beside their leaves, twice over."""
    spec = PyramidSpec("who", (Tier("h", "1h", ("1d",)),), ("who",), EVENTS.metrics, bin_col="dt")
    e = table(spark, d, "events").withColumn("who", F.concat(F.lit("u:"), "user_id"))
    leaves = build.from_raw(e, spec, ta.ms_of("ts"), {"n": F.lit(1), "v": cents("value")})
    ids = e.select("user_id", "who").distinct().where("user_id % 5 <> 0").select(F.col("who").alias("raw"), F.pmod("user_id", F.lit(7)).cast("string").alias("canonical"))
    once = build.identity_rollup(leaves, spec, "who", ids)
    return build.identity_rollup(once, spec, "who", ids).select("dt", "who", "n", F.col("v_sum").cast("long").alias("v_sum"))


_EDGE = ALL[1] - 5 * ta.HOUR  # ends within a day


def _cover_sql(tier: str, days: list[int]) -> str:
    """Closed periods of the widest rung, then of each smaller one from where the wider ones end."""
    parts, at = [], f"({ALL[0]} // {days[0] * ta.DAY} * {days[0] * ta.DAY})"
    for n in days:
        w = n * ta.DAY
        end = f"({_EDGE} // {w} * {w})"
        parts.append(f"SELECT '{tier}' AS tier, '{n}d' AS shard_dur, CAST(a AS BIGINT) AS period_start, CAST(a + {w} AS BIGINT) AS period_end FROM (SELECT UNNEST(range({at}, {end}, {w})) AS a)")
        at = end
    return " UNION ALL ".join(parts)


_WHO_LO, _WHO_HI = ta.floor(ALL[0], "4d"), ta.floor(ALL[1], "4d")


@book.add("B23_canonical_shards", f"SELECT dt, who, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS v_sum FROM (SELECT {D} AS dt, 'u:' || user_id AS who, 1 AS n, {CENTS} AS c FROM events UNION ALL SELECT {D}, 'c:' || (user_id % 5), 1, {CENTS} FROM events WHERE user_id % 3 <> 0) WHERE dt >= {_WHO_LO} AND dt < {_WHO_HI} GROUP BY ALL")
def b23(spark, d):
    """Shards written and registered, given canonical rows by one map and then by another, each time by
    rewriting what changed; the day tier read back (B5, B7, B22, B23)."""
    spec = PyramidSpec("who", (Tier("h", "1h", ("1d",)), Tier("d", "1d", ("4d",))), ("who",), EVENTS.metrics, bin_col="dt", key_template="{tier}/{shard}/{period}.{hash:12}.parquet")
    scratch = Scratch(spark, "canonical")
    root, reg = f"{scratch.root}/shards", Registry(VersionedStore(spark, f"{scratch.root}/registry"))
    e = table(spark, d, "events").withColumn("who", F.concat(F.lit("u:"), "user_id"))
    base = scratch.write(build.from_raw(e, spec, ta.ms_of("ts"), {"n": F.lit(1), "v": cents("value")}), "base")
    fill(base, spec, root, reg, _WHO_LO, _WHO_HI, now=1)
    ids = e.select("user_id", "who").distinct()
    first = ids.where("user_id % 5 <> 0").select(F.col("who").alias("raw"), F.pmod("user_id", F.lit(7)).cast("string").alias("canonical"))
    second = ids.where("user_id % 3 <> 0").select(F.col("who").alias("raw"), F.pmod("user_id", F.lit(5)).cast("string").alias("canonical"))
    for now, ids_now in ((2, first), (3, second)):
        canonicalize_shards(spec, base.schema, root, reg, ids_now, "who", _WHO_LO, _WHO_HI, now, scratch)
    out = spark.read.schema(base.schema).parquet(f"{root}/tier=d/shard=4d")
    return out.select("dt", "who", F.col("n").cast("long").alias("n"), F.col("v_sum").cast("long").alias("v_sum"))


@book.add("B24_expected_cover", f"SELECT *, greatest(period_start, {ALL[0]}) AS effective_start, least(period_end, {_EDGE}) AS effective_end FROM ({_cover_sql('d', [16, 4, 1])} UNION ALL {_cover_sql('h', [2, 1])})")
def b24(spark, d):
    """The least cover of a span that ends within a day, by two tiers of several rungs."""
    spec = PyramidSpec("e", (Tier("h", "1h", ("1d", "2d")), Tier("d", "1d", ("1d", "4d", "16d"))))
    return cover.expected_table(spark, spec, ALL[0], _EDGE).drop("key")


@book.add("B26_compare_tables", f"SELECT {H} AS dt, event_type, 'different' AS verdict FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 0 UNION ALL SELECT {H}, event_type, 'only_a' FROM events WHERE event_type <> 'click' AND {H} >= {T1} GROUP BY ALL")
def b26(spark, d):
    """Differences of two versions of a tier, with the verdict."""
    a = events_tiers(spark, d)["h"].select("dt", "event_type", "n")
    even = (F.col("event_type") == "click") & (F.col("n") % 2 == 0)
    b = a.where((F.col("event_type") == "click") | (F.col("dt") < T1)).withColumn("n", F.when(even, F.col("n") + 1).otherwise(F.col("n")))
    return build.compare(a, b, ["dt", "event_type"])


# -- planning and serving ---------------------------------------------------------------------------


@book.add("Q2_budget_day", states_sql(D, where=between(T0, T1, D)))
def q2(spark, d):
    """A week within ten bins: served by days (Q1, Q2, Q13, Q17)."""
    df, _ = serve.query(events_tiers(spark, d), EVENTS, T0, T1, bin_budget=10)
    return states(df)


@book.add("Q2_budget_hour", states_sql(H, where=between(T0, T1, H) + " AND event_type IN ('click', 'view')"))
def q2_hour(spark, d):
    """The same within 200 bins, for two types: served by hours (K6: a real filter)."""
    df, _ = serve.query(events_tiers(spark, d), EVENTS, T0, T1, {"event_type": ["click", "view"]}, bin_budget=200)
    return states(df)


@book.add("Q2_reaggregated_tail", states_sql(D, where=between(T0, T1, D)))
def q2_tail(spark, d):
    """Days known only up to the 9th, hours to the 11th: the tail comes from finer tiers (Q3, Q5, Q15, F1)."""
    marks = {"d@4d": T0 + 4 * ta.DAY, "h@4d": T0 + 4 * ta.DAY, "h@1d": T0 + 6 * ta.DAY}
    df, _ = serve.query(events_tiers(spark, d), EVENTS, T0, T1, bin_budget=10, watermarks=marks)
    return states(df)


@book.add("Q2_plan_segments", """SELECT * FROM (VALUES ('d', '4d', 1704412800000, 1704758400000, false, 'd/4d/2024-01-02.parquet d/4d/2024-01-06.parquet'),
('h', '1d', 1704758400000, 1704931200000, true, 'h/1d/2024-01-09.parquet h/1d/2024-01-10.parquet'), ('q', '1d', 1704931200000, 1705017600000, true, 'q/1d/2024-01-11.parquet')) t(tier, shard, lo, hi, reaggregate, keys)""")
def q2_plan(spark, d):
    """The plan behind that query, by segment (Q19, Q20, Q21)."""
    marks = {"d@4d": T0 + 4 * ta.DAY, "h@4d": T0 + 4 * ta.DAY, "h@1d": T0 + 6 * ta.DAY}
    p = planner.plan_query(EVENTS, T0, T1, 10, watermarks=marks)
    return spark.createDataFrame([(s.tier, s.shard_dur, s.lo, s.hi, s.reaggregate, " ".join(s.keys)) for s in p.segments], "tier string, shard string, lo bigint, hi bigint, reaggregate boolean, keys string")


S6 = sql_floor(EVENT_MS, "6h")


@book.add("Q6_ragged_bins", states_sql(S6, where=between(T0, T1, S6)))
def q6(spark, d):
    """Bins of six hours, which no tier has, from the fewest atoms (Q4, Q6)."""
    df, _ = serve.query(events_tiers(spark, d), EVENTS, T0, T1, target_bin="6h")
    return states(df)


Y0, Y1 = ta.to_ms(ta.datetime(1996, 1, 1)), ta.to_ms(ta.datetime(2000, 1, 1))
SHIP_MS = "epoch_ms(l_shipdate)"
PRICE = "CAST(floor(l_extendedprice) AS BIGINT)"
Q5 = sql_floor(SHIP_MS, "3mo")


@book.add("Q7_calendar_quarters", states_sql(Q5, "lineitem", "l_returnflag", PRICE, "price", between(Y0, Y1, Q5)))
def q7(spark, d):
    """Quarters from whole months (Q7)."""
    df, _ = serve.query(shipped_tiers(spark, d), SHIPPED, Y0, Y1, target_bin="3mo")
    return states(df, dims=("l_returnflag",), name="price")


YR = sql_floor(SHIP_MS, "1y")


@book.add("Q7_calendar_years", states_sql(YR, "lineitem", "l_returnflag", PRICE, "price", between(Y0, Y1, YR)))
def q7_years(spark, d):
    df, _ = serve.query(shipped_tiers(spark, d), SHIPPED, Y0, Y1, bin_budget=5)
    return states(df, dims=("l_returnflag",), name="price")


@book.add("Q8_inventory_plan", states_sql(D, where=between(T0, T1, D) + f" AND {D} <> {T0 + 2 * ta.DAY}"))
def q8(spark, d):
    """From registered shards only: four days of days, then hours, with a day nobody has (Q8, Q9)."""
    S = planner.Shard
    shards = [S("d", "4d", T0 - ta.DAY, T0 + 2 * ta.DAY, "d1"), S("h", "1d", T0 + 3 * ta.DAY, T0 + 4 * ta.DAY, "h1"), S("d", "4d", T0 + 4 * ta.DAY, T1, "d2")]
    plan = planner.plan_from_inventory(EVENTS, T0, T1, shards, 10)
    return states(serve.execute(events_tiers(spark, d), EVENTS, plan))


@book.add("Q10_plan_limits", "SELECT * FROM (VALUES ('atoms', true), ('keys', true), ('none', false)) t(ceiling, refused)")
def q10(spark, d):
    from dataclasses import replace

    from binstrata.plans.spec import Limits

    rows = []
    for name, limit in (("atoms", Limits(max_atoms=1)), ("keys", Limits(max_keys=1)), ("none", Limits())):
        try:
            planner.plan_query(replace(EVENTS, limits=limit), T0, T1, 10)
            rows.append((name, False))
        except planner.PlanLimitError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "ceiling string, refused boolean")


def _smooth_sql(mode: str) -> str:
    frame = "2 PRECEDING AND 2 FOLLOWING" if mode == "centered" else "5 PRECEDING AND CURRENT ROW"
    frame = "3 PRECEDING AND 2 FOLLOWING" if mode == "centered" else frame
    return f"WITH b AS (SELECT {H} AS dt, event_type, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY dt ROWS BETWEEN {frame}) AS BIGINT) AS n_smooth FROM b WHERE dt >= {T0} - {3 if mode == 'centered' else 5} * 3600000 AND dt < {T1} + {2 if mode == 'centered' else 0} * 3600000) SELECT * FROM w WHERE dt >= {T0} AND dt < {T1}"


@book.add("Q14_smooth_centered", _smooth_sql("centered"))
def q14(spark, d):
    """Hours, each with the six around it; the plan is widened for the edges."""
    df, _ = serve.query(events_tiers(spark, d), EVENTS, T0, T1, bin_budget=200, smoothing="6h")
    return df.select("dt", "event_type", "n", "n_smooth")


@book.add("Q14_smooth_trailing", _smooth_sql("trailing"))
def q14_trailing(spark, d):
    df, _ = serve.query(events_tiers(spark, d), EVENTS, T0, T1, bin_budget=200, smoothing="6h", mode="trailing")
    return df.select("dt", "event_type", "n", "n_smooth")


@book.add("Q14_smooth_histogram", f"WITH b AS (SELECT {D} AS dt, event_type, user_id % 10 AS c, count(*) AS n FROM events GROUP BY ALL), days AS (SELECT DISTINCT dt, event_type FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY dt) AS k FROM days) SELECT x.dt, x.event_type, CAST(b.c AS VARCHAR) AS category, CAST(sum(b.n) AS BIGINT) AS count FROM r x JOIN r y ON x.event_type = y.event_type AND y.k BETWEEN x.k - 1 AND x.k JOIN b ON b.dt = y.dt AND b.event_type = y.event_type GROUP BY ALL")
def q14_hist(spark, d):
    """Histograms merged over two days of rows."""
    from binstrata.functions.monoids import explode_histogram

    days = build.rebin(events_base(spark, d, EVENTS_HIST), EVENTS_HIST, "1d")
    s = serve.smooth(days, EVENTS_HIST, planner.Smoothing("2d", 2, "trailing"))
    return explode_histogram(s, "digits_smooth", ["dt", "event_type"])


@book.add("Q16_ladder_rules", "SELECT * FROM (VALUES ('6h,1d', true), ('1d,6h', false), ('6h,10h', false), ('1d,1mo,1y', true), ('7d,1mo', false), ('1mo,18mo', true), ('5mo,1y', false)) t(ladder, valid)")
def q16(spark, d):
    from binstrata.plans.spec import SpecError, check_ladder

    rows = []
    for ladder in ("6h,1d", "1d,6h", "6h,10h", "1d,1mo,1y", "7d,1mo", "1mo,18mo", "5mo,1y"):
        rungs = tuple(ladder.split(","))
        try:
            check_ladder(Tier("t", "1mo" if "mo" in rungs[0] else "1h", rungs))
            rows.append((ladder, True))
        except SpecError:
            rows.append((ladder, False))
    return spark.createDataFrame(rows, "ladder string, valid boolean")


# -- sources, registry, freshness -------------------------------------------------------------------


@book.add("S3_tiled_source", f"SELECT {D} AS dt, count(*) AS n FROM events GROUP BY ALL")
def s3(spark, d):
    """The same for every day of the table, and the day after its last, which has no tile."""
    days = table(spark, d, "events").select(ta.floor_col(ta.ms_of("ts"), "1d").alias("dt")).where("dt IS NOT NULL").distinct()
    have = sorted(r[0] for r in days.collect())  # one number a day
    lo, hi = have[0], have[-1] + 2 * ta.DAY
    rows, missing = _tiles(spark, d, lo, hi)
    if missing != [ta.label(a, "1d") for a in range(lo, hi, ta.DAY) if a not in set(have)]:
        raise AssertionError(missing)
    return rows


def _tiles(spark, d, lo, hi):
    """Every day's tile written by one job; rows by day of those of a range, and the missing ones."""
    root = Scratch(spark, "tiles").root
    e = table(spark, d, "events").withColumn("dt", ta.floor_col(ta.ms_of("ts"), "1d"))
    write_tiles(e.withColumn("tile", ta.label_col("dt", "1d")), root, "tile", ["ts"])
    rows, missing = tiled_source(spark, root, "1d", e.schema, lo, hi)
    return rows.groupBy("dt").agg(F.count(F.lit(1)).alias("n")), missing


@book.add("S5_content_addressed", "SELECT o_orderpriority, true AS same FROM orders GROUP BY ALL")
def s5(spark, d):
    """Keys from content: the same for the same rows in another order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rows = []
    for (p,) in sorted(o.select("o_orderpriority").distinct().collect()):  # five fixed values
        part = o.where(F.col("o_orderpriority") == p)
        one = content_key("o/{p}.{hash:8}.parquet", part, p=p)
        rows.append((p, one == content_key("o/{p}.{hash:8}.parquet", part.repartition(3).sortWithinPartitions(F.desc("o_orderkey")), p=p)))
    return spark.createDataFrame(rows, "o_orderpriority string, same boolean")


_LIVE = "live AS (SELECT pyramid, tier, shard_dur, epoch_ms(period_start) AS period_start, epoch_ms(period_end) AS period_end, key, epoch_ms(written_at) AS written_at FROM (SELECT *, row_number() OVER (PARTITION BY pyramid, tier, shard_dur, period_start ORDER BY written_at DESC NULLS LAST) rn FROM pyramid_shards) WHERE rn = 1)"


def registry(spark, d):
    return live_rows(table(spark, d, "pyramid_shards")).select("pyramid", "tier", "shard_dur", F.unix_millis("period_start").alias("period_start"), F.unix_millis("period_end").alias("period_end"), "key", F.unix_millis("written_at").alias("written_at"))


@book.add("S8_table_formats", " UNION ALL ".join(f"SELECT '{k}' AS kind, n_nationkey, n_name FROM nation" for k in ("parquet", "orc", "json", "csv")))
def s8(spark, d):
    """One table written in each built-in format and read again."""
    rows, root, out = table(spark, d, "nation").select("n_nationkey", "n_name"), Scratch(spark, "formats").root, None
    for kind in ("parquet", "orc", "json", "csv"):
        rows.write.format(kind).save(f"{root}/{kind}")
        got = read_table(spark, f"{root}/{kind}", kind, rows.schema).select(F.lit(kind).alias("kind"), "n_nationkey", "n_name")
        out = got if out is None else out.unionByName(got)
    return out


@book.add("S9_registry_live", f"WITH {_LIVE} SELECT * FROM live")
def s9(spark, d):
    """The live row of each slot, through a registry that took the rows by two appends."""
    r = Registry(VersionedStore(spark, Scratch(spark, "registry").root))
    rows = table(spark, d, "pyramid_shards").select("pyramid", "tier", "shard_dur", F.unix_millis("period_start").alias("period_start"), F.unix_millis("period_end").alias("period_end"), "key", F.unix_millis("written_at").alias("written_at"), F.lit(0).cast("long").alias("n_rows"))
    half = F.pmod(F.hash("key"), F.lit(2))
    r.record(rows.where(half == 0))
    r.record(rows.where(half == 1))
    r.compact()
    return r.rows().drop("n_rows")


@book.add("S10_list_range", f"WITH {_LIVE} SELECT * FROM live WHERE tier = 'h' AND period_end > {T0} AND period_start < {T1}")
def s10(spark, d):
    return inventory.list_shards(registry(spark, d), "h", T0, T1)


@book.add("F_watermarks", f"WITH {_LIVE} SELECT pyramid, tier, shard_dur, max(period_end) AS latest_period_end FROM live GROUP BY ALL")
def f_marks(spark, d):
    """How far each rung is registered."""
    return registry(spark, d).groupBy("pyramid", "tier", "shard_dur").agg(F.max("period_end").alias("latest_period_end"))


@book.add("F2_tumbling", "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS lo, event_type, count(*) AS n FROM events GROUP BY ALL")
def f2(spark, d):
    t = tip.tumbling(table(spark, d, "events"), "ts", "1 hour", "1 day", ["event_type"], {"n": F.count(F.lit(1))})
    return t.select(ta.ms_of("bin_start").alias("lo"), "event_type", "n")


@book.add("F3_sliding", "SELECT epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE) AS lo, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")
def f3(spark, d):
    t = tip.sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes", "1 day", ["event_type"], {"n": F.count(F.lit(1))})
    return t.select(ta.ms_of("bin_start").alias("lo"), "event_type", "n")


@book.add("F4_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, epoch_us(min(ts)) // 1000 AS lo, count(*) AS n FROM g GROUP BY user_id, k")
def f4(spark, d):
    t = tip.sessions(table(spark, d, "events"), "ts", "6 hours", "1 day", ["user_id"], {"n": F.count(F.lit(1))})
    return t.select("user_id", ta.ms_of("bin_start").alias("lo"), "n")


_REQ = "req AS (SELECT pyramid, epoch_ms(start) AS a, epoch_ms(\"end\") AS b, epoch_ms(requested_at) AS r FROM invalidation)"


def requests(spark, d):
    return table(spark, d, "invalidation").select("pyramid", F.unix_millis("start").alias("a"), F.unix_millis("end").alias("b"), F.unix_millis("requested_at").alias("r"))


@book.add("F6_stale_shards", f"WITH {_LIVE}, {_REQ} SELECT live.* FROM live WHERE period_end > period_start AND EXISTS (SELECT 1 FROM req WHERE req.pyramid = live.pyramid AND b > a AND a < period_end AND period_start < b AND written_at < r)")
def f6(spark, d):
    """Shards that a later repair request overlaps."""
    return inventory.stale(registry(spark, d), requests(spark, d)).select("pyramid", "tier", "shard_dur", "period_start", "period_end", "key", "written_at")


@book.add("F7_spent_requests", f"WITH {_LIVE}, {_REQ} SELECT * FROM req WHERE NOT (b > a AND r IS NOT NULL AND EXISTS (SELECT 1 FROM live WHERE live.pyramid = req.pyramid AND period_end > period_start AND a < period_end AND period_start < b AND written_at < r)) OR b IS NULL")
def f7(spark, d):
    """Requests that no shard waits for."""
    return inventory.spent_requests(requests(spark, d), registry(spark, d)).drop("id")


NOW = ta.to_ms(ta.datetime(2025, 1, 1))


@book.add("F8_gap_discovery", f"WITH {_LIVE}, g AS (SELECT pyramid, min(period_start) AS a, max(period_start) AS b FROM live WHERE tier = 'd' AND shard_dur = '4d' GROUP BY 1), e AS (SELECT pyramid, UNNEST(range(a, b + 1, 345600000)) AS s FROM g) SELECT pyramid, s AS period_start FROM e WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.pyramid = e.pyramid AND tier = 'd' AND shard_dur = '4d' AND period_start = s)")
def f8(spark, d):
    """Slots of the day tier that nobody registered, of every pyramid."""
    live = registry(spark, d).where("tier = 'd' AND shard_dur = '4d'")
    edges = live.groupBy("pyramid").agg(F.min("period_start").alias("a"), F.max("period_start").alias("b"))
    want = edges.select("pyramid", F.explode(F.sequence("a", "b", F.lit(4 * ta.DAY))).alias("period_start"))
    return want.join(live.select("pyramid", "period_start"), ["pyramid", "period_start"], "left_anti")


_NOM = "CAST(regexp_extract(shard_dur, '^([0-9]+)', 1) AS BIGINT) * CASE regexp_extract(shard_dur, '([a-z]+)$', 1) WHEN 'min' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 WHEN 'mo' THEN 2592000000 ELSE 31536000000 END"
_GC_KEEP = "FROM live WHERE (shard_dur IN ('1d', '4d', '1mo', '1y')) = false"


@book.add("F10_registry_gc", f"""WITH {_LIVE}, rows_ AS (SELECT *, pyramid || '/' || tier AS pt, {_NOM} AS w FROM live), r AS (SELECT * FROM rows_ WHERE shard_dur IN ('1h', '6h') AND NOT starts_with(key, 'usage')),
v AS (SELECT r.*, EXISTS (SELECT 1 FROM rows_ p WHERE p.pt = r.pt AND p.w > r.w AND p.period_start <= r.period_start AND p.period_end >= r.period_end AND p.period_end > p.period_start) AS covered FROM r)
SELECT key, CASE WHEN period_end > {NOW} AND written_at + 21600000 > {NOW} THEN 'future period within grace' WHEN period_end <= {NOW} AND period_end + 21600000 > {NOW} THEN 'within grace' WHEN period_end <= {NOW} AND NOT covered THEN 'no covering parent' ELSE 'delete' END AS verdict FROM v""")
def f10(spark, d):
    """What a sweep would do with each small shard that is no part of the cover."""
    rows = registry(spark, d).withColumn("tier", F.concat("pyramid", F.lit("/"), "tier"))
    expected = rows.where(~F.col("shard_dur").isin("1h", "6h")).select("key")
    return inventory.collectable(rows, expected, NOW, raw_prefixes=["usage"]).select("key", "verdict")


@book.add("F11_orphans", f"WITH {_LIVE}, s AS (SELECT DISTINCT key, max(epoch_ms(written_at)) OVER (PARTITION BY key) AS mtime FROM pyramid_shards) SELECT key, mtime FROM s WHERE key NOT IN (SELECT key FROM live) AND mtime + 21600000 <= {NOW}")
def f11(spark, d):
    """Stored files that the registry no longer names."""
    stored = table(spark, d, "pyramid_shards").groupBy("key").agg(F.max(F.unix_millis("written_at")).alias("mtime"))
    return inventory.orphans(stored, registry(spark, d), NOW)


@book.add("F12_adopt", f"WITH {_LIVE}, r AS (SELECT pyramid, tier, shard_dur, epoch_ms(period_start) AS period_start FROM (SELECT *, row_number() OVER (PARTITION BY pyramid, tier, shard_dur, period_start ORDER BY written_at DESC NULLS LAST) rn FROM pyramid_shards) WHERE rn = 1 AND n_bytes IS NOT NULL) SELECT pyramid, tier, shard_dur, period_start FROM live x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pyramid = x.pyramid AND r.tier = x.tier AND r.shard_dur = x.shard_dur AND r.period_start = x.period_start)")
def f12(spark, d):
    """Stored slots of every pyramid that are not registered with their size."""
    r = live_rows(table(spark, d, "pyramid_shards")).withColumn("period_start", F.unix_millis("period_start"))
    return inventory.adoptable(r.select("pyramid", "tier", "shard_dur", "period_start"), r.where("n_bytes IS NOT NULL"))


@book.add("F14_cover_status", f"WITH {_LIVE}, h AS (SELECT DISTINCT pyramid, period_start FROM live WHERE tier = 'd' AND shard_dur = '4d'), g AS (SELECT pyramid, min(period_start) // 345600000 * 345600000 AS a, max(period_start) // 345600000 * 345600000 AS b FROM h WHERE pyramid IS NOT NULL AND period_start IS NOT NULL GROUP BY 1), e AS (SELECT pyramid, CAST(UNNEST(range(a, b + 1, 345600000)) AS BIGINT) AS s FROM g) SELECT coalesce(e.pyramid, h.pyramid) AS pyramid, coalesce(s, period_start) AS period_start, CASE WHEN s IS NULL THEN 'stale' WHEN period_start IS NOT NULL THEN 'present' WHEN s + 345600000 > {NOW} - 600000 THEN 'pending' ELSE 'missing' END AS status FROM e FULL JOIN h ON e.pyramid = h.pyramid AND s = period_start")
def f14(spark, d):
    """The same of every pyramid, over all of its registered span."""
    one = registry(spark, d).where("tier = 'd' AND shard_dur = '4d'").groupBy("pyramid", "tier", "shard_dur", "period_start").agg(F.max("period_end").alias("period_end"))
    w = 4 * ta.DAY
    slot = lambda c: F.floor(c / w) * w
    edges = one.where("pyramid IS NOT NULL AND period_start IS NOT NULL").groupBy("pyramid", "tier", "shard_dur").agg(slot(F.min("period_start")).alias("lo"), slot(F.max("period_start")).alias("hi"))
    expected = edges.select("pyramid", "tier", "shard_dur", F.explode(F.sequence("lo", "hi", F.lit(w))).alias("period_start")).withColumn("period_end", F.col("period_start") + w)
    return inventory.cover_status(expected, one, F.col("period_end"), NOW, by=["pyramid"]).select("pyramid", "period_start", "status")


@book.add("S13_tip_stream", f"SELECT {sql_floor(EVENT_MS, '15min')} AS dt, event_type, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY {EVENT_MS}, event_type, user_id ORDER BY value DESC) = 1")
def s13(spark, d):
    """The whole table streamed into the tip."""
    return _tip(spark, d)


def _tip(spark, d):
    """A stream of files of all events merged into the open shards, each delivery twice."""
    root, scratch = Scratch(spark, "tip").root, Scratch(spark, "stream")
    e = table(spark, d, "events").select(ta.floor_col(ta.ms_of("ts"), "15min").alias("dt"), ta.ms_of("ts").alias("ms"), "event_type", "user_id", "value")
    arrival = F.col("dt") + F.pmod(F.hash("user_id", "ms"), F.lit(3)) * ta.DAY  # up to two days late: batches meet shards of those before
    e.repartitionByRange(6, arrival).write.parquet(f"{scratch.root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.root}/in")
    put = tip.tip_writer(EVENTS, root, ["ms", "event_type", "user_id"], "value")

    def twice(batch, epoch):
        put(batch, epoch)
        put(batch, epoch)

    q = stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/tier=q/shard=6h").select("dt", "event_type", "user_id", "value")


@book.add("SET_union_except", "SELECT o_custkey AS k, 'orders only' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY ALL UNION ALL SELECT c_custkey, 'both' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def sets(spark, d):
    """Difference and intersection of key sets (SET)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return o.distinct().join(c, "k", "left_anti").withColumn("side", F.lit("orders only")).unionByName(c.intersect(o).withColumn("side", F.lit("both")))


QUERIES, SQL = book.queries, book.sql

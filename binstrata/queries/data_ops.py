"""Queries of the general data operations p1 to p6, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binstrata.operators import history, increments, snapshot_diff
from binstrata.operators.compaction import Compactor, month_of
from binstrata.operators.percentiles import merge_partials, partials, percentiles
from binstrata.operators.registry import live_rows
from binstrata.operators.sweep import periods_and_gaps
from binstrata.session import Scratch, table
from binstrata.sources.store import VersionedStore

BY_MONTH = ("pyramid", "tier", "shard_dur", "month")


def _store(spark: SparkSession, name: str) -> VersionedStore:
    return VersionedStore(spark, Scratch(spark, name).root)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return live_rows(table(spark, d, "pyramid_shards")).withColumn("month", month_of("period_start"))


def _compacted(spark: SparkSession, d: str) -> tuple[Compactor, DataFrame, DataFrame]:
    """The registry compacted once: the compactor, the files and the records."""
    files, records = Scratch(spark, "p1-files").write(_files(spark, d), "files"), table(spark, d, "longform")
    c = Compactor(_store(spark, "p1"), BY_MONTH)
    c.compact(files, records, current=lambda: _files(spark, d))
    return c, files, records


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Partitions with too many small files: those that a compaction of all records rewrote, by the
    manifest of its committed version."""
    c, _, _ = _compacted(spark, d)
    return c.manifest().where(~F.col("conflict")).select(*BY_MONTH)


def p1_compacted(spark: SparkSession, d: str) -> DataFrame:
    """All records after a compaction, each once, with their partition and whether it was rewritten."""
    c, files, records = _compacted(spark, d)
    return c.read(files, records).select("rec_id", "key", "dt", *BY_MONTH, "rewritten")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each version of each object, with the first and last scan in which it held: a history of all scans
    but the last of each dataset, to which these are appended."""
    out = history.archive_history(table(spark, d, "intervals"), table(spark, d, "pyramid_multiscans"), _store(spark, "p2"), Scratch(spark, "p2"))
    return out.select("dataset", "dt", "path", "scan_first", "scan_last")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th and 95th percentile of ``state`` by weight, exact, for each station and metric."""
    by = ("station_id", "metric")
    out = percentiles(_weights(spark, d), by, (0.5, 0.9, 0.95), Scratch(spark, "p3"))
    return out.select(*by, F.col("p_0").cast("long").alias("p50"), F.col("p_1").cast("long").alias("p90"), F.col("p_2").cast("long").alias("p95"))


def _once(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered record once, with its month; those that count for percentiles."""
    rows = table(spark, d, "longform").select("rec_id", "station_id", "metric", "state", "count", F.date_format(F.timestamp_millis("dt"), "yyyy-MM").alias("month"))
    return rows.where(F.col("station_id").isNotNull() & F.col("state").isNotNull() & (F.col("count") > 0) & ~F.isnan("count")).distinct()


def _weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by station, metric and state, each delivered record counted once."""
    rows = table(spark, d, "longform").select("rec_id", "station_id", "metric", "state", "count")
    usable = F.col("station_id").isNotNull() & F.col("state").isNotNull() & (F.col("count") > 0) & ~F.isnan("count")
    once = rows.where(usable).distinct()
    return partials(once, ("station_id", "metric"), "state", "count")


def p3_from_parts(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles of :func:`p3_percentiles` from partial results of each month of records, written one
    folder each, read again and combined."""
    by, scratch = ("station_id", "metric"), Scratch(spark, "p3")
    parts = partials(_once(spark, d), (*by, "month"), "state", "count")
    path = f"{scratch.root}/parts"
    parts.write.partitionBy("month").parquet(path)
    read = spark.read.schema(parts.schema).parquet(path)
    out = percentiles(merge_partials(read, by), by, (0.5, 0.9, 0.95), scratch)
    return out.select(*by, F.col("p_0").cast("long").alias("p50"), F.col("p_1").cast("long").alias("p90"), F.col("p_2").cast("long").alias("p95"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose 95th percentile is at least ten times their median."""
    by = ("station_id", "metric")
    out = percentiles(_weights(spark, d), by, (0.5, 0.95), Scratch(spark, "p3"))
    return out.where(F.col("p_1") >= F.col("p_0") * 10).select(*by)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods and gaps of each tier's shards and of each pyramid's invalidations."""
    ms = lambda c: F.unix_millis(c)
    shards = live_rows(table(spark, d, "pyramid_shards")).select(F.lit("shards").alias("origin"), "pyramid", "tier", ms("period_start").alias("a"), ms("period_end").alias("b"))
    repairs = table(spark, d, "invalidation").select(F.lit("invalidation").alias("origin"), "pyramid", F.lit("").alias("tier"), ms("start").alias("a"), ms("end").alias("b"))
    out = periods_and_gaps(shards.unionByName(repairs), ("origin", "pyramid", "tier"), "a", "b")
    return out.select("origin", "pyramid", "tier", "kind", F.col("lo").alias("lo_ms"), F.col("hi").alias("hi_ms"))


def _shards(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "pyramid_shards"), table(spark, d, "pyramid_watermarks"), table(spark, d, "invalidation")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Shards that are new, rewritten or invalidated since the last successful run: the run's state is
    committed from the marks, the run selects by it, writes what it selected and swaps the state."""
    tracker, scratch = increments.ChangeTracker(_store(spark, "p5"), increments.SLOT), Scratch(spark, "p5")
    todo = increments.pending_shards(*_shards(spark, d), tracker)
    out = scratch.write(todo.select("pyramid", "tier", "shard_dur", F.unix_millis("period_start").alias("period_start_ms")), "selected")
    tracker.commit()
    return out


def p5_next_run(spark: SparkSession, d: str) -> DataFrame:
    """Three runs: the first commits, then every shard of one month is rewritten and the second fails
    before it commits; the third must select exactly the rewritten ones."""
    store = _store(spark, "p5")
    first = increments.ChangeTracker(store, increments.SLOT)
    increments.pending_shards(*_shards(spark, d), first)
    contents = spark.read.parquet(first.staged)
    first.commit()
    rewritten = F.date_format("period_start", "yyyy-MM") == "2024-03"
    later = contents.withColumn("content", F.when(rewritten, F.sha2(F.concat(F.lit("again"), F.col("content")), 256)).otherwise(F.col("content")))
    increments.ChangeTracker(store, increments.SLOT).pending(later)  # fails: nothing is committed
    third = increments.ChangeTracker(store, increments.SLOT)
    out = Scratch(spark, "p5").write(third.pending(later).select("pyramid", "tier", "shard_dur", F.unix_millis("period_start").alias("period_start_ms")), "selected")
    third.commit()
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Objects added, removed or changed between consecutive full scans."""
    return snapshot_diff.archive_diffs(table(spark, d, "intervals"), table(spark, d, "pyramid_multiscans"), Scratch(spark, "p6"))


QUERIES = {q.__name__: q for q in (p1_found, p1_compacted, p2_found, p3_found, p3_percentiles, p3_from_parts, p4_found, p5_found, p5_next_run, p6_found)}

_LIVE = "live AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pyramid, tier, shard_dur, period_start ORDER BY written_at DESC NULLS LAST) rn FROM pyramid_shards) WHERE rn = 1)"
_MARKS = "marks AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY pyramid, tier, shard_dur ORDER BY updated_at DESC NULLS LAST, latest_period_end DESC) rn FROM pyramid_watermarks WHERE latest_period_end IS NOT NULL) WHERE rn = 1)"
_MONTH = "strftime(period_start AT TIME ZONE 'UTC', '%Y-%m')"
_FOUND = f"found AS (SELECT pyramid, tier, shard_dur, {_MONTH} AS month FROM live GROUP BY ALL HAVING count(*) FILTER (n_bytes < 65536) >= 10)"
_WEIGHTS = "w AS (SELECT station_id, metric, state, sum(count) AS weight FROM (SELECT DISTINCT rec_id, station_id, metric, state, count FROM longform WHERE station_id IS NOT NULL AND state IS NOT NULL AND count > 0 AND NOT isnan(count)) GROUP BY ALL), c AS (SELECT *, sum(weight) OVER (PARTITION BY station_id, metric ORDER BY state) AS up_to, sum(weight) OVER (PARTITION BY station_id, metric) AS total FROM w)"
_CATALOG = """archives AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY dataset, key ORDER BY written_at DESC NULLS LAST) rn FROM pyramid_multiscans) WHERE rn = 1),
listed AS (SELECT dataset, key, written_at, encoder, UNNEST(from_json(scans, '["VARCHAR"]')) AS label, UNNEST(range(0, CAST(json_array_length(scans) AS BIGINT))) AS idx FROM archives),
owned AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY label) AS scan FROM (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY written_at DESC NULLS LAST, key DESC, idx DESC) rn FROM listed) WHERE rn = 1),
present AS (SELECT DISTINCT o.dataset, o.scan, o.label, o.encoder, i.dt, i.path, coalesce(i.b, 0) AS b, coalesce(i.o, 0) AS o FROM intervals i JOIN owned o ON o.key = i.key AND o.idx BETWEEN coalesce(i.__scan, i.__scan_lo) AND coalesce(i.__scan, i.__scan_hi) WHERE coalesce(i.b, 0) <> 0 OR coalesce(i.o, 0) <> 0)"""

SQL = {
    "p1_found": f"WITH {_LIVE}, {_FOUND} SELECT * FROM found",
    "p1_compacted": f"WITH {_LIVE}, {_FOUND}, l AS (SELECT *, {_MONTH} AS month FROM live), r AS (SELECT DISTINCT rec_id, key, dt FROM longform) SELECT r.rec_id, r.key, r.dt, l.pyramid, l.tier, l.shard_dur, l.month, f.month IS NOT NULL AS rewritten FROM r JOIN l USING (key) LEFT JOIN found f ON f.pyramid = l.pyramid AND f.tier = l.tier AND f.shard_dur = l.shard_dur AND f.month = l.month",
    "p2_found": f"""WITH {_CATALOG},
m AS (SELECT *, lag(scan) OVER w AS ps, lag(b) OVER w AS pb, lag(o) OVER w AS po FROM present WINDOW w AS (PARTITION BY dataset, dt, path ORDER BY scan)),
n AS (SELECT *, sum(CASE WHEN ps IS NULL OR scan <> ps + 1 OR b <> pb OR o <> po THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, dt, path ORDER BY scan) AS run FROM m)
SELECT dataset, dt, path, min(label) AS scan_first, max(label) AS scan_last FROM n GROUP BY dataset, dt, path, run""",
    "p3_found": f"WITH {_WEIGHTS}, p AS (SELECT station_id, metric, min(state) FILTER (up_to >= total * 0.5) AS p50, min(state) FILTER (up_to >= total * 0.95) AS p95 FROM c GROUP BY ALL) SELECT station_id, metric FROM p WHERE p95 >= 10 * p50",
    "p3_percentiles": f"WITH {_WEIGHTS} SELECT station_id, metric, CAST(min(state) FILTER (up_to >= total * 0.5) AS BIGINT) AS p50, CAST(min(state) FILTER (up_to >= total * 0.9) AS BIGINT) AS p90, CAST(min(state) FILTER (up_to >= total * 0.95) AS BIGINT) AS p95 FROM c GROUP BY ALL",
    "p3_from_parts": f"WITH {_WEIGHTS} SELECT station_id, metric, CAST(min(state) FILTER (up_to >= total * 0.5) AS BIGINT) AS p50, CAST(min(state) FILTER (up_to >= total * 0.9) AS BIGINT) AS p90, CAST(min(state) FILTER (up_to >= total * 0.95) AS BIGINT) AS p95 FROM c GROUP BY ALL",
    "p4_found": f"""WITH {_LIVE},
p AS (SELECT 'shards' AS origin, pyramid, tier, epoch_ms(period_start) AS a, epoch_ms(period_end) AS b FROM live UNION ALL SELECT 'invalidation', pyramid, '', epoch_ms(start), epoch_ms("end") FROM invalidation),
v AS (SELECT *, max(b) OVER (PARTITION BY origin, pyramid, tier ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p WHERE b > a),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY origin, pyramid, tier ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM v),
m AS (SELECT origin, pyramid, tier, n, min(a) AS lo, max(b) AS hi FROM i GROUP BY ALL)
SELECT origin, pyramid, tier, 'period' AS kind, lo AS lo_ms, hi AS hi_ms FROM m UNION ALL
SELECT * FROM (SELECT origin, pyramid, tier, 'gap', hi, lead(lo) OVER (PARTITION BY origin, pyramid, tier ORDER BY n) AS nx FROM m) WHERE nx IS NOT NULL""",
    "p5_found": f"""WITH {_LIVE}, {_MARKS}
SELECT l.pyramid, l.tier, l.shard_dur, epoch_ms(l.period_start) AS period_start_ms FROM live l LEFT JOIN marks m ON m.pyramid = l.pyramid AND m.tier = l.tier AND m.shard_dur = l.shard_dur
WHERE m.pyramid IS NULL OR l.period_end > m.latest_period_end OR l.written_at > m.updated_at
OR (l.period_end > l.period_start AND EXISTS (SELECT 1 FROM invalidation i WHERE i.pyramid = l.pyramid AND i."end" > i.start AND i.start < l.period_end AND l.period_start < i."end" AND l.written_at < i.requested_at))""",
    "p5_next_run": f"WITH {_LIVE} SELECT pyramid, tier, shard_dur, epoch_ms(period_start) AS period_start_ms FROM live WHERE {_MONTH} = '2024-03'",
    "p6_found": f"""WITH {_CATALOG},
pairs AS (SELECT b.dataset, b.scan, b.label FROM owned a JOIN owned b ON b.dataset = a.dataset AND b.scan = a.scan + 1 WHERE a.encoder = 'densify' AND b.encoder = 'densify'),
x AS (SELECT q.dataset, q.label, p.dt, p.path, p.b, p.o FROM pairs q JOIN present p ON p.dataset = q.dataset AND p.scan = q.scan - 1),
y AS (SELECT q.dataset, q.label, p.dt, p.path, p.b, p.o FROM pairs q JOIN present p ON p.dataset = q.dataset AND p.scan = q.scan)
SELECT coalesce(x.dataset, y.dataset) AS dataset, coalesce(x.label, y.label) AS scan, coalesce(x.dt, y.dt) AS dt, coalesce(x.path, y.path) AS path,
CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'removed' ELSE 'changed' END AS op
FROM x FULL JOIN y ON x.dataset = y.dataset AND x.label = y.label AND x.dt = y.dt AND x.path = y.path WHERE x.path IS NULL OR y.path IS NULL OR x.b <> y.b OR x.o <> y.o""",
}

"""Queries of the observation axis (M), its joins (J) and the spatial operators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.operators import archives, build, geo, scans, treediff
from binstrata.operators.consolidate import Archives
from binstrata.operators.diffindex import DiffIndex
from binstrata.plans import cover
from binstrata.plans import geo_cover as g
from binstrata.plans.spec import PyramidSpec, Tier
from binstrata.queries.common import EVENT_MS, EVENTS, Book, sql_floor
from binstrata.queries.data_ops import _CATALOG
from binstrata.session import Scratch, table
from binstrata.sources.store import VersionedStore

book = Book()
KEYS, STATES = ["k"], ["size", "n"]
N = 6

# six scans of the customers, by arithmetic: some absent, some drifting, `seen` always changing
SCANS_SQL = "SELECT c_custkey AS k, CAST(j AS BIGINT) AS scan, CAST((c_custkey % 10) * 10 + CASE WHEN (c_custkey * (j + 1)) % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, CAST(1 + c_custkey % 3 AS BIGINT) AS n, CAST(j * 100 + c_custkey % 7 AS BIGINT) AS seen FROM customer, (SELECT UNNEST(range(0, 6)) AS j) WHERE (c_custkey + 3 * j) % 7 <> 0"


def one_scan(spark, d, j):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    size = F.pmod("k", F.lit(10)) * 10 + F.when(F.pmod(F.col("k") * (j + 1), F.lit(5)) == 0, 1).otherwise(0)
    return c.where(F.pmod(F.col("k") + 3 * j, F.lit(7)) != 0).select("k", size.cast("long").alias("size"), (F.pmod("k", F.lit(3)) + 1).cast("long").alias("n"), (F.pmod("k", F.lit(7)) + j * 100).cast("long").alias("seen"))


def long_scans(spark, d):
    return scans.union_scans([one_scan(spark, d, j) for j in range(N)])


def intervals(spark, d):
    return scans.islands(scans.unique_per_scan(long_scans(spark, d), KEYS), KEYS, STATES, carried_last=["seen"])


ISLANDS_SQL = f"s AS ({SCANS_SQL}), m AS (SELECT *, CASE WHEN lag(scan) OVER w = scan - 1 AND lag(size) OVER w = size AND lag(n) OVER w = n THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY k ORDER BY scan)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY scan ROWS UNBOUNDED PRECEDING) AS run FROM m), i AS (SELECT k, min(size) AS size, min(n) AS n, max(seen) AS seen, min(scan) AS lo, max(scan) AS hi FROM r GROUP BY k, run)"
CHANGE = lambda a, b: f"SELECT coalesce(x.k, y.k) AS k, coalesce(x.size, 0) AS size__a, coalesce(y.size, 0) AS size__b, coalesce(x.n, 0) AS n__a, coalesce(y.n, 0) AS n__b FROM (SELECT * FROM s WHERE scan = {a}) x FULL JOIN (SELECT * FROM s WHERE scan = {b}) y USING (k) WHERE coalesce(x.size, 0) <> coalesce(y.size, 0) OR coalesce(x.n, 0) <> coalesce(y.n, 0)"


@book.add("M1_union_scans", SCANS_SQL.replace("AS scan", "AS __scan"))
def m1(spark, d):
    return long_scans(spark, d)


@book.add("M2_islands", f"WITH {ISLANDS_SQL} SELECT k, size, n, seen, lo AS __scan_lo, hi AS __scan_hi FROM i")
def m2(spark, d):
    """Validity intervals with a carried column."""
    return intervals(spark, d)


@book.add("M5_densify", f"WITH s AS ({SCANS_SQL}), k AS (SELECT DISTINCT k FROM s) SELECT k.k, coalesce(s.size, 0) AS size, coalesce(s.n, 0) AS n, CAST(j AS BIGINT) AS __scan FROM k CROSS JOIN (SELECT UNNEST(range(0, 6)) AS j) LEFT JOIN s ON s.k = k.k AND s.scan = j")
def m5(spark, d):
    return scans.densify(long_scans(spark, d), KEYS, STATES, N)


@book.add("M6_extract_scan", f"WITH s AS ({SCANS_SQL}) SELECT k, size, n FROM s WHERE scan = 3")
def m6(spark, d):
    """One scan out of the intervals."""
    return scans.extract(intervals(spark, d).drop("seen"), STATES, 3)


# a string as JSON in ASCII, and the digest of a scan's rows in order
_JSON = r"""'"' || array_to_string(list_transform(string_split(path, ''), lambda c: CASE WHEN c = '"' OR c = '\' THEN '\' || c WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(12) THEN '\f' WHEN c = chr(8) THEN '\b'
WHEN length(c) = 1 AND unicode(c) BETWEEN 32 AND 126 THEN c ELSE array_to_string(list_transform(string_split(c, ''), lambda x: CASE WHEN unicode(x) > 65535 THEN '\u' || printf('%04x', 55296 + (unicode(x) - 65536) // 1024) || '\u' || printf('%04x', 56320 + (unicode(x) - 65536) % 1024) ELSE '\u' || printf('%04x', unicode(x)) END), '') END), '') || '"'"""
_RECORD = """(l.digests ->> ('$."' || l.label || '"'))"""
_DIGESTS = f"""WITH arch AS (SELECT dataset, key, encoder, scans, digests FROM (SELECT *, row_number() OVER (PARTITION BY dataset, key ORDER BY written_at DESC NULLS LAST) AS rn FROM pyramid_multiscans WHERE key IS NOT NULL) WHERE rn = 1),
listed AS (SELECT dataset, key, encoder, digests, UNNEST(from_json(scans, '["VARCHAR"]')) AS label, UNNEST(range(0, CAST(json_array_length(scans) AS BIGINT))) AS scan FROM arch),
held AS (SELECT a.dataset, a.key, i.dt, i.path, coalesce(i.b, 0) AS b, coalesce(i.o, 0) AS o, coalesce(i.__scan, i.__scan_lo) AS lo, least(coalesce(i.__scan, i.__scan_hi), CAST(json_array_length(a.scans) AS BIGINT) - 1) AS hi FROM intervals i JOIN arch a ON a.key = i.key),
present AS (SELECT DISTINCT dataset, key, dt, path, b, o, UNNEST(range(lo, hi + 1)) AS scan FROM held WHERE lo <= hi AND (b <> 0 OR o <> 0)),
made AS (SELECT dataset, key, scan, count(*) AS n, sha256(string_agg('[' || concat_ws(',', coalesce(dt, 0), {_JSON}, b, o) || ']' || chr(10), '' ORDER BY path NULLS FIRST, dt NULLS FIRST)) AS sha256,
CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws(chr(31), coalesce(CAST(dt AS VARCHAR), '\\N'), coalesce(path, '\\N'), CAST(b AS VARCHAR), CAST(o AS VARCHAR))), 1, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS DECIMAL(20, 0)) AS digest FROM present GROUP BY ALL)
SELECT l.dataset, l.key, l.encoder, l.label, coalesce(m.n, 0) AS n, coalesce(m.sha256, sha256('')) AS sha256, CAST(coalesce(m.digest, 0) AS VARCHAR) AS digest, {_RECORD} AS on_record, coalesce(m.sha256, sha256('')) = {_RECORD} AS same FROM listed l LEFT JOIN made m ON m.dataset = l.dataset AND m.key = l.key AND m.scan = l.scan"""


@book.add("M7_scan_digest", _DIGESTS)
def m7(spark, d):
    """Digests of every scan of every archive of the store, of both encoders, beside those on record. A scan
    without rows has the digest of nothing; repeated rows count once."""
    newest = F.max_by(F.struct("encoder", "scans", "digests"), F.coalesce(F.unix_micros("written_at"), F.lit(-(1 << 62)))).alias("m")
    archives = table(spark, d, "pyramid_multiscans").where("key IS NOT NULL").groupBy("dataset", "key").agg(newest).select("dataset", "key", "m.*")
    labels, record = F.from_json("scans", "array<string>"), F.from_json("digests", "map<string,string>")
    listed = archives.select("dataset", "key", "encoder", F.posexplode(labels).alias("scan", "label"), record.alias("r"))
    listed = listed.select("dataset", "key", "encoder", F.col("scan").cast("long").alias("scan"), "label", F.try_element_at("r", F.col("label")).alias("on_record"))
    span = archives.select("dataset", F.col("key").alias("k"), (F.size(labels) - 1).cast("long").alias("top"))
    iv = table(spark, d, "intervals")
    lo, hi = F.coalesce("__scan", "__scan_lo"), F.least(F.coalesce("__scan", "__scan_hi"), F.col("top"))
    held = iv.join(span, iv["key"] == span["k"]).where(lo <= hi)
    rows = held.select("dataset", "key", "dt", "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("b", "o")], F.explode(F.sequence(lo, hi)).alias("scan")).distinct()
    made = scans.scan_digests(rows, ["dataset", "key", "scan"])
    made = made.withColumnsRenamed({c: f"m_{c}" for c in made.columns})
    both = listed.join(made, listed["dataset"].eqNullSafe(F.col("m_dataset")) & (listed["key"] == F.col("m_key")) & (listed["scan"] == F.col("m_scan")), "left")
    n = F.coalesce("m_n", F.lit(0).cast("long"))
    sha = F.when(n == 0, F.sha2(F.lit(""), 256)).otherwise(F.col("m_sha256"))
    return both.select("dataset", "key", "encoder", "label", n.alias("n"), sha.alias("sha256"), F.coalesce("m_digest", F.lit(0).cast("decimal(20,0)")).cast("string").alias("digest"), "on_record", (sha == F.col("on_record")).alias("same"))


@book.add("M8_diff_tables", f"WITH s AS ({SCANS_SQL}) {CHANGE(1, 4)}")
def m8(spark, d):
    """Changeset of two scans."""
    return scans.diff_tables(one_scan(spark, d, 1), one_scan(spark, d, 4), KEYS, STATES)


@book.add("M9_diff_scans", f"WITH s AS ({SCANS_SQL}) {CHANGE(0, 5)}")
def m9(spark, d):
    """The same from intervals, without a join."""
    return scans.diff_scans(intervals(spark, d), KEYS, STATES, 0, 5)


@book.add("M10_series", f"WITH s AS ({SCANS_SQL}), k AS (SELECT 42 AS k), l AS (SELECT UNNEST(range(0, 6)) AS j) SELECT 's' || j AS label, coalesce(size, 0) AS size, coalesce(n, 0) AS n FROM l LEFT JOIN s ON s.scan = j AND s.k = 42")
def m10(spark, d):
    """One key over all scans."""
    labels = spark.createDataFrame([(j, f"s{j}") for j in range(N)], "scan bigint, label string")
    return scans.series(intervals(spark, d), STATES, labels, k=42)


_OBJECT = "(SELECT min(dataset) FROM pyramid_multiscans)"
_PATH = f"(SELECT min(i.path) FROM intervals i JOIN pyramid_multiscans m ON m.key = i.key WHERE m.dataset = {_OBJECT} AND i.dt = 0)"


@book.add("M11_series_across_archives", f"WITH {_CATALOG}, l AS (SELECT label, scan FROM owned WHERE dataset = {_OBJECT}), p AS (SELECT DISTINCT scan, b, o FROM present WHERE dataset = {_OBJECT} AND dt = 0 AND path = {_PATH}) SELECT label, coalesce(b, 0) AS b, coalesce(o, 0) AS o FROM l LEFT JOIN p USING (scan)")
def m11(spark, d):
    """One object over all archives of its dataset."""
    ms, iv = table(spark, d, "pyramid_multiscans"), table(spark, d, "intervals")
    first = ms.agg(F.min("dataset")).first()[0]
    keys = ms.where(F.col("dataset") == first).select("key").distinct()
    path = iv.where("dt = 0").join(keys, "key", "left_semi").agg(F.min("path")).first()[0]
    return archives.object_series(iv, ms, first, 0, path)


@book.add("M26_sealed_archives", f"WITH s AS ({SCANS_SQL}) SELECT k, size, n FROM s WHERE scan = 4")
def m26(spark, d):
    """Six scans sealed into archives of two, each verified, then one read back."""
    a = Archives(VersionedStore(spark, Scratch(spark, "archives").root), KEYS, STATES)
    labels, rows = [f"s{j}" for j in range(N)], [one_scan(spark, d, j) for j in range(N)]
    a.seal(labels, rows, size=2)
    if a.seal(labels, rows, size=2) or not all(a.verified(lab, r) for lab, r in zip(labels, rows)):
        raise AssertionError("sealed twice or not verified")
    return a.scan("s4")


STAMPS = [100, 200, 300, 400, 500, 600]


def _stamp(c):
    return f"(CASE WHEN {c} > 5 THEN 4611686018427387904 ELSE ({c} + 1) * 100 END)"


STAMPED_SQL = f"{ISLANDS_SQL}, t AS (SELECT k, size, n, seen, {_stamp('lo')} AS vf, {_stamp('hi + 1')} AS vt FROM i)"


@book.add("M12_stamped", f"WITH {STAMPED_SQL} SELECT * FROM t")
def m12(spark, d):
    return scans.stamped(intervals(spark, d), STAMPS)


@book.add("M13_point_in_time", f"WITH {STAMPED_SQL} SELECT * FROM t WHERE vf <= 350 AND vt > 350")
def m13(spark, d):
    return scans.as_of(scans.stamped(intervals(spark, d), STAMPS), 350)


@book.add("M14_append_scans", f"WITH {STAMPED_SQL} SELECT * FROM t")
def m14(spark, d):
    """Scans appended one by one to a versioned table, one of them twice: the same as consolidating all
    (M14, J2, J3, J4, F13)."""
    t = scans.IntervalTable(VersionedStore(spark, Scratch(spark, "runs").root), KEYS, STATES, ["seen"])
    for j in range(N):
        t.append(one_scan(spark, d, j), STAMPS[j])
    t.append(one_scan(spark, d, N - 1), STAMPS[N - 1])
    return t.rows().select("k", "size", "n", "seen", "vf", "vt")


@book.add("M15_delta", f"WITH {STAMPED_SQL} SELECT k, size, n, vf, vt, CAST(1 AS TINYINT) AS op FROM t WHERE vf = 400 UNION ALL SELECT k, size, n, vf, vt, CAST(-1 AS TINYINT) FROM t WHERE vt = 400")
def m15(spark, d):
    return scans.delta(scans.stamped(intervals(spark, d), STAMPS).drop("seen"), 400)


@book.add("M16_interval_digests", f"WITH {STAMPED_SQL}, e AS (SELECT vf AS stamp, 1 AS op, k, size, n FROM t UNION ALL SELECT vt, -1, k, size, n FROM t WHERE vt < 4611686018427387904) SELECT stamp, op, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws(chr(31), CAST(k AS VARCHAR), CAST(size AS VARCHAR), CAST(n AS VARCHAR))), 1, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS digest FROM e GROUP BY stamp, op")
def m16(spark, d):
    return scans.interval_digests(scans.stamped(intervals(spark, d), STAMPS), ["k", "size", "n"]).withColumn("digest", F.col("digest").cast("string"))


@book.add("M17_merge_runs", "SELECT k, max(size) AS size FROM (SELECT c_custkey AS k, c_custkey % 10 AS size FROM customer UNION ALL SELECT c_custkey, c_custkey % 13 FROM customer WHERE c_custkey % 2 = 0) GROUP BY k")
def m17(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    runs = [c.withColumn("size", F.pmod("k", F.lit(10))), c.where("k % 2 = 0").withColumn("size", F.pmod("k", F.lit(13)))]
    return scans.merge_runs(runs, ["k"], "minmax", high=["size"])


@book.add("M20_compose_changesets", f"WITH s AS ({SCANS_SQL}) {CHANGE(0, 5)}")
def m20(spark, d):
    """Five changesets composed: the same as the diff of the ends."""
    parts = [scans.diff_tables(one_scan(spark, d, j), one_scan(spark, d, j + 1), KEYS, STATES) for j in range(N - 1)]
    return scans.compose(parts, KEYS, STATES)


@book.add("M20_patch", f"WITH s AS ({SCANS_SQL}) SELECT k, size, n FROM s WHERE scan = 5")
def m20_patch(spark, d):
    """A changeset applied to the scan it starts from."""
    change = scans.diff_tables(one_scan(spark, d, 0), one_scan(spark, d, 5), KEYS, STATES)
    return scans.patch(one_scan(spark, d, 0), change, KEYS, STATES)


@book.add("M21_dyadic_blocks", "SELECT * FROM (VALUES (3, 1), (4, 4), (8, 8), (16, 4), (20, 1)) t(start, size)")
def m21(spark, d):
    """Aligned blocks of a span."""
    return spark.createDataFrame(cover.dyadic_blocks(3, 21), "start int, size int")


@book.add("M22_diff_index", f"WITH s AS ({SCANS_SQL}) {CHANGE(1, 5)}")
def m22(spark, d):
    """A diff from persisted nodes."""
    index = DiffIndex(VersionedStore(spark, Scratch(spark, "diffs").root), KEYS, STATES)
    for j in range(N - 1):
        index.append(scans.diff_tables(one_scan(spark, d, j), one_scan(spark, d, j + 1), KEYS, STATES), at=j)
    index.append(scans.diff_tables(one_scan(spark, d, 0), one_scan(spark, d, 1), KEYS, STATES), at=0)  # again: no effect
    return index.diff(1, 5)


@book.add("M27_resolve_scans", """WITH a AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY dataset, key ORDER BY written_at DESC NULLS LAST) rn FROM pyramid_multiscans) WHERE rn = 1),
l AS (SELECT dataset, key, written_at, encoder, UNNEST(from_json(scans, '["VARCHAR"]')) AS label, UNNEST(range(0, CAST(json_array_length(scans) AS BIGINT))) AS idx FROM a)
SELECT dataset, label, key, CAST(idx AS INT) AS idx, encoder, CAST(row_number() OVER (PARTITION BY dataset ORDER BY label) AS INT) AS scan FROM (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY written_at DESC NULLS LAST, key DESC, idx DESC) rn FROM l) WHERE rn = 1""")
def m27(spark, d):
    """The archive that each scan is read from."""
    return archives.scan_catalog(table(spark, d, "pyramid_multiscans"))


# -- trees ------------------------------------------------------------------------------------------

_LEAVES = "SELECT substr(p_type, 1, 4) || '/' || p_brand || '/s' || (p_size % 10) || '/' || p_partkey AS path, CAST(p_size AS BIGINT) AS size, CAST(1 AS BIGINT) AS n FROM part"


def tree(spark, d, later: bool):
    p = table(spark, d, "part")
    path = F.concat_ws("/", F.substring("p_type", 1, 4), F.col("p_brand"), F.concat(F.lit("s"), F.col("p_size") % 10), F.col("p_partkey").cast("string"))
    size = F.col("p_size").cast("long")
    rows = p.select("p_partkey", path.alias("path"), size.alias("size"), F.lit(1).cast("long").alias("n"))
    if later:
        rows = rows.where("p_partkey % 11 <> 0").withColumn("size", F.when(F.col("p_partkey") % 5 == 0, F.col("size") + 7).otherwise(F.col("size")))
    else:
        rows = rows.where("p_partkey % 13 <> 0")
    return treediff.rollup(rows.drop("p_partkey"))


def _tree_sql(later: bool) -> str:
    size = "size + CASE WHEN id % 5 = 0 THEN 7 ELSE 0 END" if later else "size"
    keep = "id % 11 <> 0" if later else "id % 13 <> 0"
    return f"(SELECT array_to_string(list_slice(ps, 1, l), '/') AS path, l AS depth, CAST(sum({size}) AS BIGINT) AS size, count(*) AS n FROM (SELECT string_split(path, '/') AS ps, size, CAST(string_split(path, '/')[4] AS BIGINT) AS id FROM ({_LEAVES})), (SELECT UNNEST(range(0, 5)) AS l) WHERE {keep} GROUP BY ALL)"


_TREE_DIFF = f"WITH a AS {_tree_sql(False)}, b AS {_tree_sql(True)}, diff AS (SELECT coalesce(a.path, b.path) AS path, CAST(coalesce(a.depth, b.depth) AS INT) AS depth, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS status, coalesce(a.size, 0) AS size_a, coalesce(b.size, 0) AS size_b, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.n <> b.n)"


@book.add("M28_tree_diff", f"{_TREE_DIFF} SELECT * FROM diff")
def m28(spark, d):
    """Two snapshots of a tree, all nodes that differ."""
    return treediff.materialize(tree(spark, d, False), tree(spark, d, True))


@book.add("M29_slice_view", f"{_TREE_DIFF} SELECT * FROM diff WHERE (path = 'STAN' OR starts_with(path, 'STAN/')) AND greatest(size_a, size_b) >= 20 AND NOT EXISTS (SELECT 1 FROM diff u WHERE u.status <> 'changed' AND starts_with(diff.path, u.path || '/'))")
def m29(spark, d):
    return treediff.slice_view(treediff.materialize(tree(spark, d, False), tree(spark, d, True)), "STAN", 20)


@book.add("M30_walk_diff", f"{_TREE_DIFF} SELECT *, status = 'changed' AND greatest(size_a, size_b) >= 30 AS expanded, status = 'changed' AND greatest(size_a, size_b) < 30 AS pruned FROM diff x WHERE (SELECT count(*) FROM diff u WHERE u.status = 'changed' AND greatest(u.size_a, u.size_b) >= 30 AND u.depth < x.depth AND (u.path = '' OR starts_with(x.path, u.path || '/'))) = x.depth")
def m30(spark, d):
    """Descent level by level into what changed and is large enough."""
    return treediff.walk(tree(spark, d, False), tree(spark, d, True), Scratch(spark, "walk"), floor=treediff.render_floor(30 * 100 * 100, 100, 100, 1))


@book.add("M33_synthetic_churn", "SELECT UNNEST(['densify', 'interval']) AS encoder, j AS scan, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT k, j, (k * 31) % 997 + (SELECT count(*) FROM (SELECT UNNEST(range(1, j + 1)) AS i) WHERE (k * 7919 + i * 104729) % 10000 < 500) AS v FROM (SELECT UNNEST(range(0, 2000)) AS k), (SELECT UNNEST(range(0, 10)) AS j)) GROUP BY j")
def m33(spark, d):
    """Generated scans of given size and churn, consolidated by both encoders and read back by scan."""
    long = scans.synthetic_scans(spark, 2000, 10, 0.05)
    runs = scans.islands(long, ["k"], ["v"]).select("v", F.explode(F.sequence("__scan_lo", "__scan_hi")).alias("scan"), F.lit("interval").alias("encoder"))
    dense = scans.densify(long, ["k"], ["v"], 10).select("v", F.col("__scan").alias("scan"), F.lit("densify").alias("encoder"))
    return runs.unionByName(dense).groupBy("encoder", "scan").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


# -- joins ------------------------------------------------------------------------------------------


@book.add("J7_as_of_join", f"WITH s AS ({SCANS_SQL}), {ISLANDS_SQL.replace('s AS (' + SCANS_SQL + '), ', '')}, o AS (SELECT o_orderkey, o_custkey AS k, CAST(o_orderkey % 6 AS BIGINT) AS at FROM orders) SELECT o.o_orderkey, o.k, o.at, i.size, i.n FROM o LEFT JOIN i ON i.k = o.k AND o.at BETWEEN i.lo AND i.hi")
def j7(spark, d):
    """Each order with the state its customer had at its instant."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("k"), F.pmod("o_orderkey", F.lit(6)).cast("long").alias("at"))
    runs = intervals(spark, d).select("k", "size", "n", F.col("__scan_lo").alias("vf"), (F.col("__scan_hi") + 1).alias("vt"))
    return scans.as_of_join(o, runs, KEYS, "at", 4).drop("vf", "vt")


# -- space ------------------------------------------------------------------------------------------

LEVEL = 10


def placed(spark, d):
    """Customers at places given by arithmetic."""
    c = table(spark, d, "customer").select("c_custkey", (F.pmod(F.col("c_custkey") * 37, F.lit(1700)) / 10.0 - 85).alias("lat"), (F.pmod(F.col("c_custkey") * 101, F.lit(3600)) / 10.0 - 180).alias("lng"))
    return c.withColumn("cell", geo.cell_at("lat", "lng", LEVEL))


def built(spark, d):
    """Cells by bit arithmetic: face, ten digits of position, marker."""
    c = table(spark, d, "customer").select("c_custkey", (F.pmod(F.col("c_custkey") * 7919, F.lit(6 << 20))).alias("p"))
    return c.select("c_custkey", (F.shiftleft(F.col("p").cast("long"), 41).bitwiseOR(F.lit(1 << 40))).alias("cell"))


_BUILT = "c AS (SELECT c_custkey, (CAST(c_custkey AS UHUGEINT) * 7919) % 6291456 AS p FROM customer)"


@book.add("G1_cell_of_point")
def g1(spark, d):
    """Cells of points with their level, token and parent (G1; checked against the cells' corners in tests)."""
    return placed(spark, d).select("c_custkey", "cell", geo.level_of("cell").alias("level"), geo.to_token("cell").alias("token"))


@book.add("G2_levels_parents_tokens", f"WITH {_BUILT} SELECT c_custkey, 10 AS level, rtrim(lpad(printf('%x', CAST(p * 2199023255552 + 1099511627776 AS UBIGINT)), 16, '0'), '0') AS token, rtrim(lpad(printf('%x', CAST((p // 4096) * 9007199254740992 + 4503599627370496 AS UBIGINT)), 16, '0'), '0') AS parent4, true AS round_trip FROM c")
def g2(spark, d):
    """Level, token, ancestor and the way back."""
    b = built(spark, d)
    return b.select("c_custkey", geo.level_of("cell").alias("level"), geo.to_token("cell").alias("token"), geo.to_token(geo.parent("cell", 4)).alias("parent4"), (geo.from_token(geo.to_token("cell")) == F.col("cell")).alias("round_trip"))


@book.add("G5_ranges_merged", f"WITH {_BUILT}, r AS (SELECT DISTINCT CAST(p // 16 AS BIGINT) AS q FROM c), i AS (SELECT q, CASE WHEN lag(q) OVER (ORDER BY q) = q - 1 THEN 0 ELSE 1 END AS s FROM r), n AS (SELECT *, sum(s) OVER (ORDER BY q ROWS UNBOUNDED PRECEDING) AS k FROM i) SELECT CAST(min(q) AS BIGINT) AS lo, CAST(max(q) AS BIGINT) AS hi FROM n GROUP BY k")
def g5(spark, d):
    """Descendant ranges of all cells' ancestors, merged (G5, G6, G8), as positions of level 8."""
    b = built(spark, d).select(geo.descendants(geo.parent("cell", 8), 30).alias("r")).select(F.lit(0).alias("one"), "r.*").distinct()
    # neighbours differ by the gap of one leaf id, so ranges are widened by it before they are merged; downwards,
    # as the last leaf of face 3 is the greatest bigint, while leaf ids are odd and so never the least
    m = geo.merge_ranges(b.withColumn("lo", F.col("lo") - 1), ("one",))
    return m.select(F.shiftrightunsigned("lo", 45).alias("lo"), F.shiftrightunsigned("hi", 45).alias("hi"))


@book.add("G7_range_join", f"WITH {_BUILT} SELECT c_custkey FROM c WHERE (p BETWEEN 1000000 AND 1500000) OR (p BETWEEN 4000000 AND 4200000)")
def g7(spark, d):
    """Cells within intersected ranges, across the sign of bigint."""
    leaf = lambda p, up: (p << 41) + ((1 << 41) - 1 if up else 0)
    a = [(leaf(1000000, False), leaf(1500000, True)), (leaf(3900000, False), leaf(4300000, True))]
    b = [(0, leaf(2000000, True)), (leaf(4000000, False), leaf(4200000, True))]
    return geo.where_ranges(built(spark, d), "cell", g.intersect_ranges(a, b)).select("c_custkey")


@book.add("G9_multi_resolution", f"WITH {_BUILT} SELECT CAST(l AS INT) AS level, CAST(p AS BIGINT) // CAST(4 ** (10 - l) AS BIGINT) AS pos, count(*) AS n FROM c, (VALUES (2), (5), (8)) t(l) GROUP BY ALL")
def g9(spark, d):
    """Counts at three resolutions from one pass."""
    rows = geo.at_levels(built(spark, d), "cell", [2, 5, 8])
    pos = F.expr("CAST(NULL AS BIGINT)")
    for k in (2, 5, 8):
        pos = F.when(geo.level_of("cell") == k, F.shiftrightunsigned("cell", 61 - 2 * k)).otherwise(pos)
    return rows.groupBy(geo.level_of("cell").alias("level"), pos.alias("pos")).agg(F.count(F.lit(1)).alias("n"))


BOX = g.BBox(40.0, -20.0, 60.0, 30.0)


@book.add("G10_box_query", "SELECT c_custkey FROM (SELECT c_custkey, (c_custkey * 37) % 1700 / 10.0 - 85 AS lat, (c_custkey * 101) % 3600 / 10.0 - 180 AS lng FROM customer) WHERE lat BETWEEN 40 AND 60 AND lng BETWEEN -20 AND 30")
def g10(spark, d):
    """Points of a box: by the cells that cover it, then exactly."""
    level, cells = g.pick_resolution(BOX, [8, 6, 5, 4, 3], 256)
    p = placed(spark, d).withColumn("up", geo.parent("cell", level))
    near = geo.where_cells(p, "up", level, cells)
    return near.where(F.col("lat").between(40, 60) & F.col("lng").between(-20, 30)).select("c_custkey")


@book.add("G14_cover_filter", f"WITH {_BUILT} SELECT c_custkey FROM c WHERE p // 1048576 IN (0, 4) AND p // 65536 NOT IN (3, 70) OR p // 4096 = 50")
def g14(spark, d):
    """Rows under a ± cover: the nearest term decides."""
    cell = lambda pos, level: (pos << (61 - 2 * level)) | g.lsb(level)
    include = [cell(0, 0), cell(4, 0), cell(50, 4)]
    exclude = [cell(3, 2), cell(70, 2)]
    return geo.where_cover(built(spark, d), "cell", include, exclude).select("c_custkey")


@book.add("G15_minimal_cover", f"WITH {_BUILT} SELECT c_custkey FROM c WHERE p // 262144 IN (1, 2) OR p % 64 = 0")
def g15(spark, d):
    """A least ± cover of chosen cells, applied to the rows."""
    b = built(spark, d)
    pos = F.shiftrightunsigned("cell", 41)
    want = (F.floor(pos / 262144).isin(1, 2)) | (F.pmod(pos, F.lit(64)) == 0)
    terms = geo.cover_terms(b.select("cell", want.alias("w")), "cell", "w", Scratch(spark, "cover"))
    return geo.where_terms(b, "cell", terms).select("c_custkey")


@book.add("G16_vocabulary_cover", "SELECT * FROM (VALUES ('+', '1'), ('-', 's3')) t(op, term)")
def g16(spark, d):
    """Terms of a stored vocabulary that select given places."""
    face = 0 << 61 | g.lsb(0)
    kids = g.children(face)
    leaves = {f"s{k}": g.children(kids[k % 4])[k // 4] for k in range(12)}
    inc, exc = g.vocabulary_cover(g.vocabulary_forest([face], leaves), [k for k in leaves if k != "s3"])
    rows = [("+", g.to_token(t) if isinstance(t, int) else t) for t in inc] + [("-", t) for t in exc]
    return spark.createDataFrame(rows, "op string, term string")


@book.add("G17_geo_pyramid_query", f"SELECT {sql_floor(EVENT_MS, '1d')} AS dt, CAST((user_id * 7919 % 6291456) // 65536 AS BIGINT) AS pos, count(*) AS n FROM events WHERE (user_id * 7919 % 6291456) // 65536 IN (5, 6, 7, 60) AND {sql_floor(EVENT_MS, '1d')} BETWEEN 1704412800000 AND 1704931200000 GROUP BY ALL")
def g17(spark, d):
    """A pyramid with cells as a dimension at two resolutions, queried by cells of one."""
    spec = PyramidSpec("geo", (Tier("h", "1h", ("1d",)), Tier("d", "1d", ("4d",))), ("cell",), EVENTS.metrics[:1], bin_col="dt", geo={"resolutions": [2, 1]})
    e = table(spark, d, "events")
    p = F.pmod(F.col("user_id") * 7919, F.lit(6 << 20)).cast("long")
    rows = geo.at_levels(e.withColumn("cell", F.shiftleft(p, 41).bitwiseOR(F.lit(1 << 40))), "cell", [2, 1])
    tiers = build.cascade(build.from_raw(rows, spec, ta.ms_of("ts"), {"n": F.lit(1)}), spec)
    cells = [(k << 57) | g.lsb(2) for k in (5, 6, 7, 60)]
    df, _ = geo.query_box(tiers, spec, "cell", 1704412800000, 1704412800000 + 7 * ta.DAY, cells=cells, bin_budget=10)
    return df.select("dt", F.shiftrightunsigned("cell", 57).alias("pos"), "n")


QUERIES, SQL = book.queries, book.sql

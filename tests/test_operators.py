"""Laws of aggregation, serving, scans, diff index, tree diffs and streams on small fixtures."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from binstrata.functions import monoids as mo
from binstrata.functions import timeaxis as ta
from binstrata.operators import build, inventory, scans, serve, treediff
from binstrata.operators.diffindex import DiffIndex
from binstrata.plans import planner
from binstrata.plans.spec import PyramidSpec, Tier
from binstrata.sources.shards import Registry, content_key, tiled_source, widest_present
from binstrata.sources.store import VersionedStore
from binstrata.streaming import tip

T = ta.to_ms(datetime(2026, 1, 2))
SPEC = PyramidSpec("p", (Tier("q", "15min", ("6h", "1d")), Tier("h", "1h", ("1d", "4d")), Tier("d", "1d", ("4d",))), ("cell",), (mo.Metric("bikes", "histogram"), mo.Metric("rides", "count"), mo.Metric("temp", "sum")), bin_col="dt")


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(1)
    rows = [(T + rng.randrange(0, 4 * 96) * 15 * ta.MINUTE + rng.randrange(0, 900_000), rng.choice(["a", "b", None]), rng.choice(["x", "10", "9", None]), rng.choice([None, float(rng.randrange(-50, 50))])) for _ in range(2000)]
    return spark.createDataFrame(rows + [(None, "a", "x", 1.0)], "ms bigint, cell string, cat string, v double")


@pytest.fixture(scope="module")
def base(raw):
    return build.from_raw(raw, SPEC, F.col("ms"), {"bikes": F.col("cat"), "rides": F.lit(1), "temp": F.col("v")}).cache()


def plain(df):
    out = []
    for r in df.collect():
        d = r.asDict()
        out.append(tuple((k, tuple(sorted(v.items())) if isinstance(v, dict) else v) for k, v in sorted(d.items())))
    return sorted(out, key=repr)


def test_cascade_equals_direct_aggregation(raw, base):
    tiers = build.cascade(base, SPEC)
    for name, bin_ in (("h", "1h"), ("d", "1d")):
        direct = build.from_raw(raw, SPEC, F.col("ms"), {"bikes": F.col("cat"), "rides": F.lit(1), "temp": F.col("v")}, bin_)
        # groups of nothing but null categories have an empty histogram, or none once merged
        strip = lambda rows: [tuple((k, v or ()) if k == "bikes" else (k, v) for k, v in r) for r in rows]
        assert strip(plain(tiers[name])) == strip(plain(direct))


def test_results_do_not_depend_on_the_plan(base):
    tiers = build.cascade(base, SPEC)
    lo, hi = T, T + 4 * ta.DAY
    day = ta.floor(T, "4d")
    want = plain(serve.query(tiers, SPEC, lo, hi, bin_budget=4)[0].drop("bikes"))
    for marks in ({"d@4d": day + 4 * ta.DAY}, {"h@4d": day, "d@4d": day}, {"h@1d": T + ta.DAY}):
        df, meta = serve.query(tiers, SPEC, lo, hi, bin_budget=4, watermarks=marks)
        assert plain(df.drop("bikes")) == want and meta["outputTier"] == "d"
    df, _ = serve.query(tiers, SPEC, lo, hi, {"cell": "a"}, bin_budget=4)
    assert {r.cell for r in df.collect()} == {"a"}
    assert serve.query(tiers, SPEC, lo, hi, {"cell": []}, bin_budget=4)[0].count() == 0
    plan = planner.plan_from_inventory(SPEC, lo, hi, [], 4)
    assert serve.execute(tiers, SPEC, plan).count() == 0


def test_write_prune_and_read(spark, base, scratch):
    build.build(base, SPEC, scratch.root, T, T + 4 * ta.DAY)
    tiers = serve.reader(spark, SPEC, scratch.root, base.schema)
    df, _ = serve.query(tiers, SPEC, T, T + ta.DAY, bin_budget=1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "period" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert plain(df.drop("bikes")) == plain(serve.query(build.cascade(base, SPEC), SPEC, T, T + ta.DAY, bin_budget=1)[0].drop("bikes"))
    with pytest.raises(build.EmptySourceError):
        build.build(base.where("false"), SPEC, scratch.root, T, T + ta.DAY, min_rows=1)


def test_long_and_back(base):
    wide = build.rebin(base, SPEC, "1h")
    back = build.to_wide(build.to_long(wide, SPEC), SPEC)
    drop = lambda rows: [tuple((k, v or ()) if k == "bikes" else (k, v) for k, v in r) for r in rows]
    assert drop(plain(back)) == drop(plain(wide))


def test_canonical_histograms(spark):
    df = spark.createDataFrame([({"10": 1, "9": 2, "-1": 3},), ({"b": 1, "10": 2},), ({},), (None,)], "h map<string,bigint>")
    assert [r[0] for r in df.select(mo.histogram_json("h")).collect()] == ['{"-1":3,"9":2,"10":1}', '{"10":2,"b":1}', "{}", None]


def test_histogram_of_nulls_and_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", None, 5), ("b", None, 1), (None, "y", 1)], "g string, c string, n int")
    got = {r.g: r.hist for r in mo.histogram(df, ["g"], "c", "n").collect()}
    assert got == {"a": {"x": 3}, "b": {}, None: {"y": 1}}


def test_digest_is_order_free(spark):
    df = spark.createDataFrame([(k, None if k % 3 else "v") for k in range(50)], "a int, b string")
    one, two = df.agg(*mo.digest(["a", "b"])).first(), df.orderBy(F.desc("a")).repartition(3).agg(*mo.digest(["a", "b"])).first()
    assert one == two and one.n == 50
    assert df.where("a < 0").agg(*mo.digest(["a"])).first().digest == 0


def test_finishers_and_registry(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "g string, v double")
    m = mo.MONOIDS["sum"]
    rows = {r.g: r for r in df.groupBy("g").agg(*m.from_raw("x", F.col("v"))).select("g", *[c.alias(n) for n, c in m.finish("x").items()]).collect()}
    assert (rows["a"].mean, rows["a"].var) == (2.0, 2.0) and rows["b"].var is None and rows["c"].mean is None
    with pytest.raises(ValueError):
        mo.register("sum", m)


def test_rollup_is_idempotent(spark, base):
    ids = spark.createDataFrame([("a", "one"), ("b", "one")], "raw string, canonical string")
    once = build.identity_rollup(base, SPEC, "cell", ids)
    twice = build.identity_rollup(once, SPEC, "cell", ids)
    assert plain(once) == plain(twice)
    leaves = once.where(~F.coalesce(F.col("cell").startswith("c:"), F.lit(False)))
    assert plain(leaves) == plain(base)


def test_compare_verdicts(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "n"), (4, "y"), (None, "z")], "k int, v string")
    assert {tuple(r) for r in build.compare(a, b, ["k"]).collect()} == {(2, "different"), (3, "only_a"), (4, "only_b")}


# -- scans ------------------------------------------------------------------------------------------


def random_scans(spark, seed, n=6):
    rng = random.Random(seed)
    state, out = {}, []
    for _ in range(n):
        for k in range(12):
            x = rng.random()
            if x < 0.2:
                state.pop(k, None)
            elif x < 0.5:
                state[k] = (rng.randrange(3), rng.choice([None, 1, 2]))
        out.append(dict(state))
    dfs = [spark.createDataFrame([(k, a, b, 100 * j + k) for k, (a, b) in s.items()], "k int, a int, b int, seen int") for j, s in enumerate(out)]
    return out, dfs


def present(s):
    return {k: (a or 0, b or 0) for k, (a, b) in s.items() if (a or 0, b or 0) != (0, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_algebra(spark, scratch, seed):
    truth, dfs = random_scans(spark, seed)
    runs = scans.islands(scans.union_scans(dfs), ["k"], ["a", "b"], carried_last=["seen"]).cache()
    for j, s in enumerate(truth):
        got = {r.k: (r.a or 0, r.b or 0) for r in scans.extract(runs, ["a", "b"], j).collect()}
        assert got == present(s)
    dense = scans.densify(scans.union_scans([d.fillna(0) for d in dfs]), ["k"], ["a", "b"], 6)
    assert dense.count() == 6 * len({k for s in truth for k in s})
    for i, j in ((0, 5), (2, 3), (4, 1), (3, 3)):
        x, y = present(truth[i]), present(truth[j])
        want = {(k, x.get(k, (0, 0)), y.get(k, (0, 0))) for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
        filled = [d.fillna(0) for d in dfs]
        sparse = scans.diff_scans(scans.islands(scans.union_scans(filled), ["k"], ["a", "b"]), ["k"], ["a", "b"], i, j)
        for diff in (sparse, scans.diff_tables(filled[i], filled[j], ["k"], ["a", "b"])):
            assert {(r.k, (r.a__a, r.b__a), (r.a__b, r.b__b)) for r in diff.collect()} == want
    stamps = [100 * (j + 1) for j in range(6)]
    whole = scans.stamped(runs, stamps)
    step = scans.stamped(scans.islands(scans.union_scans(dfs[:1]), ["k"], ["a", "b"], carried_last=["seen"]), stamps[:1])
    for j in range(1, 6):
        step = scans.append_scan(step, dfs[j], ["k"], ["a", "b"], stamps[j], ["seen"]).drop("change")
    cols = ["k", "a", "b", "seen", "vf", "vt"]
    assert sorted(map(tuple, step.select(cols).collect()), key=repr) == sorted(map(tuple, whole.select(cols).collect()), key=repr)
    table = scans.IntervalTable(VersionedStore(spark, f"{scratch.root}/runs"), ["k"], ["a", "b"], ["seen"])
    for j in range(6):
        assert table.append(dfs[j], stamps[j]) == j + 1
    assert table.append(dfs[5], stamps[5]) == 6  # a batch that comes again
    with pytest.raises(ValueError):
        table.append(dfs[0], stamps[0])
    for rows, n in ((table.rows(), 6), (table.rows(3), 3)):
        want = scans.stamped(scans.islands(scans.union_scans(dfs[:n]), ["k"], ["a", "b"], carried_last=["seen"]), stamps[:n])
        assert sorted(map(tuple, rows.select(cols).collect()), key=repr) == sorted(map(tuple, want.select(cols).collect()), key=repr)
    opened = scans.delta(whole, 300)
    assert {r.op for r in opened.collect()} <= {1, -1}


def test_compose_is_associative_and_cancels(spark):
    _, dfs = random_scans(spark, 3)
    dfs = [d.fillna(0) for d in dfs]
    c = [scans.diff_tables(dfs[j], dfs[j + 1], ["k"], ["a", "b"]) for j in range(4)]
    comp = lambda *x: scans.compose(list(x), ["k"], ["a", "b"])
    rows = lambda d: sorted(map(tuple, d.collect()))
    one, two = comp(comp(c[0], c[1]), comp(c[2], c[3])), comp(c[0], comp(c[1], comp(c[2], c[3])))
    assert rows(one) == rows(two) == rows(scans.diff_tables(dfs[0], dfs[4], ["k"], ["a", "b"]))
    back = scans.diff_tables(dfs[1], dfs[0], ["k"], ["a", "b"])
    assert comp(c[0], back).count() == 0


def test_diff_index(spark, store):
    _, dfs = random_scans(spark, 4)
    dfs = [d.fillna(0) for d in dfs]
    index = DiffIndex(store, ["k"], ["a", "b"])
    for j in range(5):
        index.append(scans.diff_tables(dfs[j], dfs[j + 1], ["k"], ["a", "b"]), at=j)
    assert index.append(dfs[0], at=2) == 2 and index.length() == 5
    with pytest.raises(ValueError):
        index.append(dfs[0], at=9)
    assert {(r.level, r.start) for r in index.entries().collect()} == {(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 2), (2, 0)}
    for i, j in ((0, 5), (1, 4), (2, 3)):
        assert sorted(map(tuple, index.diff(i, j).collect())) == sorted(map(tuple, scans.diff_tables(dfs[i], dfs[j], ["k"], ["a", "b"]).collect()))


def test_key_twice_in_a_scan_is_refused(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "k int, __scan int, a int")
    with pytest.raises(Exception, match="twice"):
        scans.unique_per_scan(df, ["k"]).collect()


def test_merge_policies(spark):
    a = spark.createDataFrame([(1, 5, 5, "x"), (2, 1, 1, "y")], "k int, lo int, hi int, t string")
    b = spark.createDataFrame([(1, 3, 9, "x"), (3, 0, 0, None)], "k int, lo int, hi int, t string")
    assert scans.merge_runs([a, b], ["k"]).count() == 4
    assert {tuple(r) for r in scans.merge_runs([a, b], ["k"], "minmax", ["lo"], ["hi"]).collect()} == {(1, 3, 9, "x"), (2, 1, 1, "y"), (3, 0, 0, None)}
    assert {tuple(r) for r in scans.merge_runs([a, b], ["k"], "newest").collect()} == {(1, 3, 9, "x"), (2, 1, 1, "y"), (3, 0, 0, None)}
    with pytest.raises(Exception, match="disagree"):
        scans.merge_runs([a, b.withColumn("t", F.lit("z"))], ["k"], "minmax", ["lo"], ["hi"]).collect()


def test_exact_digest_matches_the_documented_text(spark):
    import hashlib

    rows = [(0, 'b"c', 1, None), (5, "a", 2, 3), (0, "none", 0, 0)]
    got = scans.scan_digest(spark.createDataFrame(rows, "dt bigint, path string, b bigint, o bigint")).first()
    text = '[5,"a",2,3]\n[0,"b\\"c",1,0]\n'
    assert got.n == 2 and got.sha256 == hashlib.sha256(text.encode()).hexdigest()


# -- trees, inventory, sources, streams ---------------------------------------------------------------


def test_tree_walk_agrees_with_the_materialized_diff(spark, scratch):
    a = treediff.rollup(spark.createDataFrame([("r/a/1", 5, 1), ("r/a/2", 7, 1), ("r/b/1", 1, 1), ("s/x", 9, 1)], "path string, size bigint, n bigint"))
    b = treediff.rollup(spark.createDataFrame([("r/a/1", 5, 1), ("r/a/2", 8, 1), ("r/c/1", 1, 1), ("s/x", 9, 1)], "path string, size bigint, n bigint"))
    full = {r.path: r.status for r in treediff.materialize(a, b).collect()}
    assert full == {"": "changed", "r": "changed", "r/a": "changed", "r/a/2": "changed", "r/b": "removed", "r/b/1": "removed", "r/c": "added", "r/c/1": "added"}
    walked = {r.path: (r.expanded, r.pruned) for r in treediff.walk(a, b, scratch).collect()}
    assert walked == {"": (True, False), "r": (True, False), "r/a": (True, False), "r/a/2": (True, False), "r/b": (False, False), "r/c": (False, False)}
    pruned = {r.path for r in treediff.walk(a, b, scratch, floor=14).where("pruned").collect()}
    assert pruned == {"r/a"}  # 12 and 13; r has 13 and 14
    assert {r.path for r in treediff.slice_view(treediff.materialize(a, b), "r").collect()} == {"r", "r/a", "r/a/2", "r/b", "r/c"}
    assert {r.path for r in treediff.children(a, "r", 1).collect()} == {"r/a", "r/b"}
    assert treediff.walk(a, a, scratch).count() == 0


def test_collection_verdicts(spark):
    now, D = 100 * ta.DAY, ta.DAY
    schema = "tier string, shard_dur string, period_start bigint, period_end bigint, key string, written_at bigint"
    rows = [("q", "4d", 0, 4 * D, "parent", 0), ("q", "1d", 0, D, "inside", 0), ("q", "1d", 3 * D, 5 * D, "over", 0), ("h", "1d", 0, D, "other tier", 0), ("q", "1d", 99 * D, 101 * D, "future old", now - D), ("q", "1d", 99 * D, 101 * D, "future new", now), ("q", "1d", 99 * D, now - 1, "fresh", 0), ("q", "1d", 0, D, "raw/x", 0)]
    got = {r.key: r.verdict for r in inventory.collectable(spark.createDataFrame(rows, schema), spark.createDataFrame([("parent",)], "key string"), now, ["raw/"]).collect()}
    assert got == {"inside": "delete", "over": "no covering parent", "other tier": "no covering parent", "future old": "delete", "future new": "future period within grace", "fresh": "within grace"}
    budget = inventory.collectable(spark.createDataFrame(rows, schema), spark.createDataFrame([("parent",)], "key string"), now, ["raw/"], limit=1)
    assert {r.key: r.verdict for r in budget.collect()}["future old"] == "budget"


def test_registry_appends_and_keeps_the_newest(spark, store):
    r = Registry(store)
    row = lambda key, at, n=1: spark.createDataFrame([("p", "q", "1d", 0, 5, key, at, n)], Registry.SCHEMA)
    assert r.rows().count() == 0
    r.record(row("a", 1))
    r.record(row("b", 2, 0))
    assert [(x.key, x.n_rows) for x in r.rows().collect()] == [("b", 0)]
    r.compact()
    assert r.rows().count() == 1 and len(store.meta()["paths"]) == 1


def test_sources(spark, scratch):
    df, missing = tiled_source(spark, scratch.root, "1d", spark.range(1).schema, 0, 2 * ta.DAY)
    assert df.count() == 0 and missing == ["1970-01-01", "1970-01-02"]
    picks, holes = widest_present(("1d", "4d"), 0, 8 * ta.DAY, lambda s, a: s == "4d" and a == 0 or s == "1d" and a == 5 * ta.DAY)
    assert picks == [("4d", 0, 4 * ta.DAY), ("1d", 5 * ta.DAY, 6 * ta.DAY)] and holes == [(4 * ta.DAY, 5 * ta.DAY), (6 * ta.DAY, 8 * ta.DAY)]
    rows = spark.range(10)
    assert content_key("a.{hash:8}", rows) == content_key("a.{hash:8}", rows.orderBy(F.desc("id"))) != content_key("a.{hash:8}", spark.range(9))


def test_lexicographic_ranges(spark):
    rows = [(a, b) for a in range(4) for b in range(4)]
    df = spark.createDataFrame(rows, "a int, b int")
    for lo in [None, (1, 2), (0, 0)]:
        for hi in [None, (2, 1), (3, 3)]:
            got = {tuple(r) for r in df.where(serve.lexicographic(["a", "b"], lo, hi)).collect()}
            assert got == {r for r in rows if (lo is None or r >= lo) and (hi is None or r < hi)}


def test_as_of_join(spark):
    ev = spark.createDataFrame([(1, 5), (1, 10), (1, 99), (2, 5), (None, 5)], "k int, at bigint")
    iv = spark.createDataFrame([(1, 0, 10, "x"), (1, 10, 50, "y"), (None, 0, 9, "n")], "k int, vf bigint, vt bigint, v string")
    got = {(r.k, r.at): r.v for r in scans.as_of_join(ev, iv, ["k"], "at", 7).collect()}
    assert got == {(1, 5): "x", (1, 10): "y", (1, 99): None, (2, 5): None, (None, 5): "n"}


def test_stream_of_late_rows_is_dropped_by_the_watermark(spark, scratch):
    schema = "ts timestamp, g string"
    for k, ts in enumerate(["2024-01-01 00:10:00", "2024-01-02 00:00:00", "2024-01-01 00:20:00", "2024-01-03 00:00:00"]):
        spark.createDataFrame([(ts, "a")], "ts string, g string").selectExpr("timestamp(ts) ts", "g").coalesce(1).write.mode("append").parquet(f"{scratch.root}/in")
        out = tip.tumbling(spark.readStream.schema(schema).parquet(f"{scratch.root}/in"), "ts", "1 hour", "1 hour", ["g"], {"n": F.count(F.lit(1))})
        q = out.writeStream.format("parquet").option("path", f"{scratch.root}/out").outputMode("append").option("checkpointLocation", f"{scratch.root}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = {r.bin_start.isoformat(): r.n for r in spark.read.parquet(f"{scratch.root}/out").collect()}
    # the third row came after its bin had closed; the last bin is still open
    assert rows == {"2024-01-01T00:00:00": 1, "2024-01-02T00:00:00": 1}


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n")], "k string, t int, v string")
    assert {r.v for r in tip.dedupe(df, ["k"], "t").collect()} == {"z", "n"}
    assert {r.v for r in tip.dedupe(df, ["k"], "t", "first").collect()} == {"x", "n"}

"""Every verb of the command line, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from binstrata import cli
from binstrata.functions import timeaxis as ta
from binstrata.operators import serve
from binstrata.plans.spec import SpecError, check_window, from_mapping

CONFIG = {
    "name": "ride",
    "binCol": "dt",
    "keyTemplate": "{tier}/{shard}/{period}.parquet",
    "dims": [{"name": "who", "type": "string"}],
    "metrics": [{"name": "n", "monoid": "count"}, {"name": "v", "monoid": "sum"}],
    "tiers": [{"name": "h", "bin": "1h", "shards": ["1d", "2d"]}, {"name": "d", "bin": "1d", "shards": ["2d"]}],
}
RANGE = "2024-01-02/2024-01-10"  # four periods of two days


@pytest.fixture
def site(spark, tmp_path):
    (tmp_path / "ride.json").write_text(json.dumps(CONFIG))
    rows = spark.range(400).select(F.timestamp_millis(F.lit(ta.to_ms(ta.datetime(2024, 1, 2))) + F.col("id") * 1_500_000).alias("ts"), F.concat(F.lit("u"), F.col("id") % 5).alias("who"), (F.col("id") % 10).alias("v"))
    rows.write.parquet(f"{tmp_path}/raw")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    where = ["--root", f"file://{tmp_path}/site", "--range", RANGE]
    raw = ["--source", f"{tmp_path}/raw", "--ts", "ts", "--value", "n=1", "--value", "v=v"]
    return run, tmp_path / "ride.json", where, raw, tmp_path


def test_build_invalidate_canonicalize_gc_adopt_query(site, spark):
    run, config, where, raw, tmp = site
    said = run("plan", config, "--range", RANGE, "--dot", tmp / "plan.dot")
    assert said["expected"] == {"h@2d": 4, "d@2d": 4} and (tmp / "plan.dot").read_text().startswith("digraph")
    build = ("build", config, *where, *raw)
    assert run(*build, "--now", 10, "--limit", 3)["written"] == 3
    assert run(*build, "--now", 20)["written"] == 5  # goes on
    assert run(*build, "--now", 30)["written"] == 0
    assert run("invalidate", config, *where[:2], "--range", "2024-01-04/2024-01-05", "--now", 40) == {"requests": 1}
    assert run(*build, "--now", 50) == {"written": 2, "pruned": 1}
    got = run("query", config, *where[:2], "--param", "from=2024-01-02", "--param", "to=2024-01-04", "--param", "bin_budget=2", "--param", "who=u1")
    assert sum(r["n"] for r in got["records"]) == spark.read.parquet(f"{tmp}/raw").where("who = 'u1' AND ts < '2024-01-04'").count()
    (tmp / "map.json").write_text(json.dumps({"u1": "x", "u2": "x"}))
    again = ("canonicalize", config, *where, "--map", tmp / "map.json", "--column", "who")
    assert run(*again, "--now", 60) == {"written": 8, "skipped": 8}  # no shard of h@1d was built
    assert run(*again, "--now", 70) == {"unchanged": 8, "skipped": 8}
    # the cover of a shorter range does not name the last shards
    live = ("gc", config, *where[:2], "--range", "2024-01-02/2024-01-08", "--now", ta.to_ms(ta.datetime(2024, 3, 1)))
    assert run(*live) == {"no covering parent": 2}
    assert run(*live[:-1], ta.to_ms(ta.datetime(2024, 1, 9)), "--grace", 0, "--apply") == {"delete": 2}
    assert run("adopt", config, *where, "--now", 80) == {"adopted": 0}  # their folders are gone as well
    site_ = cli.Site(spark, cli.from_text(config.read_text()), where[1])
    site_.registry.drop(site_.registry.rows().where("tier = 'd'"))
    assert run("adopt", config, *where, "--now", 90) == {"adopted": 3}


def test_a_build_by_windows_is_the_same(site, spark):
    run, config, where, raw, tmp = site
    run("build", config, *where, *raw, "--window", "4d", "--now", 10)
    got = spark.read.parquet(f"{tmp}/site/shards/tier=d/shard=2d").agg(F.sum("n"), F.sum("v_sum")).first()
    assert tuple(got) == (400, 1800.0)
    spec = from_mapping(CONFIG)
    for bad in ("1mo", "90min"):
        with pytest.raises(SpecError):
            check_window(bad, spec)
    with pytest.raises(SystemExit):
        run("build", config, *where, *raw[:4])
    with pytest.raises(SystemExit):
        run("plan", config, "--range", "2024-01-02/2024-01-01")


def test_scans_diffs_and_trees(spark, tmp_path):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    for j in range(4):
        spark.range(20).selectExpr("id AS k", f"id + IF(id % 4 = {j}, 1, 0) AS v").where(f"id <> {j} AND id > 0").write.parquet(f"{tmp_path}/scans/s{j}")
    scans = ["--keys", "k", "--states", "v", "--scans", tmp_path / "scans", *[x for j in range(4) for x in ("--scan", f"s{j}")]]
    said = run("multiscan-seal", "--out", f"file://{tmp_path}/arch", *scans, "--size", 2)
    assert said == {"sealed": [(0, 2), (2, 2)], "dropped": []}
    assert run("multiscan-extract", "--out", f"file://{tmp_path}/arch", "--keys", "k", "--states", "v", "--scan", "s2", "--to", tmp_path / "s2") == {"rows": 18}
    index = ["--out", f"file://{tmp_path}/idx"]
    assert run("diffindex-update", *index, *scans) == {"steps": 3} == run("diffindex-update", *index, *scans)
    assert run("diffindex-diff", *index, "--keys", "k", "--states", "v", 0, 3)["rows"] == 9
    said = run("multiscan-seal", "--out", f"file://{tmp_path}/arch", *scans, "--size", 2, "--drop")
    assert said["dropped"] == ["s0", "s1", "s2", "s3"] and not list((tmp_path / "scans").glob("s*"))
    bench = run("multiscan-bench", "--n-keys", 50, "--n-scans", 6, "--churn", "0,0.5", "--births", "0.2")
    assert bench["0.0"]["interval"] < bench["0.5"]["interval"] and bench["0.0"]["densify"] == 300
    for name, size in (("a", 5), ("b", 6)):
        spark.createDataFrame([("r/x", 3, 1), ("r/y", size, 1)], "path string, size bigint, n bigint").write.parquet(f"{tmp_path}/{name}")
    assert run("diff", tmp_path / "a", tmp_path / "b") == {"changed": 3} == run("diff", tmp_path / "a", tmp_path / "b", "--all")


def test_query_parameters():
    spec = from_mapping(CONFIG)
    ok = {"from": "2024-01-01", "to": "2024-01-02T12:00:00+00:00"}
    got = serve.query_params(spec, {**ok, "smooth": "7d", "smooth_mode": "trailing", "who": "a,b"})
    assert got == {"lo": 1704067200000, "hi": 1704196800000, "bin_budget": 1024, "smoothing": "7d", "mode": "trailing", "dims": {"who": ["a", "b"]}}
    bad = [{}, {"from": "x", "to": "2024-01-01"}, {"from": "2024-01-02", "to": "2024-01-01"}, {**ok, "bin_budget": "0"}, {**ok, "bin_budget": "many"}, {**ok, "smooth": "fast"}, {**ok, "smooth_mode": "odd"}, {**ok, "other": "1"}]
    for params in bad:
        with pytest.raises(serve.QueryError):
            serve.query_params(spec, params)

"""Queries do the whole job: nothing of their tables is left out."""

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from binstrata.functions import timeaxis as ta
from binstrata.operators import inventory, scans
from binstrata.plans.spec import PyramidSpec, Tier

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def written(spark, pattern):
    """Folders below the shared one."""
    return set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/{pattern}"))


@needs_data
@pytest.mark.parametrize("name,pattern", [("S13_tip_stream", "tip-*/tier=q/shard=6h/period=*"), ("S3_tiled_source", "tiles-*/*.parquet")])
def test_every_day_is_written(spark, name, pattern):
    days = {ta.label(r[0], "1d") for r in spark.read.parquet(f"{DATA}/events.parquet").select(ta.floor_col(ta.ms_of("ts"), "1d")).distinct().collect()}
    before = written(spark, pattern)
    entry.queries()[name](spark, DATA).collect()
    names = [os.path.basename(p).removeprefix("period=") for p in written(spark, pattern) - before]
    assert {n[:10] for n in names} == days


def test_source_cover_keeps_pyramids_apart(spark):
    spec = PyramidSpec("p", (Tier("h", "1h", ("1d",)), Tier("d", "1d", ("4d",))))
    gaps = spark.createDataFrame([(p, "d", "4d", 0, 4 * ta.DAY) for p in "ab"], "pyramid string, tier string, shard_dur string, period_start bigint, period_end bigint")
    have = spark.createDataFrame([("a", "h", "1d", 0, ta.DAY), ("b", "h", "1d", ta.DAY, 3 * ta.DAY), ("c", "h", "1d", 0, 4 * ta.DAY)], gaps.schema)
    got = inventory.source_cover(gaps, have, spec, ["pyramid"]).collect()
    assert {(r.pyramid, r.covered // ta.DAY, r.uncovered // ta.DAY) for r in got} == {("a", 1, 3), ("b", 2, 2)}


def test_cover_status_keeps_pyramids_apart(spark):
    schema = "pyramid string, tier string, shard_dur string, period_start bigint, period_end bigint"
    expected = spark.createDataFrame([(p, "d", "4d", k * ta.DAY, (k + 4) * ta.DAY) for p in "ab" for k in (0, 4)], schema)
    have = spark.createDataFrame([("a", "d", "4d", 0, 4 * ta.DAY), ("b", "d", "4d", 4 * ta.DAY, 8 * ta.DAY), ("b", "d", "4d", 8 * ta.DAY, 12 * ta.DAY)], schema)
    got = inventory.cover_status(expected, have, F.col("period_end"), 100 * ta.DAY, by=["pyramid"]).collect()
    assert {(r.pyramid, r.period_start // ta.DAY, r.status) for r in got} == {("a", 0, "present"), ("a", 4, "missing"), ("b", 0, "missing"), ("b", 4, "present"), ("b", 8, "stale")}


def test_scan_digests_are_those_of_single_scans(spark):
    schema = "dataset string, scan bigint, dt bigint, path string, b bigint, o bigint"
    data = [(x, j, k % 2, 'a"\\\\' + str(k), k % 3, j) for x in ("x", None) for j in range(3) for k in range(3 + j)]
    rows = spark.createDataFrame(data, schema)
    got = {(r.dataset, r.scan): (r.n, r.sha256) for r in scans.scan_digests(rows, ["dataset", "scan"]).collect()}
    for x, j in {r[:2] for r in data}:
        one = scans.scan_digest(rows.where(F.col("dataset").eqNullSafe(F.lit(x)) & (F.col("scan") == j)).drop("dataset", "scan")).first()
        assert got[x, j] == (one.n, one.sha256)
    large = {(r.dataset, r.scan): r for r in scans.scan_digests(rows, ["dataset", "scan"], most=4).collect()}
    assert all((r.sha256 is None) == (r.n > 4) and r.digest is not None for r in large.values()) and {r.n > 4 for r in large.values()} == {True, False}


@needs_data
def test_every_scan_of_every_archive_has_a_digest(spark):
    got = entry.queries()["M7_scan_digest"](spark, DATA).collect()
    newest = {}
    for r in sorted(spark.read.parquet(f"{DATA}/pyramid_multiscans.parquet").collect(), key=lambda r: str(r.written_at)):
        newest[r.dataset, r.key] = r
    assert sorted((r.dataset, r.key, r.label) for r in got) == sorted((*k, label) for k, r in newest.items() for label in json.loads(r.scans))
    assert {r.encoder for r in got if r.same} == {"densify", "interval"}


def test_digest_is_that_of_ascii_json(spark):
    paths = ["a", 'q"\\', "\u00e9\u65e5", "\U0001f469", "\n\t\x01\x7f"]
    rows = [(k, p, 1, 2) for k, p in enumerate(paths)]
    want = "".join(json.dumps(list(r), separators=(",", ":")) + "\n" for r in sorted(rows, key=lambda r: r[1]))
    got = scans.scan_digest(spark.createDataFrame(rows, "dt bigint, path string, b bigint, o bigint")).first()
    assert got.sha256 == hashlib.sha256(want.encode()).hexdigest()

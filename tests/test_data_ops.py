"""The general data operations against brute force, with nulls, ties, repeats, empty tables, skew and clashing names."""

import json
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from binstrata.operators import archives, compaction, history, increments, percentiles, snapshot_diff, sweep
from binstrata.operators.compaction import Compactor, PathRecords
from binstrata.operators.registry import live_rows
from binstrata.queries import data_ops
from binstrata.sources.store import CommitConflict, VersionedStore

UTC = timezone.utc
T0 = datetime(2024, 1, 1, tzinfo=UTC)
BY = ("p", "m")
FILES = "p string, m string, key string, n_bytes bigint"
ROWS = "rec_id bigint, key string, x double, p string"


# -- registry ---------------------------------------------------------------------------------------


def test_live_rows(spark):
    schema = "pyramid string, tier string, shard_dur string, period_start timestamp, written_at timestamp, key string"
    rows = [("a", "q", "1d", T0, None, "k1"), ("a", "q", "1d", T0, T0, "k2"), ("a", "q", "1d", T0, T0, "k2"), (None, "q", "1d", None, None, "k3"), (None, "q", "1d", None, None, "k3")]
    got = live_rows(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.pyramid, r.key) for r in got if r.pyramid) == [("a", "k2")]
    assert [r.key for r in got if r.pyramid is None] == ["k3"]
    assert live_rows(spark.createDataFrame([], schema)).count() == 0


# -- p1 ---------------------------------------------------------------------------------------------


def p1_data(spark):
    files = [("a", "01", f"a{k}", 10) for k in range(12)] + [("a", "02", f"b{k}", 10) for k in range(5)] + [(None, "01", f"n{k}", 10 + k) for k in range(10)] + [("c", "01", f"c{k}", None) for k in range(20)] + [("d", "01", f"d{k}", 10**9) for k in range(20)]
    files += [("e/=%", "01", f"e{k}", 0) for k in range(10)]
    recs = [(i, files[i % len(files)][2], None if i % 7 == 0 else float(i), "clash") for i in range(900)]
    recs += recs[:100] + [recs[5]] * 500 + [(10_000 + i, "a1", float("nan"), None) for i in range(1500)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(recs, ROWS).repartition(4)


def test_compaction_rewrites_only_small_partitions_and_keeps_each_record_once(spark, store):
    files, recs = p1_data(spark)
    c = Compactor(store, BY, good_bytes=40)
    found = {tuple(r) for r in c.find(files).select(*BY).collect()}
    assert found == {("a", "01"), (None, "01"), ("e/=%", "01")}
    # adaptive execution joins small pieces to one file; without that each has its own
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert c.compact(files, recs) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = c.read(files, recs)
    assert out.columns == ["rec_id", "key", "x", "p", "partition_p", "m", "rewritten"]
    got = out.collect()
    want = recs.dropDuplicates(["rec_id"]).count()
    assert len(got) == want == len({r.rec_id for r in got})
    home = {r.key: (r.p, r.m) for r in files.collect()}
    assert all((r.partition_p, r.m) == home[r.key] and r.rewritten == (home[r.key] in found) for r in got)
    # 32 files come out in few, of the size asked for: 120 bytes in three, 145 in four, none known in one
    n = {r.p: r.files for r in c.packs().join(c.manifest().select("__part", "p"), "__part").collect()}
    assert n == {"a": 3, None: 4, "e/=%": 1}


def test_compaction_leaves_out_partitions_that_changed_meanwhile(spark, store):
    files, recs = p1_data(spark)
    c = Compactor(store, BY)
    late = spark.createDataFrame([("a", "01", "late", 5), (None, "01", "late2", 5)], FILES)
    changed = files.where("key <> 'a3'").unionByName(late)  # a file consumed is gone; one that came is none of the run's business
    c.compact(files, recs, current=lambda: changed)
    state = {(r.p, r.m): r.conflict for r in c.manifest().collect()}
    assert state[("a", "01")] is True and state[(None, "01")] is False
    got = c.read(files, recs)
    assert got.where("rewritten").where("partition_p = 'a'").count() == 0
    assert got.count() == recs.dropDuplicates(["rec_id"]).count()
    assert {(r.p, r.m) for r in c.find(changed).collect()} == {("a", "01")}  # for the next run


def test_compaction_loses_nothing_that_comes_later_and_converges(spark, store):
    files = [("a", "01", f"a{k}", 10) for k in range(12)]
    recs = [(i, f"a{i % 12}", 1.0, "x") for i in range(120)]
    df = lambda f, r: (spark.createDataFrame(f, FILES), spark.createDataFrame(r, ROWS))
    ids = lambda out: sorted(r.rec_id for r in out.select("rec_id").collect())
    c = Compactor(store, BY)
    c.compact(*df(files, recs))
    # a file that arrives in a rewritten partition is read in place
    files.append(("a", "01", "new", 10))
    recs += [(200 + i, "new", 1.0, "x") for i in range(10)]
    f, r = df(files, recs)
    assert ids(c.read(f, r)) == [*range(120), *range(200, 210)]
    assert c.find(f).count() == 0  # one pack and one file: nothing to do
    c.compact(f, r)
    assert c.manifest().count() == 0 and ids(c.read(f, r)) == [*range(120), *range(200, 210)]
    # ten more: the pack is still small, so it is merged with them into the partition's other folder
    files += [("a", "01", f"b{k}", 10) for k in range(10)]
    recs += [(300 + k, f"b{k}", 1.0, "x") for k in range(10)]
    f, r = df(files, recs)
    before = c.store.latest()
    c.compact(f, r)
    everything = [*range(120), *range(200, 210), *range(300, 310)]
    assert ids(c.read(f, r)) == everything and c.read(f, r).where("not rewritten").count() == 0
    assert [(p["__slot"], p.files) for p in c.packs().collect()] == [(1, 1)]
    # a reader of the version before sees the same records: packed, or in their files
    old = c.read(f, r, before)
    assert ids(old) == everything and old.where("not rewritten").count() == 20
    # a file taken out of the registry, and one written anew
    files = [x for x in files if x[2] not in ("a0", "b1")] + [("a", "01", "b1", 11)]
    recs = [x for x in recs if x[1] not in ("a0", "b1")] + [(900, "b1", 1.0, "x")]
    f, r = df(files, recs)
    assert ids(c.read(f, r)) == sorted(x[0] for x in recs)
    files += [("a", "01", f"c{k}", 10) for k in range(10)]
    recs += [(500 + k, f"c{k}", 1.0, "x") for k in range(10)]
    f, r = df(files, recs)
    c.compact(f, r)
    assert ids(c.read(f, r)) == sorted(x[0] for x in recs) and [p["__slot"] for p in c.packs().collect()] == [0]


def test_a_full_pack_is_sealed_and_large_files_stay(spark, store):
    files = [("a", "01", f"a{k}", 10) for k in range(10)] + [("a", "01", "large", 10**6)]
    recs = [(i, f"a{i % 10}", 1.0, "x") for i in range(100)] + [(1000, "large", 1.0, "x")]
    c = Compactor(store, BY, small_bytes=50, good_bytes=100)
    c.compact(spark.createDataFrame(files, FILES), spark.createDataFrame(recs, ROWS))
    assert "large" not in {r["__file"] for r in c.consumed().collect()}
    files += [("a", "01", f"b{k}", 10) for k in range(10)]
    recs += [(300 + k, f"b{k}", 1.0, "x") for k in range(10)]
    f, r = spark.createDataFrame(files, FILES), spark.createDataFrame(recs, ROWS)
    c.compact(f, r)
    assert sorted(p["__slot"] for p in c.packs().collect()) == [0, 2]  # a Parquet file has more than 100 bytes
    assert sorted(x.rec_id for x in c.read(f, r).collect()) == sorted(x[0] for x in recs)


def test_a_second_writer_is_kept_out_and_a_dead_one_gives_way(spark, store):
    files, recs = p1_data(spark)
    c = Compactor(store, BY)
    store.claim(0, 3600)
    with pytest.raises(CommitConflict):
        c.compact(files, recs)
    assert c.compact(files, recs, lease_s=-1) == 1
    with pytest.raises(CommitConflict):
        store.claim(0, 3600)


def test_a_run_takes_a_share_of_the_files(spark, store):
    files = spark.createDataFrame([(p, "01", f"{p}{k}", 10) for p in "abcdef" for k in range(10)], FILES)
    recs = files.selectExpr("xxhash64(key) AS rec_id", "key", "1.0 AS x", "p")
    c, found = Compactor(store, BY, files_per_run=20), []
    while (n := c.find(files).count()) and len(found) < 9:
        found.append(n)
        c.compact(files, recs)
    assert found[0] == 6 and n == 0 and 1 < len(found) <= 6
    assert c.read(files, recs).where("rewritten").count() == 60


def test_p1_found_finds_all_partitions_of_more_than_a_million_small_files(spark, tmp_path):
    d = f"file://{tmp_path}"
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))  # all in January
    names = [F.format_string("p%d", F.col("id") % 40).alias("pyramid"), F.lit("q").alias("tier"), F.lit("1d").alias("shard_dur"), at.alias("period_start"), at.alias("period_end"), F.col("id").cast("string").alias("key"), at.alias("written_at")]
    spark.range(1_100_000).select(*names, F.lit(10).cast("long").alias("n_bytes")).write.parquet(f"{d}/pyramid_shards.parquet")
    spark.range(80).selectExpr("id AS rec_id", "string(id) AS key", "1.0 AS count").write.parquet(f"{d}/longform.parquet")
    got = [tuple(r) for r in data_ops.p1_found(spark, d).collect()]
    assert sorted(got) == sorted((f"p{k}", "q", "1d", "2024-01") for k in range(40))


def test_packs_are_the_same_when_their_folders_are_listed_in_parts(spark, store, tmp_path, monkeypatch):
    files, recs = p1_data(spark)
    lonely = spark.createDataFrame([("z", "01", f"z{k}", 10) for k in range(10)], FILES)  # files without records: no folder
    c, other = Compactor(store, BY), Compactor(VersionedStore(spark, f"file://{tmp_path}/other"), BY)
    c.compact(files.unionByName(lonely), recs)
    monkeypatch.setattr(compaction, "LISTED_FOLDERS", 2)  # by one digit of 16, most of which have no folder
    other.compact(files.unionByName(lonely), recs)
    packs = lambda x: sorted((r["__part"], r["__slot"], r.files) for r in x.packs().collect())
    assert packs(c) == packs(other) and len(packs(c)) == 3
    assert other.read(files, recs).count() == recs.dropDuplicates(["rec_id"]).count()


def test_records_are_read_by_path(spark, store, tmp_path):
    root = f"file://{tmp_path}/lake of files"
    rows = spark.createDataFrame([(i, f"k{i % 10}", float(i), "x") for i in range(50)], ROWS)
    for k in range(10):
        rows.where(F.col("key") == f"k{k}").drop("key").coalesce(1).write.parquet(f"{root}/d/k{k}.parquet")
    files = spark.createDataFrame([("a", "01", f"d/k{k}.parquet", 10) for k in range(10)], FILES)
    schema = "rec_id bigint, x double, p string"
    # a folder stands for a file here, so names are those of the parts
    parts = spark.read.parquet(*[f"{root}/d/k{k}.parquet" for k in range(10)]).select(F.substring_index(F.url_decode(F.col("_metadata.file_path")), "lake of files/", -1).alias("key")).distinct()
    files = parts.select(F.lit("a").alias("p"), F.lit("01").alias("m"), "key", F.lit(10).cast("long").alias("n_bytes"))
    c, lake = Compactor(store, BY), PathRecords(spark, root, schema)
    c.compact(files, lake)
    got = c.read(files, lake).collect()
    assert sorted(r.rec_id for r in got) == list(range(50)) and all(r.rewritten for r in got)
    assert c.read(files, lake, 0).where("not rewritten").count() == 50


def test_files_beyond_what_is_read_at_once_are_packed_by_the_same_run(spark, store, tmp_path):
    root = f"file://{tmp_path}/lake"
    df = spark.range(160).selectExpr("id AS rec_id", "double(id) AS x", "'x' AS p", "id % 80 AS k")
    df.repartition(1).write.partitionBy("k").parquet(f"{root}/d")
    name = F.substring_index(F.url_decode(F.col("_metadata.file_path")), "lake/", -1)
    parts = spark.read.parquet(f"{root}/d").select(name.alias("key"), F.col("k").cast("int")).distinct()
    files = parts.select(F.format_string("p%d", F.col("k") % 8).alias("p"), F.lit("01").alias("m"), "key", F.lit(10).cast("long").alias("n_bytes"))
    lake, asked = PathRecords(spark, root, "rec_id bigint, x double, p string"), []
    lake.at_once, of = 20, lake.of
    lake.of = lambda names: (asked.append(names.count()), of(names))[1]
    c = Compactor(store, BY)
    c.compact(files, lake)
    # four lots of whole partitions (ten files each), one version
    assert len(asked) == 4 and sum(asked) == 80 and max(asked) < 80 and all(n % 10 == 0 for n in asked)
    assert c.store.latest() == 1 and c.manifest().where("not conflict").count() == 8 and c.find(files).count() == 0
    got = c.read(files, lake).collect()
    assert sorted(r.rec_id for r in got) == list(range(160)) and all(r.rewritten for r in got)
    # packs that are still small are merged in lots as well
    more = df.where("k < 80").selectExpr("rec_id + 1000 AS rec_id", "x", "p", "k")
    more.repartition(1).write.partitionBy("k").parquet(f"{root}/e")
    late = spark.read.parquet(f"{root}/e").select(name.alias("key"), F.col("k").cast("int")).distinct()
    files = files.unionByName(late.select(F.format_string("p%d", F.col("k") % 8).alias("p"), F.lit("01").alias("m"), "key", F.lit(10).cast("long").alias("n_bytes")))
    files = spark.createDataFrame(files.collect(), FILES)
    c.compact(files, lake)
    got = c.read(files, lake).collect()
    assert sorted(r.rec_id for r in got) == [*range(160), *range(1000, 1160)] and all(r.rewritten for r in got)


def test_compaction_of_nothing(spark, store):
    files, recs = spark.createDataFrame([], FILES), spark.createDataFrame([], ROWS)
    c = Compactor(store, BY)
    assert c.find(files).count() == 0
    c.compact(files, recs)
    assert c.read(files, recs).count() == 0


def test_of_two_commits_one_fails(spark, store):
    other = VersionedStore(spark, store.root)
    base = store.latest()
    assert store.commit(base, {"a": 1}) == 1
    with pytest.raises(CommitConflict):
        other.commit(base, {"a": 2})
    assert other.meta() == {"a": 1}
    assert other.commit(1, {"a": 3}) == 2 and store.versions() == [1, 2]
    store.vacuum(keep=1)
    assert store.versions() == [2]


# -- p2 and p6 --------------------------------------------------------------------------------------

MS = "dataset string, key string, scans string, encoder string, written_at timestamp"
IV = "key string, dt bigint, path string, b bigint, o bigint, seen bigint, __scan bigint, __scan_lo bigint, __scan_hi bigint"


def make_archives(seed, n_objects=40, n_scans=9, churn=0.3):
    """Random states, archived in mixed encodings, overlapping archives, pieces, repeats and noise. Returns the
    tables and the truth ``{dataset: [scan labels], states}``."""
    rng = random.Random(seed)
    ms, iv, truth = [], [], {}
    for ds in ("one", "two", None) if seed % 2 else ("one",):
        labels = [f"s{j:02d}" for j in range(n_scans)]
        objects = [(rng.randrange(2), f"p/{k}" if k % 5 else f"P/{k}é") for k in range(n_objects)] + [(0, None)]
        state = {o: (rng.randrange(3), rng.randrange(3)) for o in objects if rng.random() < 0.8}
        scans = []
        for _ in labels:
            for o in objects:
                if rng.random() < churn:
                    if rng.random() < 0.3:
                        state.pop(o, None)
                    else:
                        state[o] = (rng.randrange(3), rng.randrange(3))
            scans.append({o: s for o, s in state.items() if s != (0, 0)})
        truth[ds] = (labels, scans)
        groups, at = [], 0
        while at < n_scans:
            size = min(n_scans - at, rng.randrange(1, 4))
            groups.append(list(range(at, at + size)))
            at += size
        groups.append([1, 3, 4])  # archived again, not contiguous
        when = T0
        for gi, idx in enumerate(groups):
            key = f"{ds}/a{gi}"
            when += timedelta(hours=1)
            enc = rng.choice(["densify", "interval"])
            ms.append((ds, key, json.dumps([labels[j] for j in idx]), enc, when))
            if rng.random() < 0.3:
                ms.append((ds, key, json.dumps(["zz"]), enc, when - timedelta(days=1)))  # an older row
                ms.append(ms[-2])
            for o in objects:
                runs, k = [], 0
                while k < len(idx):
                    s = scans[idx[k]].get(o)
                    e = k
                    while enc == "interval" and e + 1 < len(idx) and scans[idx[e + 1]].get(o) == s:
                        e += 1
                    if s:
                        runs.append((k, e, s))
                    elif rng.random() < 0.1:
                        runs.append((k, e, (0, None)))
                    k = e + 1
                for lo, hi, (b, oo) in runs:
                    b = None if b == 0 and rng.random() < 0.5 else b
                    pieces = [(lo, hi)]
                    if hi > lo and rng.random() < 0.5:
                        mid = rng.randrange(lo, hi)
                        pieces = [(lo, mid), (mid + rng.randrange(0, 2), hi)] if rng.random() < 0.5 else [(lo, mid + 1), (lo, hi)]
                    for x, y in pieces:
                        row = (key, o[0], o[1], b, oo, rng.randrange(9), None, x, y) if enc == "interval" else (key, o[0], o[1], b, oo, rng.randrange(9), x, None, None)
                        iv += [row] * (2 if rng.random() < 0.1 else 1)
            iv.append((key, 0, "noise", 1, 1, 0, 77, None, None) if enc == "densify" else (key, 0, "noise", 1, 1, 0, None, 50, 60))
    iv += [("unknown", 0, "x", 1, 1, 0, 0, None, None), (None, 0, "x", 1, 1, 0, 0, None, None)]
    ms += [("bad", "bad/1", None, "densify", T0), ("bad", "bad/2", "not json", "densify", T0)]
    rng.shuffle(iv)
    return ms, iv, truth


def brute_history(truth):
    out = set()
    for ds, (labels, scans) in truth.items():
        for o in {o for s in scans for o in s}:
            j = 0
            while j < len(labels):
                s, e = scans[j].get(o), j
                while s and e + 1 < len(labels) and scans[e + 1].get(o) == s:
                    e += 1
                if s:
                    out.add((ds, *o, *s, labels[j], labels[e]))
                j = e + 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_by_merkle_trees(spark, scratch, store, seed):
    ms, iv, truth = make_archives(seed)
    got = history.archive_history(spark.createDataFrame(iv, IV), spark.createDataFrame(ms, MS), store, scratch).collect()
    rows = [tuple(r) for r in got]
    assert len(rows) == len(set(rows)) and set(rows) == brute_history(truth)


def test_history_grows_by_reading_changed_leaves_only(spark, scratch, store):
    # 2,000 objects; from scan to scan nothing changes but few of them
    rng = random.Random(3)
    state, scans = {k: 1 for k in range(2000)}, []
    for j in range(1, 7):
        if j > 1:
            for k in rng.sample(range(2200), 6):
                state[k] = j
            state.pop(rng.choice(sorted(state)))
        scans.append(dict(state))
    frame = lambda js: spark.createDataFrame([("d", 0, f"p{k}", v, 1, j, j) for j in js for k, v in scans[j - 1].items()], "dataset string, dt bigint, path string, b bigint, o bigint, lo bigint, hi bigint")
    span = lambda a, b: spark.createDataFrame([("d", a, b)], "dataset string, from bigint, to bigint")
    h = history.History(store, levels=2)
    h.append(frame([1, 2, 3]), span(1, 3), scratch)
    n = h.stored_tree().where("level = 2").count()
    assert n > 200
    for j in (4, 5, 6):
        history.History(store).append(frame([j]), span(j, j), scratch)
        meta = store.meta()
        assert 1 <= meta["changed_leaves"] <= 8 and meta["log_rows_read"] <= 8 * 2000 / 256 * 4
    # the same as one run over all, tree included
    other = history.History(VersionedStore(spark, f"{store.root}-whole"), levels=2)
    other.append(frame(range(1, 7)), span(1, 6), scratch)
    h = history.History(store)
    for a, b in ((h.versions(), other.versions()), (h.stored_tree(), other.stored_tree())):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    truth = {"d": ([str(j) for j in range(1, 7)], [{(0, f"p{k}"): (v, 1) for k, v in s.items()} for s in scans])}
    assert {(*r[:5], str(r.first), str(r.last)) for r in h.versions().collect()} == brute_history(truth)


def test_a_dataset_may_vanish_and_come_back(spark, scratch, store):
    frame = lambda rows: spark.createDataFrame(rows, "dataset string, dt bigint, path string, b bigint, o bigint, lo bigint, hi bigint")
    span = lambda *x: spark.createDataFrame(list(x), "dataset string, from bigint, to bigint")
    h = history.History(store, levels=1)
    h.append(frame([("d", 0, "x", 1, 1, 1, 1), (None, None, None, 1, 1, 1, 1), ("e", 0, "x", 1, 1, 1, 1)]), span(("d", 1, 1), (None, 1, 1), ("e", 1, 1)), scratch)
    h.append(frame([]), span(("d", 2, 2), (None, 2, 2)), scratch)  # both empty; e has no snapshot
    h.append(frame([("d", 0, "x", 1, 1, 3, 3), (None, None, None, 1, 1, 3, 3), ("e", 0, "x", 1, 1, 2, 2)]), span(("d", 3, 3), (None, 3, 3), ("e", 2, 2)), scratch)
    got = {(r.dataset, r.path, r.first, r.last) for r in h.versions().collect()}
    assert got == {("d", "x", 1, 1), ("d", "x", 3, 3), (None, None, 1, 1), (None, None, 3, 3), ("e", "x", 1, 2)}


def test_history_of_nothing(spark, scratch, store):
    assert history.archive_history(spark.createDataFrame([], IV), spark.createDataFrame([], MS), store, scratch).count() == 0


def brute_diffs(ms, truth):
    """Diffs of consecutive scans, both read from densify archives."""
    out = set()
    newest = {}
    for ds, key, scans, enc, at in ms:
        if (ds, key) not in newest or at > newest[ds, key][2]:
            newest[ds, key] = (scans, enc, at)
    for ds, (labels, scans) in truth.items():
        enc = {}
        for (d2, key), (names, e, at) in sorted(newest.items(), key=lambda x: x[1][2]):
            if d2 == ds:
                for n in json.loads(names):
                    enc[n] = e
        for j in range(1, len(labels)):
            if enc[labels[j]] == enc[labels[j - 1]] == "densify":
                a, b = scans[j - 1], scans[j]
                for o in a.keys() | b.keys():
                    if a.get(o) != b.get(o):
                        out.add((ds, labels[j], *o, "added" if o not in a else "removed" if o not in b else "changed"))
    return out


@pytest.mark.parametrize("seed,churn", [(2, 0.3), (4, 0.9), (5, 0.3), (6, 0.0)])
def test_snapshot_diffs_by_bloom_tables(spark, scratch, seed, churn):
    ms, iv, truth = make_archives(seed, churn=churn)
    got = [tuple(r) for r in snapshot_diff.archive_diffs(spark.createDataFrame(iv, IV), spark.createDataFrame(ms, MS), scratch).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_diffs(ms, truth)


def test_small_tables_are_enlarged(spark, scratch):
    mask, h = (1 << 56) - 1, lambda x: x * 2654435761 * 40503 % (1 << 56)
    two = [("d", s, 0, 4, h(k) & mask, h(k + 7), k) for k in range(500) for s in ((2,) if k % 2 else (1, 2))]
    two += [two[0]] * 3 + [two[1]] * 300  # repeated rows: recovered as a difference in number
    df = spark.createDataFrame(two, "dataset string, scan bigint, bucket bigint, size bigint, kh bigint, vh bigint, k int").repartition(3)
    pairs = spark.createDataFrame([("d", 2)], "dataset string, later bigint")
    want = {h(k) for k in range(500) if k % 2} | {two[0][4], two[1][4]}
    for rounds in (1, 6):  # after one round the exact comparison takes over
        got = snapshot_diff.recover(df, pairs, scratch, rounds=rounds).collect()
        assert {r.kh for r in got} == want and len(got) == len(want)


def test_tables_are_as_large_as_the_differences(spark, scratch):
    n = 40_000
    rows = spark.range(2 * n).selectExpr("'d' AS dataset", "id % 2 + 1 AS scan", "xxhash64(id div 2) & 72057594037927935 AS kh", "xxhash64(CASE WHEN id % 2 = 1 AND id div 2 % 100 = 0 THEN -1 ELSE id div 2 END, 0) & 72057594037927935 AS vh")
    d = snapshot_diff.expected_differences(rows).where("later = 2").first().d
    assert 400 < d < 1600  # 800 pairs
    elements = rows.selectExpr("dataset", "scan", "pmod(kh, 8) AS bucket", "64L AS size", "kh", "vh")
    cells = snapshot_diff.tables(elements).selectExpr("sum(size(cell)) AS n").first().n
    assert cells < 2 * n / 5  # of 80,000 objects, in four tasks
    pairs = spark.createDataFrame([("d", 2)], "dataset string, later bigint")
    assert snapshot_diff.recover(elements, pairs, scratch).count() == 400


def test_pair_hash_is_sparks(spark):
    rng = np.random.default_rng(1)
    k, v = (rng.integers(-(2**63), 2**63 - 1, 50) for _ in range(2))
    got = spark.createDataFrame([(int(a), int(b)) for a, b in zip(k, v)], "a bigint, b bigint").select(F.xxhash64("a", "b").alias("h")).collect()
    assert [r.h for r in got] == snapshot_diff.pair_hash(k, v).tolist()


def test_scan_owner_is_the_archive_written_last(spark):
    ms = [("d", "a", '["x","y"]', "densify", T0), ("d", "b", '["y","z"]', "interval", T0 + timedelta(1)), ("d", "a", '["old"]', "densify", T0 - timedelta(1))]
    got = archives.scan_catalog(spark.createDataFrame(ms, MS)).orderBy("scan").collect()
    assert [(r.label, r.key, r.idx, r.encoder) for r in got] == [("x", "a", 0, "densify"), ("y", "b", 0, "interval"), ("z", "b", 1, "interval")]


# -- p3 ---------------------------------------------------------------------------------------------


def brute_percentile(pairs, q):
    pairs = sorted(pairs)
    total, c = sum(w for _, w in pairs), 0.0
    for v, w in pairs:
        c += w
        if c >= total * q:
            return v


@pytest.mark.parametrize("pivots,piece,fan", [(7, 4096, 256), (1, 50, 256), (3, 16, 3)])
def test_percentiles_are_exact(spark, scratch, pivots, piece, fan):
    rng = random.Random(7)
    rows = [("hot", "m", float(rng.randrange(5000)), float(rng.randrange(1, 9))) for _ in range(3000)]
    rows += [(f"g{rng.randrange(5)}", "m", float(rng.choice([1, 1, 1, 2, 50])), 1.0) for _ in range(300)]
    rows += [("one", "m", 5.0, 2.0), ("neg", "m", -3.5, 1.0), ("neg", "m", -2.5, 1.0), (None, "m", 1.0, 1.0), (None, "m", 9.0, 1.0)]
    dirty = [("one", "m", None, 9.0), ("one", "m", float("nan"), 9.0), ("one", "m", 9.0, 0.0), ("one", "m", 9.0, -4.0), ("one", "m", 9.0, None), ("one", "m", 9.0, float("nan")), ("none", "m", None, 1.0)]
    df = spark.createDataFrame(rows + dirty, "s string, metric string, v double, w double")
    qs = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = percentiles.percentiles(percentiles.partials(df, ("s", "metric"), "v", "w"), ("s", "metric"), qs, scratch, pivots=pivots, piece=piece, fan=fan).collect()
    groups = {}
    for s, _, v, w in rows:
        groups.setdefault(s, []).append((v, w))
    assert len(got) == len(groups)
    for r in got:
        assert [r[f"p_{k}"] for k in range(5)] == [brute_percentile(groups[r.s], q) for q in qs], r.s


def test_percentiles_within_the_rank_error(spark, scratch):
    rng = random.Random(8)
    rows = [("g", float(rng.randrange(100_000))) for _ in range(5000)]
    df = spark.createDataFrame(rows, "s string, v double")
    r = percentiles.percentiles(percentiles.partials(df, ("s",), "v"), ("s",), (0.5, 0.9), scratch, rank_error=0.02).first()
    values = sorted(v for _, v in rows)
    for q, x in ((0.5, r.p_0), (0.9, r.p_1)):
        assert abs(sum(v <= x for v in values) / len(values) - q) <= 0.02 + 1e-3


def test_reports_of_very_many_pieces_meet_in_steps(spark, scratch):
    df = spark.range(100_000).selectExpr("'g' AS s", "double(id * 7919 % 100000) AS value", "1.0 AS weight")
    r = percentiles.percentiles(df, ("s",), (0.5, 0.95), scratch, piece=2, fan=64).first()
    assert (r.p_0, r.p_1) == (49_999.0, 94_999.0)
    said = np.random.default_rng(1).random((500, 2 * 3 + 1 + 4 * 3))
    said[:, 1] = 0.0  # no piece has anything in this range
    one = percentiles.merge_reports(said, 3)
    assert np.allclose(one[:7], said[:, :7].sum(axis=0)) and np.isnan(one[10:13]).all() and not np.isnan(one[13:]).any()


def test_partial_states_combine(spark, scratch):
    rng = random.Random(9)
    rows = [(f"g{rng.randrange(3)}", k % 4, float(rng.randrange(40)), 1.0) for k in range(400)]
    df = spark.createDataFrame(rows, "s string, day int, v double, w double")
    days = [percentiles.partials(df.where(F.col("day") == k), ("s",), "v", "w") for k in range(4)]
    merged = percentiles.merge_partials(days[0].union(days[1]).union(days[2].union(days[3])), ("s",))
    whole = percentiles.partials(df, ("s",), "v", "w")
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0
    assert percentiles.percentiles(whole.where("false"), ("s",), (0.5,), scratch).count() == 0


# -- p4 ---------------------------------------------------------------------------------------------


def brute_periods(rows):
    out = set()
    groups = {}
    for g, a, b in rows:
        if a is not None and b is not None and b > a:
            groups.setdefault(g, []).append((a, b))
    for g, iv in groups.items():
        merged = []
        for a, b in sorted(iv):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(g, "period", a, b) for a, b in merged}
        out |= {(g, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("block", [3, 50_000])
def test_periods_and_gaps(spark, block):
    rng = random.Random(11)
    rows = []
    for g in ("a", "b", "hot", None):
        for _ in range(300 if g == "hot" else 30):
            a = rng.randrange(0, 2000)
            rows.append((g, a, a + rng.choice([-5, 0, 1, 2, 3, 10, 60])))
    rows += [("a", None, 5), ("a", 5, None), ("touch", 0, 5), ("touch", 5, 9), ("touch", 5, 9), ("nest", 0, 100), ("nest", 10, 20), ("none", 3, 3), ("far", -(10**15), -(10**15) + 1), ("far", 10**15, 10**15 + 1)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "g string, s bigint, e bigint, t string")
    got = [tuple(r) for r in sweep.periods_and_gaps(df, ("g",), "s", "e", block_rows=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_periods(rows)
    assert sweep.periods_and_gaps(df.where("false"), ("g",), "s", "e").count() == 0


def test_blocks_of_a_sweep_are_even_whatever_the_times(spark, scratch):
    rows = spark.range(20_000).selectExpr("'g' AS g", "id * 10 AS s", "id * 10 + 5 AS e").union(spark.createDataFrame([("g", -(10**15), -(10**15) + 1), ("g", 10**15, 10**15 + 1)], "g string, s bigint, e bigint"))
    got = sweep.periods_and_gaps(rows, ("g",), "s", "e", block_rows=1000, scratch=scratch)
    assert got.where("kind = 'period'").count() == 20_002 and got.where("kind = 'gap'").count() == 20_001
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch.root}/blocks").groupBy("block").count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 3000


# -- p5 ---------------------------------------------------------------------------------------------


def test_changed_selects_new_and_changed_with_null_keys(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3"), ("d", None), ("e", "5")], "k string, content string")
    state = spark.createDataFrame([("a", "1"), ("b", "x"), (None, "3"), ("d", None)], "k string, content string")
    assert {r.k for r in increments.changed(cur, state, ["k"]).collect()} == {"b", "e"}
    assert increments.changed(cur, state.where("false"), ["k"]).count() == 5
    assert increments.changed(cur.where("false"), state, ["k"]).count() == 0


def test_failed_runs_repeat_and_successful_ones_do_not(spark, store):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, content string")
    seen = []
    t = lambda: increments.ChangeTracker(store, ["k"])
    first = rows(("a", "1"), ("b", "1"))
    t().run(first, lambda df: seen.append({r.k for r in df.collect()}))
    second = rows(("a", "2"), ("b", "1"), ("c", "1"))

    def fail(df):
        seen.append({r.k for r in df.collect()})
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        t().run(second, fail)
    t().run(second, lambda df: seen.append({r.k for r in df.collect()}))
    t().run(second, lambda df: seen.append({r.k for r in df.collect()}))
    assert seen == [{"a", "b"}, {"a", "c"}, {"a", "c"}, set()]
    slow, fast = t(), t()
    slow.pending(second)
    fast.pending(second)
    fast.commit()
    with pytest.raises(CommitConflict):
        slow.commit()
    with pytest.raises(RuntimeError):
        t().commit()
    with pytest.raises(CommitConflict):
        t().adopt(first)


def test_a_record_that_changes_during_the_work_is_selected_by_the_next_run(spark, store, tmp_path):
    now = {"a": "1", "b": "1"}
    t = increments.ChangeTracker(store, ["k"])
    cur = lambda: spark.createDataFrame(list(now.items()), "k string, content string")

    def work(df):
        assert {r.k for r in df.collect()} == {"a", "b"}
        now.update(a="2", b="mine", c="1")
        return spark.createDataFrame([("b", "mine")], "k string, content string")

    t.run(cur(), work)
    # a changed and c came while the work went on; what the work itself made of b is no change
    assert {r.k for r in t.pending(cur()).collect()} == {"a", "c"}


def test_content_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("", "a"), ("a,", "b"), ("a", ",b")], "x string, y string")
    assert df.select(increments.content_hash(["x", "y"])).distinct().count() == 5


def test_overlaps_on_the_grid(spark):
    rng = random.Random(13)
    unit = 3_600_000_000
    rows, reps = [], []
    for k in range(400):
        a = rng.randrange(0, 3000) * unit // 3
        rows.append(("hot" if k % 2 else rng.choice(["p", None]), k, a, a + rng.choice([0, 1, unit, 24 * unit, 800 * unit, 70_000 * unit]), rng.choice([None, rng.randrange(100)])))
    for k in range(200):
        a = rng.randrange(0, 3000) * unit // 3
        reps.append((rng.choice(["hot", "p", None]), a, rng.choice([None, a, a + 1, a + unit // 2, a + 30 * unit, a + 5000 * unit]), rng.choice([None, rng.randrange(100)])))
    left = spark.createDataFrame(rows, "g string, id bigint, a bigint, b bigint, t bigint")
    right = spark.createDataFrame(reps, "g string, a bigint, b bigint, r bigint")
    got = {r.id for r in increments.overlapped_later(left, right, ["g"], ["id"]).collect()}
    want = {i for g, i, a, b, t in rows if t is not None and b > a and any(g is not None and g == h and y is not None and y > x and a < y and x < b and r is not None and t < r for h, x, y, r in reps)}
    assert got == want and want


SH = "pyramid string, tier string, shard_dur string, period_start timestamp, period_end timestamp, key string, written_at timestamp, n_bytes bigint"
WM = "pyramid string, tier string, shard_dur string, latest_period_end timestamp, updated_at timestamp"
INV = "pyramid string, start timestamp, end timestamp, requested_at timestamp"


def test_pending_shards(spark, store):
    d = lambda n: T0 + timedelta(days=n)
    shards = [("a", "q", "1d", d(k), d(k + 1), f"k{k}", d(k + 1), 1) for k in range(6)]
    shards += [("b", "q", "1d", d(0), d(1), "nomark", d(1), 1), ("a", "q", "1d", d(10), None, "nullend", d(2), 1), ("a", "q", "1d", d(1), d(2), "again", d(9), 1), ("a", "q", "1d", d(12), d(11), "reversed", None, 1)]
    marks = [("a", "q", "1d", d(4), d(6)), ("a", "q", "1d", None, d(8)), ("a", "q", "1d", d(9), d(3))]
    inv = [("a", d(2), d(2) + timedelta(hours=1), d(7)), ("a", d(3), None, d(7)), ("a", d(3), d(3), d(7)), ("b", d(3), d(4), d(7)), ("a", d(3), d(4), d(1))]
    got = increments.pending_shards(spark.createDataFrame(shards, SH), spark.createDataFrame(marks, WM), spark.createDataFrame(inv, INV), increments.ChangeTracker(store, increments.SLOT))
    # k4, k5, reversed: beyond the mark; again: rewritten; k2: repair; b: no mark; a null end is not beyond
    assert {r.key for r in got.collect()} == {"k4", "k5", "reversed", "again", "k2", "nomark"}
    empty = increments.pending_shards(spark.createDataFrame([], SH), spark.createDataFrame([], WM), spark.createDataFrame([], INV), increments.ChangeTracker(store, increments.SLOT))
    assert empty.count() == 0


def test_a_later_request_for_a_waiting_shard_is_a_change_and_the_run_s_own_writing_is_none(spark, store):
    d = lambda n: T0 + timedelta(days=n)
    shards = [("a", "q", "1d", d(k), d(k + 1), f"k{k}", d(k + 1), 1) for k in range(3)]
    marks = [("a", "q", "1d", d(3), d(4))]
    request = lambda r: ("a", d(1), d(2), d(r))

    def run(rows, requests, work=lambda df: None):
        t = increments.ChangeTracker(store, increments.SLOT)
        todo = increments.pending_shards(spark.createDataFrame(rows, SH), spark.createDataFrame(marks, WM), spark.createDataFrame(requests, INV), t)
        keys = {r.key for r in todo.collect()}
        t.commit(work(todo))
        return keys

    assert run(shards, [request(5)]) == {"k1"}  # seen, but not rewritten by the run
    assert run(shards, [request(5)]) == set()
    assert run(shards, [request(5), request(6)]) == {"k1"}  # a second request
    again = [s if s[5] != "k1" else (*s[:6], d(8), 2) for s in shards]
    made = lambda df: increments.shard_contents(spark.createDataFrame(again, SH).where("key = 'k1'"), spark.createDataFrame([request(5), request(6), request(7)], INV))
    assert run(shards, [request(5), request(6), request(7)], made) == {"k1"}
    assert run(again, [request(5), request(6), request(7)]) == set()


def test_intervals_meet_at_the_level_of_the_longer_one_only(spark):
    unit = 3_600_000_000
    rows = spark.range(2000).selectExpr("'p' AS g", "id", f"id * {unit} * 10 AS a", f"id * {unit} * 10 + {unit} AS b", "0L AS t")
    reps = spark.range(500).selectExpr("'p' AS g", f"id * {unit} * 40 + {unit // 2} AS a", f"id * {unit} * 40 + {unit} AS b", "1L AS r")
    n = 0
    for left, right in increments._meetings(rows, reps, ["g"]):
        n += left.join(right, (left.g == right.__r_g) & (left.lv == right.__r_lv) & (left.cell == right.__r_cell)).count()
    assert n < 2000 and increments.overlapped_later(rows, reps, ["g"], ["id"]).count() == 500
    # repairs that span a cell are one there
    wide = spark.range(400).selectExpr("'p' AS g", f"-id * {unit} AS a", f"{unit} * 30000 AS b", "id AS r")
    left, right = increments._meetings(rows, wide, ["g"])[1]
    assert right.groupBy("__r_lv", "__r_cell").count().agg({"count": "max"}).first()[0] <= 401
    got = increments.latest_overlap(rows, wide, ["g"], ["id"])
    assert got.count() == 2000 and got.agg({"r": "min"}).first()[0] == 399


def test_hot_keys_are_bounded(spark):
    from binstrata.session import hot_keys

    df = spark.createDataFrame([("hot",)] * 500 + [(f"k{i}",) for i in range(500)] + [(None,)] * 900, "k string")
    assert [r.k for r in hot_keys(df, "k", share=0.1, least=10).collect()] == ["hot"]

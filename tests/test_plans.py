import random
from datetime import datetime

import pytest

from binstrata.functions import timeaxis as ta
from binstrata.functions.monoids import Metric
from binstrata.plans import cover, planner
from binstrata.plans.spec import Limits, PyramidSpec, SpecError, Tier, expand_key, from_mapping, merge_rungs, parse_key

T = ta.to_ms(datetime(2026, 1, 1))
SPEC = PyramidSpec("p", (Tier("q", "15min", ("6h", "1d")), Tier("h", "1h", ("1d", "4d")), Tier("d", "1d", ("4d",))), ("cell",), (Metric("n", "count"),), key_template="p/{tier}/{shard}/{period}.parquet")


def parts(segments, lo, hi):
    at = lo
    for s in segments:
        assert s.lo == at and s.hi > s.lo
        at = s.hi
    assert at == hi


def test_finest_tier_within_the_budget():
    assert planner.pick_tier(SPEC.tiers, T, T + 4 * ta.DAY, 10_000).name == "q"
    assert planner.pick_tier(SPEC.tiers, T, T + 4 * ta.DAY, 96).name == "h"
    assert planner.pick_tier(SPEC.tiers, T, T + 4 * ta.DAY, 1).name == "d"


def test_plan_parts_the_range_and_keys_cover_it():
    random.seed(3)
    for _ in range(200):
        lo = T + random.randrange(0, 96 * 10) * 15 * ta.MINUTE
        hi = lo + random.randrange(1, 96 * 10) * 15 * ta.MINUTE
        p = planner.plan_query(SPEC, lo, hi, random.choice([1, 20, 200, 5000]))
        parts(p.segments, lo, hi)
        assert all(not s.reaggregate for s in p.segments)
        for s in p.segments:
            assert len(s.keys) == ta.bins_in_range(s.lo, s.hi, s.shard_dur)


def test_watermarks_send_the_tail_to_finer_tiers():
    day = ta.floor(T, "4d")
    p = planner.plan_query(SPEC, day, day + 8 * ta.DAY, 8, watermarks={"d@4d": day + 4 * ta.DAY, "h@4d": day + 4 * ta.DAY, "h@1d": day + 6 * ta.DAY})
    assert [(s.tier, s.shard_dur, s.reaggregate) for s in p.segments] == [("d", "4d", False), ("h", "1d", True), ("q", "1d", True)]
    parts(p.segments, day, day + 8 * ta.DAY)
    assert p.authoritative_end is None


def test_live_end():
    p = planner.plan_query(SPEC, T, T + 2 * ta.DAY, 1000, watermarks={"q@6h": T + ta.DAY})
    assert p.authoritative_end == T + ta.DAY and p.segments[-1].hi == T + ta.DAY


def test_earliest_clips():
    p = planner.plan_query(SPEC, T, T + 2 * ta.DAY, 10_000, earliest={"q": T + ta.HOUR})
    assert p.segments[0].lo == T + ta.HOUR


def test_fewest_atoms_by_brute_force():
    def brute(widths, at, end):
        if at == end:
            return 0
        return min((1 + n for w in widths if at % w == 0 and at + w <= end and (n := brute(widths, at + w, end)) is not None), default=None)

    random.seed(5)
    for _ in range(60):
        widths = random.sample([1, 2, 3, 4, 6], random.randrange(1, 4))
        start, size = random.randrange(0, 12), random.randrange(1, 12)
        got = planner.decompose(widths, start, start + size)
        want = brute(widths, start, start + size)
        assert (len(got) if got is not None else None) == want
        if got:
            assert got[0][1] == start and sum(w for w, _ in got) == size and all(a % w == 0 for w, a in got)


def test_target_bins():
    p = planner.plan_query(SPEC, T, T + ta.DAY, 1000, target_bin="6h")
    assert p.output_tier is None and all(s.tier == "h" and s.reaggregate for s in p.segments)
    p = planner.plan_query(SPEC, T, T + 365 * ta.DAY, 1000, target_bin="1mo")
    parts(p.segments, T, T + 365 * ta.DAY)
    assert {s.tier for s in p.segments} == {"d"}
    with pytest.raises(ValueError):
        planner.plan_query(SPEC, T, T + ta.DAY, 1000, target_bin="7min")
    with pytest.raises(planner.PlanLimitError):
        planner.plan_query(SPEC, T, T + 10 * ta.DAY, 5, target_bin="1h")


def test_limits():
    from dataclasses import replace

    for limits in (Limits(max_atoms=1), Limits(max_keys=2)):
        with pytest.raises(planner.PlanLimitError):
            planner.plan_query(replace(SPEC, limits=limits), T, T + 6 * ta.DAY, 10_000)


def test_smoothing_is_snapped():
    s = planner.resolve_smoothing("5h", "1h", T, T + 10 * ta.DAY)
    assert (s.width, s.count, s.lead, s.tail) == ("4h", 4, 2, 1)
    assert planner.resolve_smoothing("30d", "1h", T, T + ta.DAY).count <= 6
    assert planner.resolve_smoothing("3mo", "1mo", T, T + 800 * ta.DAY).count == 3
    assert planner.resolve_smoothing(0, "1h", T, T + 100 * ta.DAY).width == "2d"
    with pytest.raises(ValueError):
        planner.resolve_smoothing("1y", "1mo", T, T + 800 * ta.DAY)


def test_inventory_prefers_tier_rung_start_and_write():
    S = planner.Shard
    day = ta.floor(T, "4d")
    shards = [S("d", "4d", day, day + 4 * ta.DAY, "a", 1), S("h", "1d", day + 4 * ta.DAY, day + 5 * ta.DAY, "b"), S("h", "4d", day + 4 * ta.DAY, day + 8 * ta.DAY, "c")]
    p = planner.plan_from_inventory(SPEC, day, day + 9 * ta.DAY, shards, 9)
    assert [(s.keys, s.hi - s.lo) for s in p.segments] == [(("a",), 4 * ta.DAY), (("c",), 4 * ta.DAY)]
    whole = planner.plan_from_inventory(SPEC, day, day + 9 * ta.DAY, shards, 9, target_bin="2d")
    assert sum(s.hi - s.lo for s in whole.segments) == 8 * ta.DAY
    assert planner.plan_from_inventory(SPEC, day, day + ta.DAY, [], 9).segments == ()


def test_expected_cover_is_disjoint_and_closed():
    random.seed(1)
    for _ in range(100):
        lo = T + random.randrange(0, 4000) * ta.HOUR
        hi = lo + random.randrange(1, 4000) * ta.HOUR
        got = cover.expected_cover(SPEC, lo, hi)
        for tier in SPEC.tiers:
            mine = [e for e in got if e.tier == tier.name]
            for a, b in zip(mine, mine[1:]):
                assert a.period_end == b.period_start
            assert all(e.period_end > lo and e.period_end <= hi for e in mine)
            if len(tier.shards) == 1:
                assert all(e.shard_dur == tier.shards[0] for e in mine)


def test_tiling_and_overlap_cover_leave_only_what_does_not_exist():
    tier = Tier("d", "1d", ("1d", "1mo", "1y"))
    lo, hi = ta.to_ms(datetime(2026, 1, 1)), ta.to_ms(datetime(2027, 1, 1))
    genesis = ta.to_ms(datetime(2026, 1, 20))
    absent = ta.to_ms(datetime(2026, 8, 10))
    months = {ta.to_ms(datetime(2026, m, 1)) for m in (2, 3, 5)}
    there = lambda s, a: (s == "1mo" and a in months) or (s == "1d" and a != absent)
    picks, holes = cover.tile_existing(tier, lo, hi, "1y", there, genesis)
    assert holes == [(absent, absent + ta.DAY)]
    assert sum(1 for s, _, _ in picks if s == "1mo") == 3
    covered = sum(b - a for _, a, b in picks)
    assert covered == hi - genesis - ta.DAY
    picks, holes = cover.overlap_cover(Tier("h", "1h", ("1d", "4d")), T + 5, T + 9 * ta.DAY, lambda s, a: (a // ta.DAY) % 3 == 0)
    edges = sorted([(a, b) for _, _, a, b in picks] + holes)
    assert edges[0][0] == T + 5 and edges[-1][1] == T + 9 * ta.DAY and all(x[1] == y[0] for x, y in zip(edges, edges[1:]))


def test_buildable_and_order():
    assert cover.build_order(SPEC) == [("q", None), ("h", "q"), ("d", "h")]
    assert cover.build_layers(SPEC) == [["q"], ["h"], ["d"]]
    assert cover.buildable_at(SPEC, "q", T + 5) == T + 5
    assert cover.buildable_at(SPEC, "d", T + 5) == T + ta.DAY
    assert '"h" -> "d"' in cover.plan_dot(SPEC)


def test_dyadic_blocks():
    for lo in range(20):
        for hi in range(lo, 40):
            b = cover.dyadic_blocks(lo, hi)
            assert [x for s, n in b for x in range(s, s + n)] == list(range(lo, hi))
            assert all(s % n == 0 and n & (n - 1) == 0 for s, n in b)
    assert cover.sealed_groups(17, size=8) == [(0, 8), (8, 8)]


def test_declarations():
    good = {"tiers": [{"name": "q", "bin": "15min", "shards": ["6h", "1d"]}], "dims": [{"name": "x", "type": "int"}], "metrics": [{"name": "n", "monoid": "count"}], "geo": {"resolutions": [9, 7], "cellCol": "cell"}, "identityRollup": {"map": "m"}, "multiScan": {"scheme": "fixed", "groupSize": 4}}
    spec = from_mapping(good)
    assert spec.rollup["col"] == "cell" and spec.state_columns == ["n"]
    bad = [{"axis": "space"}, {"dims": [{"name": "x", "type": "blob"}]}, {"metrics": [{"name": "n", "monoid": "nope"}]}, {"geo": {"resolutions": [7, 9]}}, {"geo": {"resolutions": [True]}}, {"identityRollup": {}}, {"multiScan": {"scheme": "odd"}}, {"multiScan": {"groupSize": 0}}, {"keyTemplate": "{tier}/{period}"}, {"keyTemplate": "{shard}{hash:4}"}, {"tiers": [{"name": "q", "bin": "7h", "shards": ["1d"]}]}]
    for change in bad:
        with pytest.raises(SpecError):
            from_mapping({**good, **change})
    assert merge_rungs(spec, {"q": ["4d"]}).tiers[0].shards == ("6h", "1d", "4d")


def test_keys_round_trip():
    t = "{cell}/{tier}/{shard}/{period}.{hash:8}.parquet"
    key = expand_key(t, cell="c1", tier="q", shard="1d", period="2026-01-02", hash="0123456789abcdef")
    assert key == "c1/q/1d/2026-01-02.01234567.parquet"
    assert parse_key(t, key)["period"] == "2026-01-02"
    assert parse_key(t, "other") is None
    assert expand_key(t, cell="c1", tier="q", shard="1d", period="2026-01-02") == "c1/q/1d/2026-01-02.parquet"

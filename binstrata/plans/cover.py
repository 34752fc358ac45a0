"""Which shards ought to exist, and how a period is put together from those that do.

Everything here is arithmetic on the driver over the few shards of a range; :func:`expected_table`
hands the result to DataFrame queries.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from binstrata.functions import timeaxis as ta
from binstrata.plans.spec import PyramidSpec, Tier, expand_key


class Expected(NamedTuple):
    tier: str
    shard_dur: str
    period_start: int
    period_end: int
    effective_start: int
    effective_end: int
    key: str


def slot_key(spec: PyramidSpec, tier: str, shard: str, start: int, **dims: str) -> str:
    return expand_key(spec.key_template, tier=tier, shard=shard, period=ta.label(start, shard), **dims)


def expected_cover(spec: PyramidSpec, lo: int, hi: int, **dims: str) -> list[Expected]:
    """The least cover of ``[lo, hi)`` by each tier: closed periods of the largest rung, then for the
    open one the largest smaller rungs that fit, one after the other. A rest smaller than the smallest
    rung is not expected. Effective bounds are the periods' own, clipped to the range."""
    out = []
    for tier in spec.tiers:
        top = tier.shards[-1]
        turn = ta.floor(hi, top)
        found = [(top, a, b) for a, b, _ in ta.periods(lo, turn, top)] if lo < turn else []
        at = turn
        while at < hi:
            fits = [s for s in tier.shards[:-1] if ta.floor(at, s) == at and ta.add(at, s) <= hi]
            if not fits:
                break
            end = ta.add(at, fits[-1])
            if end > lo:
                found.append((fits[-1], at, end))
            at = end
        out += [Expected(tier.name, s, a, b, max(a, lo), min(b, hi), slot_key(spec, tier.name, s, a, **dims)) for s, a, b in found]
    return out


def expected_table(spark: SparkSession, spec: PyramidSpec, lo: int, hi: int) -> DataFrame:
    """:func:`expected_cover` as a DataFrame."""
    schema = "tier string, shard_dur string, period_start bigint, period_end bigint, effective_start bigint, effective_end bigint, key string"
    return spark.createDataFrame([tuple(e) for e in expected_cover(spec, lo, hi)], schema)


def tile_existing(tier: Tier, lo: int, hi: int, shard: str, exists: Callable[[str, int], bool], genesis: int) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Put a period together from existing shards of the same tier, the largest first: ``(picks,
    holes)``. Whatever ends before ``genesis`` is no hole."""
    width = ta.parse(shard).nominal_ms
    rungs = [s for s in tier.shards if ta.parse(s).nominal_ms < width]
    picks: list[tuple[str, int, int]] = []
    holes: list[tuple[int, int]] = []
    todo = [(lo, hi, len(rungs) - 1)]
    while todo:
        a, b, k = todo.pop()
        if b <= genesis or a >= b:
            continue
        if k < 0:
            holes.append((a, b))
            continue
        slots = []
        at = ta.ceil(a, rungs[k])
        while (end := ta.add(at, rungs[k])) <= b:
            slots.append((at, end))
            at = end
        edges = [a, *(x for s in slots for x in s), b] if slots else []
        if not slots:
            todo.append((a, b, k - 1))
            continue
        todo.append((a, edges[1], k - 1))
        todo.append((slots[-1][1], b, k - 1))
        for s, e in slots:
            if e <= genesis:
                continue
            if exists(rungs[k], s):
                picks.append((rungs[k], s, e))
            else:
                todo.append((s, e, k - 1))
    return sorted(picks, key=lambda p: p[1]), sorted(holes)


def overlap_cover(tier: Tier, lo: int, hi: int, exists: Callable[[str, int], bool]) -> tuple[list[tuple[str, int, int, int]], list[tuple[int, int]]]:
    """Cover ``[lo, hi)`` with existing shards of any rung, the coarsest first, also by those that only
    overlap it: ``(picks, holes)``, a pick being ``(shard, slot, from, to)``. Picks are disjoint."""
    open_, picks = [(lo, hi)], []
    for shard in reversed(tier.shards):
        left: list[tuple[int, int]] = []
        for a, b in open_:
            at = a
            for s, e, _ in ta.periods(a, b, shard):
                if not exists(shard, s):
                    continue
                x, y = max(at, s), min(b, e)
                if at < x:
                    left.append((at, x))
                picks.append((shard, s, x, y))
                at = y
            if at < b:
                left.append((at, b))
        open_ = left
    return sorted(picks, key=lambda p: p[2]), sorted(open_)


def source_tier(spec: PyramidSpec, name: str) -> Tier | None:
    """The coarsest finer tier whose bins divide those of a tier; None for the base."""
    names = [t.name for t in spec.tiers]
    k = names.index(name)
    return next((t for t in reversed(spec.tiers[:k]) if ta.divides(t.bin, spec.tiers[k].bin)), None)


def buildable_at(spec: PyramidSpec, name: str, end: int) -> int:
    """When a shard ending at ``end`` can be built: once the smallest source shard that holds its tail
    has closed and can be built itself."""
    src = source_tier(spec, name)
    while src is not None:
        end = ta.ceil(end, src.shards[0])
        src = source_tier(spec, src.name)
    return end


def build_order(spec: PyramidSpec) -> list[tuple[str, str | None]]:
    """``(tier, source tier)`` in an order in which every source comes first."""
    return [(t.name, s.name if (s := source_tier(spec, t.name)) else None) for t in spec.tiers]


def build_layers(spec: PyramidSpec) -> list[list[str]]:
    """Tiers by their distance from the base: those of a layer can be built side by side."""
    depth: dict[str, int] = {}
    for t, s in build_order(spec):
        depth[t] = 0 if s is None else depth[s] + 1
    return [[t for t in depth if depth[t] == k] for k in range(max(depth.values()) + 1)]


def plan_dot(spec: PyramidSpec) -> str:
    """The build plan as a Graphviz graph."""
    edges = [f'  "{s or "raw"}" -> "{t}";' for t, s in build_order(spec)]
    return "\n".join(["digraph build {", *edges, "}"])


def dyadic_blocks(lo: int, hi: int, base: int = 2) -> list[tuple[int, int]]:
    """``(start, size)``: the fewest aligned blocks, of sizes that are powers of ``base``, that part
    ``[lo, hi)``."""
    out = []
    while lo < hi:
        size = 1
        while lo % (size * base) == 0 and lo + size * base <= hi:
            size *= base
        out.append((lo, size))
        lo += size
    return out


def sealed_groups(n: int, scheme: str = "fixed", size: int = 8, base: int = 2) -> list[tuple[int, int]]:
    """``(start, size)`` of the archives that ``n`` scans are consolidated into: full groups of one size,
    or the dyadic blocks of ``[0, n)``. Scans of a group that is not full stay single under ``fixed``."""
    if scheme == "fixed":
        return [(k, size) for k in range(0, n - size + 1, size)]
    return dyadic_blocks(0, n, base)


def missing(expected: Collection[Expected], existing: Collection[tuple[str, str, int]]) -> list[Expected]:
    """Expected shards that do not exist, sources before what is built from them."""
    have = set(existing)
    return [e for e in expected if (e.tier, e.shard_dur, e.period_start) not in have]

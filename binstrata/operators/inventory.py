"""Inventory of shards against what ought to exist: gaps, staleness, collection, readiness, health.

Periods are epoch milliseconds. Registries are one row for each slot (see ``live_rows``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.plans.spec import PyramidSpec

SLOT = ["tier", "shard_dur", "period_start"]
GRACE_MS = 6 * ta.HOUR
PENDING_GRACE_MS = 10 * ta.MINUTE


def _slot(*tables: DataFrame) -> list[str]:
    """A slot's columns, with the pyramid where every table has it: a shard of one pyramid fills no gap of
    another."""
    return ["pyramid", *SLOT] if all("pyramid" in t.columns for t in tables) else SLOT


def gaps(expected: DataFrame, registered: DataFrame) -> DataFrame:
    """Expected shards that are not registered, by pyramid if both tables have it."""
    slot = _slot(expected, registered)
    return expected.join(registered.select(*slot), slot, "left_anti")


def stale(registered: DataFrame, requests: DataFrame, by: Sequence[str] = ("pyramid",)) -> DataFrame:
    """Registered shards that a request of their pyramid overlaps with a later ``requested_at``; an unknown
    time of writing counts as fresh. Periods in ``a``, ``b``, times in ``t`` and ``r``."""
    from binstrata.operators.increments import overlapped_later

    scaled = lambda df, cols: df.withColumns({c: F.col(c) * 1000 for c in cols})
    key = [*by, "tier", "shard_dur", "period_start"]
    rows = registered.select(*key, F.col("period_start").alias("a"), F.col("period_end").alias("b"), F.col("written_at").alias("t"))
    hit = overlapped_later(scaled(rows, ("a", "b", "t")), scaled(requests, ("a", "b", "r")), list(by), key)
    return registered.join(hit, key, "left_semi")


def spent_requests(requests: DataFrame, registered: DataFrame, by: Sequence[str] = ("pyramid",)) -> DataFrame:
    """Requests that no stale shard waits for any more; they can be dropped."""
    from binstrata.operators.increments import overlapped_later

    # the other way round: a request is alive if a shard overlaps it that was written before it; requests
    # that are alike share their fate, so their values are the key
    neg = lambda c: -F.col(c) * 1000
    named = requests.select(*by, *[F.col(c).alias(f"__{c}") for c in ("a", "b", "r")], (F.col("a") * 1000).alias("a"), (F.col("b") * 1000).alias("b"), neg("r").alias("t"))
    right = registered.select(*by, (F.col("period_start") * 1000).alias("a"), (F.col("period_end") * 1000).alias("b"), neg("written_at").alias("r"))
    alive = overlapped_later(named.distinct(), right, list(by), [*by, "__a", "__b", "__r"]).withColumnsRenamed({c: f"__{c}" for c in by})
    on = F.lit(True)
    for c in (*by, "a", "b", "r"):
        on = on & requests[c].eqNullSafe(F.col(f"__{c}"))
    return requests.join(alive, on, "left_anti")


def collectable(registered: DataFrame, expected: DataFrame, now: int, raw_prefixes: Sequence[str] = (), grace: int = GRACE_MS, limit: int | None = None) -> DataFrame:
    """``(*registered, verdict)`` for rows not in the expected cover and under no raw prefix: ``delete``,
    or why not. A row whose period has not ended goes once it was written ``grace`` ago; others once
    they ended ``grace`` ago and a longer shard of their tier contains them. ``limit`` keeps the
    deletes of a sweep to the oldest."""
    rest = registered.join(expected.select("key"), "key", "left_anti")
    for p in raw_prefixes:
        rest = rest.where(~F.col("key").startswith(p))
    width = F.create_map(*[x for s in ("min", "h", "d", "mo", "y") for x in (F.lit(s), F.lit(ta.Span(1, s).nominal_ms))])
    nominal = lambda c: F.regexp_extract(c, r"^(\d+)", 1).cast("long") * width[F.regexp_extract(c, r"([a-z]+)$", 1)]
    # a parent contains the child's start: points meet intervals on the grid, at the parents' own level
    from binstrata.operators.increments import _cells

    points = rest.select("key", "tier", nominal("shard_dur").alias("w"), (F.col("period_start") * 1000).alias("a"), (F.col("period_start") * 1000 + 1).alias("b"), (F.col("period_end") * 1000).alias("e"))
    homes = registered.select(F.col("tier").alias("__t"), nominal("shard_dur").alias("__w"), (F.col("period_start") * 1000).alias("__a"), (F.col("period_end") * 1000).alias("__b")).where(F.col("__b") > F.col("__a"))
    homes = _cells(homes, "__a", "__b", 0, 0).withColumnsRenamed({"lv": "__lv", "cell": "__cell"})
    on = (F.col("tier") == F.col("__t")) & (F.col("lv") == F.col("__lv")) & (F.col("cell") == F.col("__cell")) & (F.col("__w") > F.col("w")) & (F.col("__a") <= F.col("a")) & (F.col("__b") >= F.col("e"))
    covered = _cells(points, "a", "b").join(homes, on, "left_semi").select(F.col("key").alias("__ck")).distinct()
    rest = rest.join(covered, F.col("key") == F.col("__ck"), "left")
    verdict = (
        F.when((F.col("period_end") > now) & (F.col("written_at") + grace > now), "future period within grace")
        .when((F.col("period_end") <= now) & (F.col("period_end") + grace > now), "within grace")
        .when((F.col("period_end") <= now) & F.col("__ck").isNull(), "no covering parent")
        .otherwise("delete")
    )
    out = rest.withColumn("verdict", verdict).drop("__ck")
    if limit is not None:
        top = out.where(F.col("verdict") == "delete").orderBy("period_end", "key").limit(limit).select(F.col("key").alias("__k"))
        out = out.join(top, F.col("key") == F.col("__k"), "left").withColumn("verdict", F.when((F.col("verdict") == "delete") & F.col("__k").isNull(), "budget").otherwise(F.col("verdict"))).drop("__k")
    return out


def orphans(stored: DataFrame, referenced: DataFrame, now: int, grace: int = GRACE_MS) -> DataFrame:
    """Stored files, ``(key, mtime)``, that no registry row names and that are older than the grace."""
    return stored.join(referenced.select("key"), "key", "left_anti").where(F.col("mtime") + grace <= now)


def adoptable(stored: DataFrame, registered: DataFrame) -> DataFrame:
    """Stored slots that are not registered: what reconciliation appends to the registry."""
    return gaps(stored, registered)


def watermarks(registered: DataFrame) -> DataFrame:
    """How far each tier and rung, of each pyramid if there are several, is registered; older shards never
    lower it."""
    by = [c for c in _slot(registered) if c != "period_start"]
    return registered.groupBy(*by).agg(F.max("period_end").alias("latest_period_end"))


def list_shards(registered: DataFrame, tier: str | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Registered shards of a tier that overlap a range; filters that a scan can push down."""
    out = registered if tier is None else registered.where(F.col("tier") == tier)
    out = out if lo is None else out.where(F.col("period_end") > lo)
    return out if hi is None else out.where(F.col("period_start") < hi)


def source_cover(gap_table: DataFrame, registered: DataFrame, spec: PyramidSpec, by: Sequence[str] = ()) -> DataFrame:
    """For each gap ``(*by, tier, shard_dur, period_start, period_end)``, how much of it the registered shards
    of its source tier, with the same ``by``, cover: ``covered`` and ``uncovered`` ms and the number of picks."""
    from binstrata.plans.cover import source_tier

    pairs = [(t.name, s.name) for t in spec.tiers if (s := source_tier(spec, t.name))]
    out = None
    for tier, src in pairs:
        one = gap_table.where(F.col("tier") == tier).withColumn("source", F.lit(src))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return gap_table.where(F.lit(False)).select(*by, *SLOT, "period_end", F.lit("").alias("source"), F.lit(0).alias("picks"), F.lit(0).alias("covered"), F.lit(0).alias("uncovered"))
    r = registered.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("tier").alias("__t"), F.col("period_start").alias("__s"), F.col("period_end").alias("__e"), F.col("shard_dur").alias("__d"))
    day = ta.DAY
    gap_cells = out.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("period_start") / day), F.floor((F.col("period_end") - 1) / day))))
    r_cells = r.withColumn("__rcell", F.explode(F.sequence(F.floor(F.col("__s") / day), F.floor((F.col("__e") - 1) / day))))
    on = (F.col("source") == F.col("__t")) & (F.col("__cell") == F.col("__rcell")) & (F.col("__s") < F.col("period_end")) & (F.col("period_start") < F.col("__e"))
    for c in by:
        on = on & (F.col(c) == F.col(f"__by_{c}"))
    hits = gap_cells.join(r_cells, on)
    hits = hits.select(*by, *SLOT, "period_end", "source", "__d", F.greatest("__s", "period_start").alias("a"), F.least("__e", "period_end").alias("b")).distinct()
    from binstrata.operators.sweep import periods_and_gaps

    key = [*by, *SLOT, "period_end", "source"]
    n = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("picks"))
    merged = periods_and_gaps(hits, tuple(key), "a", "b").where("kind = 'period'").groupBy(*key).agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    res = out.select(*key).join(n, key, "left").join(merged, key, "left")
    total = F.col("period_end") - F.col("period_start")
    return res.select(*key, F.coalesce("picks", F.lit(0)).alias("picks"), F.coalesce("covered", F.lit(0)).alias("covered"), (total - F.coalesce("covered", F.lit(0))).alias("uncovered"))


def cover_status(expected: DataFrame, registered: DataFrame, buildable: Column, now: int, grace: int = PENDING_GRACE_MS, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, tier, shard_dur, period_start, period_end, status)``: ``present``, ``pending`` while a shard could
    not have been built for longer than ``grace``, ``missing``; and ``stale`` for registered slots that
    are no part of the cover."""
    key = [*by, *SLOT]
    have = registered.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("period_end").alias("__end"))
    on = F.lit(True)
    for c in key:
        on = on & (F.col(c) == F.col(f"__{c}"))
    both = expected.withColumn("__ready", buildable).join(have, on, "full_outer")
    status = F.when(F.col("tier").isNull(), "stale").when(F.col("__tier").isNotNull(), "present").when(F.col("__ready") > now - grace, "pending").otherwise("missing")
    return both.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in key], F.coalesce("period_end", "__end").alias("period_end"), status.alias("status"))

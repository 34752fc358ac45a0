"""Incremental processing: exactly the records that are new or changed since the last successful run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binstrata.operators.registry import SLOT, live_rows, null_safe
from binstrata.sources.store import VersionedStore

#: Cell widths (microseconds) of the grid on which intervals meet: each 16 times the one before, 1 h to 7.5 y.
LEVELS = tuple(3_600_000_000 * 16**k for k in range(5))

#: Number of repairs up to which their cells are broadcast.
BROADCAST_REPAIRS = 20_000


def content_hash(columns: Sequence[str | Column]) -> Column:
    """sha2-256 of the columns' values as JSON; nulls keep their place, so that (null, 'a') and
    ('a', null) differ."""
    fields = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000null")) for c in columns]
    return F.sha2(F.to_json(F.array(*fields)), 256)


def changed(current: DataFrame, state: DataFrame, key: Sequence[str], content: str = "content") -> DataFrame:
    """Rows of ``current`` whose key is not in ``state`` or whose content hash differs.

    ``state`` has the key columns and ``content``, one row for each key. Null keys match null keys.
    An empty state selects every row.
    """
    known = state.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.col(content).alias("__content"), F.lit(True).alias("__known"))
    on = F.lit(True)
    for c in key:
        on = on & current[c].eqNullSafe(F.col(f"__k_{c}"))
    both = current.join(known, on, "left")
    return both.where(F.col("__known").isNull() | ~F.col(content).eqNullSafe(F.col("__content"))).select(*current.columns)


class ChangeTracker:
    """State of key and content hash, kept in a versioned store and swapped atomically.

    ``pending`` stages what it has seen and selects from that; ``commit`` publishes what was staged after
    the caller's work is done, so that a record that changes while the work goes on is selected by the next
    run. A run that dies between the two has published nothing, so the next run selects the same rows
    again; a run whose state has been overtaken gets ``CommitConflict`` and publishes nothing.
    """

    def __init__(self, store: VersionedStore, key: Sequence[str], content: str = "content"):
        self.store, self.key, self.content = store, list(key), content
        self.base = store.latest()
        self.staged: str | None = None

    def state(self) -> DataFrame | None:
        """The newest committed state ``(*key, content)``, or None before the first commit."""
        meta = self.store.meta()
        return self.store.spark.read.parquet(meta["state"]).select(*self.key, self.content) if meta else None

    def adopt(self, state: DataFrame) -> int:
        """Publish a state ``(*key, content)`` that another bookkeeping of successful runs tells of, as the
        first version. Raises ``CommitConflict`` if there is one."""
        path = self.store.write(state.select(*self.key, self.content), "state")
        self.base = self.store.commit(0, {"state": path, "paths": [path]})
        return self.base

    def pending(self, current: DataFrame) -> DataFrame:
        """Rows to process now: those of ``current``, as it is at this moment, that are new or changed."""
        self.base = self.store.latest()
        self.staged = self.store.write(current, "state")
        seen = self.store.spark.read.schema(current.schema).parquet(self.staged)
        state = self.state()
        return seen if state is None else changed(seen, state, self.key, self.content)

    def commit(self, left: DataFrame | None = None) -> int:
        """Publish the state of the run that just succeeded: what ``pending`` saw, but for the records that
        the work itself rewrote, ``left`` ``(*key, content)``, one row each: these as the work left them. If
        somebody else rewrites such a record too, its content differs from that and it is selected again."""
        if self.staged is None:
            raise RuntimeError("nothing was selected")
        path, paths = self.staged, [self.staged]
        if left is not None:
            mine = left.select(*self.key, self.content)
            names = mine.select(*[F.col(c).alias(f"__l_{c}") for c in self.key])
            seen = self.store.spark.read.parquet(self.staged).select(*self.key, self.content)
            on = F.lit(True)
            for c in self.key:
                on = on & F.col(c).eqNullSafe(F.col(f"__l_{c}"))
            path = self.store.write(seen.join(names, on, "left_anti").unionByName(mine), "state")
            paths.append(path)
        version = self.store.commit(self.base, {"state": path, "paths": paths})
        self.base, self.staged = version, None
        return version

    def run(self, current: DataFrame, work: Callable[[DataFrame], DataFrame | None]) -> int:
        """Select, work, commit. ``work`` gives the contents of the records that it rewrote, if any."""
        return self.commit(work(self.pending(current)))


def marks(watermarks: DataFrame) -> DataFrame:
    """The mark of each ``(pyramid, tier, shard_dur)``: its row with the greatest ``updated_at`` among
    those with a ``latest_period_end`` (a null ``updated_at`` counts as oldest)."""
    known = watermarks.where(F.col("latest_period_end").isNotNull())
    return live_rows(known.select("pyramid", "tier", "shard_dur", "updated_at", "latest_period_end"), ("pyramid", "tier", "shard_dur"), "updated_at")


def _own_level(a: str, b: str) -> Column:
    """The first level whose cells are at least as wide as the interval."""
    level = F.lit(len(LEVELS) - 1)
    for k in range(len(LEVELS) - 2, -1, -1):
        level = F.when(F.col(b) - F.col(a) <= LEVELS[k], k).otherwise(level)
    return level


def _width(level: str) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in LEVELS]), F.col(level) + 1)


def _cells(df: DataFrame, a: str, b: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Explode half-open intervals (microseconds) ``[a, b)`` to the cells they touch, as ``lv`` and ``cell``:
    at the levels from ``first`` above their own (see :func:`_own_level`, two cells at most but for the widest
    level) to ``last`` above it, or to the widest."""
    df = df.withColumn("lv", _own_level(a, b))
    top = F.lit(len(LEVELS) - 1)
    if (first, last) != (0, 0):
        to = top if last is None else F.least(top, F.col("lv") + last)
        fits = F.col("lv") + first <= to
        df = df.withColumn("lv", F.explode(F.when(fits, F.sequence(F.col("lv") + first, to)).otherwise(F.array().cast("array<int>"))))
    return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / _width("lv")), F.floor((F.col(b) - 1) / _width("lv")))))


def _meetings(left: DataFrame, right: DataFrame, by: Sequence[str]) -> list[tuple[DataFrame, DataFrame]]:
    """Two pairs of sides with keys ``(*by, lv, cell)`` in which each two overlapping intervals meet once for
    each cell they share: at the level of the left one, if that is not the shorter, else at that of the
    right one. Right intervals are clipped to their cell, and of those alike only the greatest ``r`` stays,
    so all that span a cell are one."""
    out = []
    for l, r in ((_cells(left, "a", "b", 0, 0), _cells(right, "a", "b")), (_cells(left, "a", "b", 1), _cells(right, "a", "b", 0, 0))):
        lo, hi = F.col("cell") * _width("lv"), (F.col("cell") + 1) * _width("lv")
        clipped = r.select(*by, "lv", "cell", F.greatest("a", lo).alias("a"), F.least("b", hi).alias("b"), "r").groupBy(*by, "lv", "cell", "a", "b").agg(F.max("r").alias("r"))
        out.append((l, clipped.select(*[F.col(c).alias(f"__r_{c}") for c in (*by, "lv", "cell")], F.col("a").alias("__a"), F.col("b").alias("__b"), "r")))
    return out


def latest_overlap(rows: DataFrame, repairs: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``(*key, r)``: of each of ``rows`` (``a``, ``b``, ``t`` in microseconds) that repairs (``a``, ``b``, ``r``) of the
    same ``by`` overlap with ``t < r``, the greatest such ``r``.

    Both sides meet on a grid of several widths, each pair at the level of its longer member: the longer
    side lies in the cells of its own level only, the shorter one in those of the levels above, by two
    joins with equality keys that split even a group that holds a third of all rows. Neither join matches
    two intervals that are both short of the cell. Up to ``BROADCAST_REPAIRS`` repairs are broadcast. Rows and repairs with nulls in a, b, t, r or reversed
    bounds never match.
    """
    left = rows.where((F.col("b") > F.col("a")) & F.col("t").isNotNull()).select(*by, *[F.col(c).alias(f"__k_{c}") for c in key], "a", "b", "t")
    right = repairs.where((F.col("b") > F.col("a")) & F.col("r").isNotNull())
    right = right.groupBy(*by, "a", "b").agg(F.max("r").alias("r"))  # of repairs of one range only the latest request matters
    # counted: then they have ten cells each, but for intervals of more than 7.5 years
    few = right.count() <= BROADCAST_REPAIRS
    out = None
    for l, r in _meetings(left, right, by):
        r = F.broadcast(r) if few else r
        on = (F.col("a") < F.col("__b")) & (F.col("__a") < F.col("b")) & (F.col("t") < F.col("r"))
        for c in (*by, "lv", "cell"):
            on = on & (F.col(c) == F.col(f"__r_{c}"))
        hits = l.join(r, on).select(*[F.col(f"__k_{c}").alias(c) for c in key], "r")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy(*key).agg(F.max("r").alias("r"))


def overlapped_later(rows: DataFrame, repairs: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Keys of ``rows`` that a repair of the same ``by`` overlaps with ``t < r``, each once (see
    :func:`latest_overlap`)."""
    return latest_overlap(rows, repairs, by, key).select(*key)


def shard_contents(live: DataFrame, repairs: DataFrame) -> DataFrame:
    """The live rows with ``waiting``, the time of the latest repair requested after the file was written
    (microseconds, null if none waits), and ``content``: the hash of what a run reads of a slot, its file's
    version (key, size, end, time written) and that time, so that a further request is a change as well."""
    rows = live.select(*SLOT, F.unix_micros("period_start").alias("a"), F.unix_micros("period_end").alias("b"), F.unix_micros("written_at").alias("t"))
    req = repairs.select("pyramid", F.unix_micros("start").alias("a"), F.unix_micros("end").alias("b"), F.unix_micros("requested_at").alias("r"))
    hit = latest_overlap(rows, req, ["pyramid"], SLOT)
    hit = hit.select(*[F.col(c).alias(f"__h_{c}") for c in SLOT], F.col("r").alias("waiting"))
    on = F.lit(True)
    for c in SLOT:
        on = on & live[c].eqNullSafe(F.col(f"__h_{c}"))
    return live.join(hit, on, "left").select(*live.columns, "waiting").withColumn("content", content_hash([*_version(), F.col("waiting")]))


def _version() -> list[Column]:
    return [F.col("key"), F.col("n_bytes"), F.unix_micros("period_end"), F.unix_micros("written_at")]


def state_from_marks(shards: DataFrame, watermarks: DataFrame) -> DataFrame:
    """``(*slot, content)``: the state as the last successful run left it, read from its marks and from the
    registrations of its time: every slot up to the mark's ``latest_period_end``, with the content of the row
    that was live at ``updated_at`` and no repair waiting. Comparisons with a null are not met, so a row with
    a null end or time counts as seen, and a mark with a null time saw the row of today."""
    mark = marks(watermarks).withColumnsRenamed({c: f"__m_{c}" for c in ("pyramid", "tier", "shard_dur")})
    on = F.lit(True)
    for c in ("pyramid", "tier", "shard_dur"):
        on = on & shards[c].eqNullSafe(F.col(f"__m_{c}"))
    known = shards.join(mark, on).where(~F.coalesce(F.col("written_at") > F.col("updated_at"), F.lit(False)))
    then = live_rows(known.select(*shards.columns, "latest_period_end"))
    seen = then.where(~F.coalesce(F.col("period_end") > F.col("latest_period_end"), F.lit(False)))
    return seen.select(*SLOT, content_hash([*_version(), F.lit(None)]).alias("content"))


def pending_shards(shards: DataFrame, watermarks: DataFrame, repairs: DataFrame, tracker: ChangeTracker) -> DataFrame:
    """The live rows that are new, rewritten or awaiting repair since the last successful run. Before the
    tracker's first commit the state is read from the marks, and published as its first version."""
    if not tracker.store.latest():
        tracker.adopt(state_from_marks(shards, watermarks))
    path = tracker.store.write(live_rows(shards), "live")  # read three times
    live = tracker.store.spark.read.schema(shards.schema).parquet(path)
    todo = tracker.pending(shard_contents(live, repairs))
    tracker.store.discard(path)
    return todo


__all__ = ["ChangeTracker", "changed", "content_hash", "latest_overlap", "live_rows", "marks", "null_safe", "overlapped_later", "pending_shards", "shard_contents", "state_from_marks"]

"""Full history of changing objects from periodic snapshots, by comparing Merkle trees.

Every snapshot has a tree over hashed key buckets: a leaf's hash is the sum of the hashes of its
``(object, state)`` pairs, an inner node's the sum of its children's. A history keeps the tree of the newest
snapshot of each dataset, and a log of versions in which nothing is ever rewritten. A run over further
snapshots builds their trees, descends from the root into the branches of the first one that differ from the
stored tree, reads the open versions of the leaves it arrives at and of no others, and appends what opened
and what closed. Among the snapshots of one run a tree is held as its differences from the one before:
sums can be built by partial aggregation from rows that cover several snapshots, as a row adds its hash at its
first snapshot and takes it away after its last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from binstrata.operators.archives import presence, scan_catalog, segments
from binstrata.session import Scratch, broadcast_if_small, observed
from binstrata.sources.store import VersionedStore

FANOUT = 16
_SUMS = ("n", "h1", "h2")
_OBJECT = ("dataset", "dt", "path")


def _leaf(levels: int) -> Column:
    return F.pmod(F.xxhash64("dt", "path"), F.lit(FANOUT**levels))


def _differs(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n") != 0) | (F.col(f"{prefix}h1") != 0) | (F.col(f"{prefix}h2") != 0)


def tree_levels(rows: DataFrame, per_leaf: int = 64, most: int = 7) -> int:
    """Levels below the root that give leaves of about ``per_leaf`` rows in the largest dataset. An archive
    has about one row for each object and state, so for archives the largest one serves as the measure."""
    largest = rows.groupBy("dataset").count().agg(F.max("count")).first()[0] or 1
    return min(most, max(1, math.ceil(math.log(max(1, largest / per_leaf), FANOUT))))


def leaf_events(rows: DataFrame) -> DataFrame:
    """``(dataset, scan, leaf, n, h1, h2)``: by how much each leaf of each snapshot's tree differs from the
    snapshot before, an absent one counting as empty; equal leaves are left out.

    ``rows``: presences with ``leaf``, ``lo``, ``hi`` and the last snapshot ``to``. The hash has two sums of 31 bits
    each, so that 2^32 rows can't overflow. Repeated rows only weigh more; a leaf is equal exactly if no
    pair's weight changed (but for chance, 2^-62).
    """
    h = F.xxhash64("dt", "path", "b", "o")
    signed = rows.select("dataset", "leaf", "lo", "hi", "to", h.bitwiseAND(0x7FFFFFFF).alias("h1"), F.shiftrightunsigned(h, 33).alias("h2"))
    event = lambda scan, sign: F.struct(scan.alias("scan"), F.lit(sign).alias("n"), (F.col("h1") * sign).alias("h1"), (F.col("h2") * sign).alias("h2"))
    both = F.array_compact(F.array(event(F.col("lo"), 1), F.when(F.col("hi") < F.col("to"), event(F.col("hi") + 1, -1))))
    return signed.select("dataset", "leaf", F.explode(both).alias("e")).select("dataset", "leaf", "e.*").groupBy("dataset", "scan", "leaf").agg(*[F.sum(c).alias(c) for c in _SUMS]).where(_differs())


def tree(leaves: DataFrame, levels: int) -> DataFrame:
    """``(level, dataset, node, n, h1, h2)``: all nodes, from the root (level 0) to the leaves."""
    up = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("leaf") / FANOUT ** (levels - k)).cast("long").alias("node")) for k in range(levels + 1)]))
    return leaves.select("dataset", up.alias("x"), *_SUMS).groupBy("x.level", "dataset", "x.node").agg(*[F.sum(c).alias(c) for c in _SUMS]).where(_differs())


def descend(old: DataFrame, new: DataFrame, levels: int) -> DataFrame:
    """``(dataset, leaf)``: the leaves in which two trees differ. From the root on, only children of nodes
    that differ are compared; a level is a partition of what is read."""
    open_ = None
    for k in range(levels + 1):
        a, b = (t.where(F.col("level") == k).select("dataset", "node", *_SUMS) for t in (old, new))
        if open_ is not None:
            up = open_.select(F.col("dataset").alias("__d"), F.col("node").alias("__p"))
            child = F.col("dataset").eqNullSafe(F.col("__d")) & (F.floor(F.col("node") / FANOUT).cast("long") == F.col("__p"))
            a, b = a.join(up, child, "left_semi"), b.join(up, child, "left_semi")
        minus = a.select("dataset", "node", *[(-F.col(c)).alias(c) for c in _SUMS])
        # equal nodes cancel out
        open_ = b.unionByName(minus).groupBy("dataset", "node").agg(*[F.sum(c).alias(c) for c in _SUMS]).where(_differs()).select("dataset", "node")
    return open_.withColumnRenamed("node", "leaf")


class History:
    """The versions of all objects, appended to run by run.

    ``levels``: those of the trees below the root, kept from the first run on. Null datasets, paths and dts
    are values like others. Snapshots must be appended in order; a dataset may miss a run.
    """

    LOG = "dataset string, leaf bigint, dt bigint, path string, b bigint, o bigint, first bigint, last bigint, bucket int"
    TREE = "dataset string, node bigint, n bigint, h1 bigint, h2 bigint, level int"

    def __init__(self, store: VersionedStore, levels: int | None = None):
        self.store, self.spark = store, store.spark
        self.levels = store.meta().get("levels", levels)

    def _table(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def newest(self) -> DataFrame:
        """``(dataset, newest)``: the last snapshot appended of each dataset."""
        return self._table([self.store.meta()["newest"]] if self.store.latest() else [], "dataset string, newest bigint")

    def stored_tree(self) -> DataFrame:
        """The trees of the newest snapshots."""
        return self._table([self.store.meta()["tree"]] if self.store.latest() else [], self.TREE)

    def log(self) -> DataFrame:
        """What opened (``last`` null) and what closed, in ``bucket``s of leaves."""
        return self.store.read(self.store.meta().get("log", []), self.LOG)

    def _bucket(self) -> Column:
        return F.floor(F.col("leaf") / FANOUT ** (self.levels - 1)).cast("int")

    @staticmethod
    def _closed(log: DataFrame) -> DataFrame:
        return log.groupBy(*_OBJECT, "leaf", "b", "o", "first").agg(F.max("last").alias("last"))

    def versions(self) -> DataFrame:
        """``(dataset, dt, path, b, o, first, last)``: each longest run of snapshots with one state."""
        new = broadcast_if_small(self.newest().select(F.col("dataset").alias("__d"), "newest"))
        return self._closed(self.log()).join(new, F.col("dataset").eqNullSafe(F.col("__d"))).select(*_OBJECT, "b", "o", "first", F.coalesce("last", "newest").alias("last"))

    def append(self, rows: DataFrame, span: DataFrame, scratch: Scratch) -> int:
        """Append snapshots; returns the new version. Raises ``CommitConflict`` if another run committed.

        ``rows``: presences ``(dataset, dt, path, b, o, lo, hi)`` within the new snapshots, possibly repeated,
        overlapping or in pieces, of one state in any one snapshot. ``span``: ``(dataset, from, to)``, the new
        snapshots of a dataset, of which ``from`` follows the newest one appended; empty ones have no rows.

        A stretch without changes needs no rows: an object present before it is present through it. The
        array of a leaf's changes has at most one entry for each snapshot of the run.
        """
        base, meta = self.store.latest(), self.store.meta()
        if self.levels is None:
            self.levels = tree_levels(rows)
        span = scratch.write(span, f"span-{base}")
        side = broadcast_if_small(span.select(F.col("dataset").alias("__d"), "from", "to"))
        same = F.col("dataset").eqNullSafe(F.col("__d"))
        rows = scratch.write(rows.join(side, same).drop("__d").withColumn("leaf", _leaf(self.levels)), f"rows-{base}")
        events = leaf_events(rows).join(side, same).drop("__d")
        events = scratch.write(events, f"leaves-{base}")
        # the first new snapshot against the stored tree
        mine = self.stored_tree().join(side, same, "left_semi")
        seen, counted = Observation(), Observation()
        first = descend(mine, scratch.write(tree(events.where(F.col("scan") == F.col("from")), self.levels), f"tree-{base}"), self.levels).join(side, same).select("dataset", "leaf", F.col("from").alias("scan"))
        further = events.where(F.col("scan") > F.col("from")).select("dataset", "leaf", "scan")
        changes = first.unionByName(further).groupBy("dataset", "leaf").agg(F.collect_set("scan").alias("changes")).join(side, same).drop("__d")
        changes = scratch.write(changes.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(self._bucket()).alias("buckets")), f"changes-{base}")
        at = changes.select(F.col("dataset").alias("__d"), F.col("leaf").alias("__l"), "changes", F.col("from").alias("__from"), F.col("to").alias("__to"))
        on = same & (F.col("leaf") == F.col("__l"))
        piece = lambda ends, prior: [*_OBJECT, "leaf", "b", "o", "lo", "hi", ends.alias("ends"), F.lit(prior).alias("prior")]
        kept = rows.drop("from", "to").join(at, on).where(F.exists("changes", lambda j: (j >= F.col("lo")) & (j <= F.col("hi") + 1)))
        kept = kept.select(*piece(F.array_contains("changes", F.col("hi") + 1), False))
        if base:
            # at most FANOUT buckets, so the list is bounded
            held = self.log().where(F.col("bucket").isin(observed(seen, "buckets", []))).join(at.select("__d", "__l"), on, "left_semi")
            held = self._closed(held.observe(counted, F.count(F.lit(1)).alias("n"))).where(F.col("last").isNull())
            held = held.join(at, on).withColumns({"lo": F.col("first"), "hi": F.col("__from") - 1})
            kept = kept.unionByName(held.select(*piece(F.array_contains("changes", F.col("__from")), True)))
        # copies and pieces that start together are combined before the shuffle
        pieces = kept.groupBy(*_OBJECT, "leaf", "b", "o", "lo").agg(F.max(F.struct("hi", "ends")).alias("e"), F.max("prior").alias("prior"))
        w = Window.partitionBy(*_OBJECT).orderBy("lo", "e.hi")
        before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = before.isNull() | (F.lag("b").over(w) != F.col("b")) | (F.lag("o").over(w) != F.col("o")) | ((F.col("lo") > before["hi"] + 1) & before["ends"])
        runs = pieces.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        runs = runs.groupBy(*_OBJECT, "leaf", "b", "o", "run").agg(F.min("lo").alias("first"), F.max("e").alias("e"), F.max("prior").alias("prior"))
        last = F.when(F.col("e.ends"), F.col("e.hi")).cast("long")
        made = runs.where(F.col("e.ends") | ~F.col("prior")).select(*_OBJECT, "leaf", "b", "o", "first", last.alias("last"), self._bucket().alias("bucket"))
        log = self.store.write(made, "log", "bucket")
        # the tree of the last new snapshot is the sum of all differences from nothing
        total = events.groupBy("dataset", "leaf").agg(*[F.sum(c).alias(c) for c in _SUMS]).where(_differs())
        others = self.stored_tree().join(side, same, "left_anti")
        trees = self.store.write(tree(total, self.levels).unionByName(others), "tree", "level")
        newest = self.newest().join(side, same, "left_anti").unionByName(span.select("dataset", F.col("to").alias("newest")))
        newest = self.store.write(newest.coalesce(1), "newest")
        named = {"tree": trees, "newest": newest, "log": [*meta.get("log", []), log]}
        counts = {"changed_leaves": observed(seen, "n"), "log_rows_read": observed(counted, "n") if base else 0}
        return self.store.commit(base, {"levels": self.levels, **named, **counts, "paths": [trees, newest, *named["log"]]})


def append_archives(history: History, intervals: DataFrame, catalog: DataFrame, scratch: Scratch) -> int:
    """Append those snapshots of a catalog (see :func:`binstrata.operators.archives.scan_catalog`) that a
    history does not have yet, whatever the encoder of their archives."""
    have = history.newest().select(F.col("dataset").alias("__d"), "newest")
    same = F.col("dataset").eqNullSafe(F.col("__d"))
    fresh = catalog.join(have, same, "left").where(F.col("scan") > F.coalesce("newest", F.lit(0))).drop("__d", "newest")
    span = fresh.groupBy("dataset").agg(F.min("scan").cast("long").alias("from"), F.max("scan").cast("long").alias("to"))
    if history.levels is None:
        history.levels = tree_levels(intervals.select(F.col("key").alias("dataset")))
    return history.append(presence(intervals, broadcast_if_small(segments(fresh))), span, scratch)


def archive_history(intervals: DataFrame, multiscans: DataFrame, store: VersionedStore, scratch: Scratch) -> DataFrame:
    """``(dataset, dt, path, b, o, scan_first, scan_last)``: the history of every object over all archives of
    its dataset; scans are given by label. Kept in ``store``, by two runs if it is new: one over all
    snapshots but the last of each dataset, one that appends these."""
    catalog = scratch.write(scan_catalog(multiscans), "catalog")
    history = History(store)
    if not store.latest():
        last = catalog.groupBy(F.col("dataset").alias("__d")).agg(F.max("scan").alias("__last"))
        older = catalog.join(last, F.col("dataset").eqNullSafe(F.col("__d"))).where(F.col("scan") < F.col("__last")).drop("__d", "__last")
        append_archives(history, intervals, older, scratch)
    append_archives(history, intervals, catalog, scratch)
    label = lambda c: broadcast_if_small(catalog.select(F.col("dataset").alias(f"__d_{c}"), F.col("scan").alias(f"__s_{c}"), F.col("label").alias(f"scan_{c}")))
    out = history.versions()
    for c in ("first", "last"):
        out = out.join(label(c), F.col("dataset").eqNullSafe(F.col(f"__d_{c}")) & (F.col(c) == F.col(f"__s_{c}")))
    return out.select("dataset", "dt", "path", "b", "o", "scan_first", "scan_last")

"""Differences of two snapshots of a tree of paths with rolled-up totals.

A snapshot has ``path, depth, size, n``; a node's totals include those below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binstrata.session import Scratch


def rollup(leaves: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """``(path, depth, size, n)`` of every node above and including the leaves ``(path, size, n)``; the
    root is the empty path of depth 0. Each leaf is spread over its ancestors and summed, combined
    before the shuffle."""
    parts = F.split(F.col(path), sep)
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))
    rows = leaves.select(F.explode(ups).alias("path"), "size", "n")
    sums = rows.groupBy("path").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    return sums.select("path", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", sep))).alias("depth"), "size", "n")


def parent(path: str | Column, sep: str = "/") -> Column:
    """The path above; the empty path for those of depth 1."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(F.instr(p, sep) > 0, F.regexp_replace(p, f"{sep}[^{sep}]*$", "")).otherwise(F.lit(""))


def materialize(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(path, depth, status, size_a, size_b, count_a, count_b)`` of all nodes that differ: ``added``,
    ``removed`` or ``changed``; one full outer join on path and depth."""
    x = a.select("path", "depth", F.col("size").alias("size_a"), F.col("n").alias("count_a"), F.lit(True).alias("__a"))
    y = b.select("path", "depth", F.col("size").alias("size_b"), F.col("n").alias("count_b"), F.lit(True).alias("__b"))
    both = x.join(y, ["path", "depth"], "full_outer")
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("size_a").eqNullSafe(F.col("size_b")) | ~F.col("count_a").eqNullSafe(F.col("count_b")), "changed")
    return both.select("path", "depth", status.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size_a", "size_b", "count_a", "count_b")]).where(F.col("status").isNotNull())


def render_floor(root_size: float, width: int, height: int, cell: int) -> float:
    """Size below which a node covers less than a square of ``cell`` pixels."""
    return root_size * cell * cell / (width * height)


def slice_view(diff: DataFrame, prefix: str = "", floor: float = 0.0, sep: str = "/") -> DataFrame:
    """Nodes at or below ``prefix`` whose larger size reaches ``floor``, without what lies below an added
    or removed node. Ancestors are joined by equality, a node's being as many as its depth."""
    inside = diff if prefix == "" else diff.where((F.col("path") == prefix) | F.col("path").startswith(prefix + sep))
    inside = inside.where(F.greatest("size_a", "size_b") >= floor)
    whole = diff.where(F.col("status") != "changed").select(F.col("path").alias("__w"))
    parts = F.split("path", sep)
    ups = inside.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), sep))).alias("__up"))
    under = ups.join(whole, F.col("__up") == F.col("__w"), "left_semi").select(F.col("path").alias("__u")).distinct()
    return inside.join(under, F.col("path") == F.col("__u"), "left_anti")


def children(snapshot: DataFrame, path: str, depth: int, sep: str = "/") -> DataFrame:
    """The nodes right below one, by a filter on depth and path range that a sorted file is pruned by."""
    below = F.col("depth") == depth + 1
    if path:
        below = below & (F.col("path") >= path + sep) & (F.col("path") < path + chr(ord(sep) + 1))
    return snapshot.where(below)


def walk(a: DataFrame, b: DataFrame, scratch: Scratch, floor: float = 0.0, budget: int | None = None, most: int = 64, sep: str = "/") -> DataFrame:
    """Descend level by level from the root into the nodes that changed and reach ``floor``; columns as
    :func:`materialize` plus ``expanded`` and ``pruned`` (changed, but not opened). ``budget`` bounds
    the nodes opened on a level, those of the greatest change first. A level's join reads only nodes of
    its depth."""
    out = None
    open_ = None
    for depth in range(most + 1):
        x, y = a.where(F.col("depth") == depth), b.where(F.col("depth") == depth)
        if open_ is not None:
            up = open_.select(F.col("path").alias("__p"))
            x, y = (t.join(up, parent("path", sep) == F.col("__p"), "left_semi") for t in (x, y))
        level = materialize(x, y)
        can = (F.col("status") == "changed") & (F.greatest("size_a", "size_b") >= floor)
        if budget is not None:
            top = level.where(can).orderBy(F.abs(F.col("size_b") - F.col("size_a")).desc(), "path").limit(budget).select(F.col("path").alias("__t"))
            level = level.join(top, F.col("path") == F.col("__t"), "left").withColumn("__go", F.col("__t").isNotNull()).drop("__t")
        else:
            level = level.withColumn("__go", can)
        level = scratch.write(level, f"level-{depth}")
        rows = level.select("path", "depth", "status", "size_a", "size_b", "count_a", "count_b", F.col("__go").alias("expanded"), (~F.col("__go") & (F.col("status") == "changed")).alias("pruned"))
        out = rows if out is None else out.unionByName(rows)
        open_ = level.where("__go")
        if open_.isEmpty():
            break
    return out

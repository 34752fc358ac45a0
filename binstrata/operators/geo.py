"""Spatial columns: cell ids as signed bigints (the same 64 bits), tokens as text.

Tokens sort like unsigned ids. Ids of the upper faces are negative, so ranges are compared by
:func:`ordered`, or on tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binstrata.plans import geo_cover as g
from binstrata.session import Scratch, broadcast_if_small


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signed(cell: int) -> int:
    """The id as a bigint holds it."""
    return cell - (1 << 64) if cell >= 1 << 63 else cell


def unsigned(cell: int) -> int:
    return cell % (1 << 64)


def cell_at(lat: str | Column, lng: str | Column, level: int) -> Column:
    """Cell id of a point in degrees; null where a coordinate is null or NaN. Vectorized over Arrow
    batches, as the curve has no built-in expression."""

    @F.pandas_udf("bigint")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        ok = a.notna() & b.notna()
        out = pd.Series(pd.NA, index=a.index, dtype="Int64")
        if ok.any():
            out[ok] = g.cells_at(a[ok].to_numpy(), b[ok].to_numpy(), level).view("int64")
        return out

    return udf(_c(lat).cast("double"), _c(lng).cast("double"))


def low_bit(cell: str | Column) -> Column:
    """The marker bit, without negating the least bigint."""
    c = _c(cell)
    return c.bitwiseAND(F.bitwise_not(c) + 1)


def level_of(cell: str | Column) -> Column:
    """Level of a cell, from the number of zeros below its marker."""
    return (F.lit(30) - (F.bit_count(low_bit(cell) - 1) / 2).cast("int")).cast("int")


def parent(cell: str | Column, level: int) -> Column:
    """Ancestor at a level; finer cells only, else null."""
    bit = g.lsb(level)
    up = _c(cell).bitwiseAND(F.lit(signed(unsigned(-2 * bit)))).bitwiseOR(F.lit(signed(bit)))
    return F.when(level_of(cell) > level, up).when(level_of(cell) == level, _c(cell))


def to_token(cell: str | Column) -> Column:
    return F.rtrim(F.lower(F.lpad(F.hex(_c(cell)), 16, "0")), F.lit("0"))


def from_token(token: str | Column) -> Column:
    return F.conv(F.rpad(_c(token), 16, "0"), 16, -10).cast("bigint")


def ordered(cell: str | Column) -> Column:
    """A bigint that sorts as the unsigned id does."""
    return _c(cell).bitwiseXOR(F.lit(-(1 << 63)))


def descendants(cell: str | Column, level: int) -> Column:
    """Struct ``(lo, hi)`` of a cell's descendants at a level."""
    half = low_bit(cell) - F.lit(g.lsb(level))
    return F.struct((_c(cell) - half).alias("lo"), (_c(cell) + half).alias("hi"))


def at_levels(df: DataFrame, cell: str, levels: Sequence[int]) -> DataFrame:
    """Every row once for each level, with the cell's ancestor there: multi-resolution rows before an
    aggregation. Levels finer than the cell give no row."""
    ups = F.array_compact(F.array(*[F.when(level_of(cell) >= k, parent(cell, k)) for k in levels]))
    return df.withColumn(cell, F.explode(ups))


def merge_ranges(df: DataFrame, by: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Union of inclusive ranges by group, adjacent ones merged; bounds as unsigned order gives them.
    Done by the sweep over half-open ranges."""
    from binstrata.operators.sweep import periods_and_gaps

    rows = df.select(*by, ordered(lo).alias("__lo"), (ordered(hi) + 1).alias("__hi"))
    out = periods_and_gaps(rows, tuple(by), "__lo", "__hi").where(F.col("kind") == "period")
    return out.select(*by, ordered("lo").alias(lo), ordered(F.col("hi") - 1).alias(hi))


def where_cells(df: DataFrame, cell: str, level: int, cells: Iterable[int]) -> DataFrame:
    """Rows whose cell has the level and is among ``cells``."""
    from binstrata.operators.serve import where_in

    return where_in(df.where(level_of(cell) == level), cell, [signed(c) for c in cells])


def where_ranges(df: DataFrame, cell: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows whose cell lies in one of the (unsigned, inclusive) ranges, as plain comparisons that a scan
    can push down; ranges are split where signed order wraps."""
    cond = F.lit(False)
    for lo, hi in ranges:
        parts = [(lo, hi)] if (lo < 1 << 63) == (hi < 1 << 63) else [(lo, (1 << 63) - 1), (1 << 63, hi)]
        for a, b in parts:
            cond = cond | F.col(cell).between(signed(a), signed(b))
    return df.where(cond)


def where_cover(df: DataFrame, cell: str, include: Iterable[int], exclude: Iterable[int]) -> DataFrame:
    """Rows whose nearest ancestor in a ± cover (or own cell) is included. Each row looks up its at most
    31 ancestors, of the levels that occur in the cover, and the deepest hit decides."""
    terms = [(signed(c), True) for c in include] + [(signed(c), False) for c in exclude]
    return where_terms(df, cell, df.sparkSession.createDataFrame(terms, "term bigint, plus boolean"))


def where_terms(df: DataFrame, cell: str, terms: DataFrame) -> DataFrame:
    """The same with a cover of any size, ``(term, plus)``."""
    cover = terms.select(F.col("term").alias("__term"), level_of("term").alias("__level"), F.col("plus").alias("__plus"))
    levels = sorted(r[0] for r in cover.select("__level").distinct().collect())  # 31 at most
    if not levels:
        return df.where(F.lit(False))
    distinct = df.select(cell).distinct()
    ups = distinct.select(cell, F.explode(F.array_compact(F.array(*[F.when(level_of(cell) >= k, parent(cell, k)) for k in levels]))).alias("__up"))
    hits = ups.join(broadcast_if_small(cover), F.col("__up") == F.col("__term"))
    good = hits.groupBy(cell).agg(F.max_by("__plus", "__level").alias("__in")).where("__in").select(F.col(cell).alias("__good"))
    return df.join(good, F.col(cell) == F.col("__good"), "left_semi")


def cover_terms(cells: DataFrame, cell: str, wanted: str, scratch: Scratch, coarsest: int = 0) -> DataFrame:
    """``(term, plus)``: the least ± cover of the wanted cells among all ``cells``, by as few terms as
    :func:`binstrata.plans.geo_cover.minimal_cover`, for vocabularies of any size.

    Level by level upwards, each node gets from its children what it costs to list its wanted cells where
    nothing above is included (``pos``), and to list the others where something is (``neg``); either way the node
    may be turned around for one term. Then downwards, only nodes are looked at whose choice is open. Cells
    that contain each other raise an error; null cells don't count, a cell wanted once is wanted.
    """
    leaves = cells.where(F.col(cell).isNotNull()).groupBy(F.col(cell).alias("node")).agg(F.max(F.coalesce(wanted, F.lit(False))).alias("w"))
    leaves = scratch.write(leaves.withColumn("level", level_of("node")), "leaves")
    finest = leaves.agg(F.max("level")).first()[0]
    if finest is None:
        return leaves.select(F.col("node").alias("term"), F.col("w").alias("plus"))
    number, levels = lambda c: c.cast("long"), {}
    for k in range(finest, coarsest - 1, -1):
        w = F.col("w")
        mine = leaves.where(F.col("level") == k).select("node", w, (~w).alias("o"), F.lit(0).cast("long").alias("add"), F.lit(0).cast("long").alias("drop"), F.lit(True).alias("leaf"))
        if k < finest:
            up = levels[k + 1].groupBy(parent("node", k).alias("node")).agg(F.max("w").alias("w"), F.max("o").alias("o"), F.sum("pos").alias("add"), F.sum("neg").alias("drop")).withColumn("leaf", F.lit(False))
            mine = mine.unionByName(up).groupBy("node").agg(*[F.max(c).alias(c) for c in ("w", "o", "add", "drop")], F.max("leaf").alias("leaf"), F.count(F.lit(1)).alias("n"))
            mine = mine.where(F.when(F.col("n") > 1, F.raise_error(F.lit("cells contain each other")).cast("boolean")).otherwise(F.lit(True))).drop("n")
        cost = lambda some, other, listed, turned: F.when(~F.col(some), F.lit(0)).when(~F.col(other), F.lit(1)).otherwise(F.least(F.col(listed), F.col(turned) + 1))
        levels[k] = scratch.write(mine.withColumns({"pos": number(cost("w", "o", "add", "drop")), "neg": number(cost("o", "w", "drop", "add"))}), f"up-{k}")
    out, above = None, None
    for k in range(coarsest, finest + 1):
        open_ = levels[k]
        if above is None:
            open_ = open_.withColumn("plus", F.lit(True))
        else:
            open_ = open_.join(broadcast_if_small(above), parent("node", k - 1) == F.col("__up")).drop("__up")
        plus = F.col("plus")
        some, foreign = F.when(plus, F.col("w")).otherwise(F.col("o")), F.when(plus, F.col("o")).otherwise(F.col("w"))
        listed, turned = F.when(plus, F.col("add")).otherwise(F.col("drop")), F.when(plus, F.col("drop")).otherwise(F.col("add"))
        term = ~foreign | (turned + 1 < listed)
        open_ = scratch.write(open_.where(some).select("node", "plus", term.alias("term"), (foreign & ~F.col("leaf")).alias("on")), f"down-{k}")
        one = open_.where("term").select(F.col("node").alias("term"), "plus")
        out = one if out is None else out.unionByName(one)
        above = open_.where("on").select(F.col("node").alias("__up"), (F.col("plus") != F.col("term")).alias("plus"))
    return out


def query_box(tiers, spec, cell: str, lo: int, hi: int, box: g.BBox | None = None, cells: Sequence[int] | None = None, budget: int = 1024, **options):
    """Plan and execute a query of a box, or of given cells of one level: ``(records, plan metadata)``."""
    from binstrata.operators.serve import execute
    from binstrata.plans.planner import plan_query

    if (box is None) == (cells is None):
        raise ValueError("give either a box or cells")
    res, cells = g.pick_resolution(box, spec.geo["resolutions"], budget) if box else (g.level_of(cells[0]), list(cells))
    plan = plan_query(spec, lo, hi, **options)
    filters = [level_of(cell) == res, F.col(cell).isin([signed(c) for c in cells])]
    meta = plan.describe() | {"outputRes": res, "outputCells": [g.to_token(c) for c in cells]}
    return execute(tiers, spec, plan, filters), meta

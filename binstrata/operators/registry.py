"""The shard registry as DataFrame queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = ("pyramid", "tier", "shard_dur", "period_start")


def null_safe(left: DataFrame, right: DataFrame, cols) -> Column:
    """Equality of all ``cols`` in which a null equals a null."""
    out = F.lit(True)
    for c in cols:
        out = out & left[c].eqNullSafe(right[c])
    return out


def live_rows(shards: DataFrame, slot=SLOT, newest: str = "written_at") -> DataFrame:
    """The live row of each slot: the one with the greatest ``newest``, a null counting as oldest.

    Rows that tie in ``newest`` are ordered by their other columns, so the result is defined even
    where they differ. Slots with null columns are slots like others. The maximum is combined on the
    map side, so a slot registered very often costs one row for each map task. Columns beyond the
    slot are kept, whatever their names; types without an order (maps) are not supported.
    """
    rest = [c for c in shards.columns if c not in slot and c != newest]
    best = F.max(F.struct(F.col(newest), *[F.col(c) for c in rest])).alias("__best")
    out = shards.groupBy(*slot).agg(best)
    return out.select(*[F.col(c) if c in slot else F.col("__best").getField(c).alias(c) for c in shards.columns])


def millis(c) -> Column:
    """Epoch milliseconds of a timestamp column."""
    return F.unix_millis(F.col(c) if isinstance(c, str) else c)

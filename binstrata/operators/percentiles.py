"""Weighted percentiles per group of very large numeric columns, by distributed multi-select.

Values are pre-aggregated to ``(group, value, weight)`` and laid out once, as sorted pieces of bounded
length, spread over the partitions by group and salt. In each round every piece proposes, for every
group and percentile at once, the weighted median of its values that are still possible, and the other
quantiles that part them evenly; the weighted median of the pieces' proposals is the pivot. The pieces
count the weights below, at and above the pivots (reports of very many pieces are combined in steps: counts
add up, and of their proposals the weighted median goes on), the ranges that can't hold the percentile are
ruled out, and the next proposals are made in the same pass, for each range that may remain. With one pivot
this is the textbook algorithm; with seven a round does the work of three. All groups take part until
they are found; only numbers per group travel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binstrata.session import Scratch, parallelism

LO, HI, BELOW, TOTAL, FOUND, PIVOT = range(6)


def partials(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``(*by, value, weight)``: the state of a file, a day or any other part. States of several parts
    combine by :func:`merge_partials`. Null, NaN and infinite values, and weights that are null, NaN,
    infinite or not above 0, do not count; groups with nulls are groups."""
    v = F.col(value).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    inf = float("inf")
    rows = df.select(*[F.col(c) for c in by], v.alias("value"), w.alias("weight"))
    ok = (F.col("value") < inf) & (F.col("value") > -inf) & (F.col("weight") > 0) & (F.col("weight") < inf)
    return rows.where(ok).groupBy(*by, "value").agg(F.sum("weight").alias("weight"))


def merge_partials(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combine partial states: weights of one value add up. Associative and commutative."""
    return df.groupBy(*by, "value").agg(F.sum("weight").alias("weight"))


def _search(a: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """For each i the first position in ``a[start[i]:end[i]]`` (ascending) with a value >= x[i], or > x[i]."""
    lo, hi = start.copy(), end.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        at = a[np.minimum(mid, len(a) - 1)]
        go = open_ & ((at <= x) if right else (at < x))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)


def survey(v: np.ndarray, w: np.ndarray, offsets: np.ndarray, state: np.ndarray, m: int) -> np.ndarray:
    """What each piece reports on one percentile: the weights in its ``m + 1`` ranges between the pivots,
    the weights at the ``m`` pivots, and ``m`` proposals for each range (NaN for an empty one)."""
    c = np.concatenate([[0.0], np.cumsum(w)])
    start, end = offsets[:-1], offsets[1:]
    a = _search(v, start, end, state[:, LO], True)
    b = np.maximum(a, _search(v, start, end, state[:, HI], False))
    edges = [a]
    for j in range(m):
        p = state[:, PIVOT + j]
        edges += [np.clip(_search(v, start, end, p, False), a, b), np.clip(_search(v, start, end, p, True), a, b)]
    edges.append(b)
    # pivots ascend, so each edge is at or after the one before
    bounds = np.maximum.accumulate(np.stack(edges, axis=1), axis=1)
    weights = c[bounds[:, 1:]] - c[bounds[:, :-1]]
    out = [weights[:, 0::2], weights[:, 1::2]]
    last = max(0, len(v) - 1)
    for j in range(m + 1):
        lo, hi = bounds[:, 2 * j], bounds[:, 2 * j + 1]
        full = hi > lo
        for i in range(1, m + 1):
            at = _search(c[1:], lo, np.maximum(lo, hi - 1), c[lo] + (c[hi] - c[lo]) * (i / (m + 1)), False)
            out.append(np.where(full, v[np.minimum(at, last)], np.nan)[:, None] if len(v) else np.full((len(lo), 1), np.nan))
    return np.concatenate(out, axis=1)


def _weighted_median(v: np.ndarray, w: np.ndarray) -> float:
    ok = ~np.isnan(v) & (w > 0)
    v, w = v[ok], w[ok]
    order = np.argsort(v, kind="stable")
    c = np.cumsum(w[order])
    return float(v[order][min(len(v) - 1, np.searchsorted(c, c[-1] / 2))])


def narrow(state: np.ndarray, reports: np.ndarray, counts: np.ndarray, q: float, m: int, rank_error: float) -> np.ndarray:
    """The states after the reports of a round. ``reports``: those of the groups' pieces, one after the
    other, ``counts`` of each group."""
    new = state.copy()
    at = np.concatenate([[0], np.cumsum(counts)])
    sums = np.add.reduceat(reports[:, : 2 * m + 1], at[:-1], axis=0)
    between, equal = sums[:, : m + 1], sums[:, m + 1 :]
    total = np.where(np.isnan(state[:, TOTAL]), sums.sum(axis=1), state[:, TOTAL])
    target = total * q
    seq = np.empty((len(state), 2 * m + 1))
    seq[:, 0::2], seq[:, 1::2] = between, equal
    cum = state[:, BELOW, None] + np.cumsum(seq, axis=1)
    reached = (cum >= target[:, None]) & (seq > 0)
    # sums of doubles may miss the target by their last digit: then the last part that holds anything
    holds = (2 * m) - np.argmax((seq > 0)[:, ::-1], axis=1)
    part = np.where(reached.any(axis=1), np.argmax(reached, axis=1), holds)
    rows = np.arange(len(state))
    before = np.where(part > 0, cum[rows, np.maximum(part - 1, 0)], state[:, BELOW])
    new[:, TOTAL] = total
    hit, done = part % 2 == 1, ~np.isnan(state[:, FOUND])
    new[hit, FOUND] = state[rows[hit], PIVOT + part[hit] // 2]
    for r in np.nonzero(~hit & ~done)[0]:
        j = part[r] // 2
        mine = reports[at[r] : at[r + 1]]
        props = mine[:, 2 * m + 1 + j * m : 2 * m + 1 + (j + 1) * m]
        w = mine[:, j]
        pivots = props[0] if len(mine) == 1 else np.array([_weighted_median(props[:, i], w) for i in range(m)])
        if j > 0:
            new[r, LO] = state[r, PIVOT + j - 1]
        if j < m and state[r, PIVOT + j] < np.inf:
            new[r, HI] = state[r, PIVOT + j]
        new[r, BELOW] = before[r]
        new[r, PIVOT:] = np.sort(pivots)
        if between[r, j] <= total[r] * rank_error:
            new[r, FOUND] = new[r, PIVOT + m // 2]
    new[done] = state[done]
    return new


def merge_reports(said: np.ndarray, m: int) -> np.ndarray:
    """One report for those of several pieces: sums of their weights, weighted medians of their proposals."""
    out = np.full(said.shape[1], np.nan)
    out[: 2 * m + 1] = said[:, : 2 * m + 1].sum(axis=0)
    for j in range(m + 1):
        at = 2 * m + 1 + j * m
        full = said[:, j] > 0
        if full.any():
            out[at : at + m] = [_weighted_median(said[full, at + i], said[full, j]) for i in range(m)]
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _flat(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def percentiles(
    weights: DataFrame,
    by: Sequence[str],
    quantiles: Sequence[float],
    scratch: Scratch,
    rank_error: float = 0.0,
    pivots: int = 7,
    piece: int = 4096,
    max_rounds: int = 100,
    fan: int = 256,
) -> DataFrame:
    """``(*by, p_0, p_1, ...)``: for each quantile q the least value at which the weight of all values up to
    it reaches q of the group's total.

    ``weights``: ``(*by, value, weight)`` as from :func:`partials`. Exact with ``rank_error`` 0; else the
    weight between the result and the exact one is at most ``rank_error`` of the total. No group is ever
    brought together: a piece holds about ``piece`` values, and at most ``fan`` reports meet in a row, by as many
    steps as the largest group needs. Empty input gives no rows.
    """
    by, n_q, m = list(by), len(quantiles), pivots
    width = PIVOT + m
    n = parallelism(scratch.spark)
    weights = weights.select(*by, F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
    # groups of more than one piece; the others need no entry
    big = weights.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece)
    big = scratch.write(big.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.ceil(F.col("n") / piece).cast("int").alias("__salts")), "big")
    n_big, salts = big.agg(F.count(F.lit(1)), F.max("__salts")).first()
    if n_big <= 20_000:  # at most 20,000 rows of a name and a number: bounded, so it may be broadcast
        big = F.broadcast(big)
    on = F.lit(True)
    for c in by:
        on = on & weights[c].eqNullSafe(F.col(f"__b_{c}"))
    salted = weights.join(big, on, "left").select(*by, "value", "weight", F.coalesce("__salts", F.lit(1)).alias("salts"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("value"), F.col("salts")).cast("int"))
    pieces = salted.repartition(n, *by, "salt").groupBy(*by, "salt").agg(
        F.max("salts").alias("salts"), F.sort_array(F.collect_list(F.struct(F.col("value").alias("v"), F.col("weight").alias("w")))).alias("pairs")
    )
    held = [weights, pieces := pieces.persist(StorageLevel.MEMORY_AND_DISK)]

    inf, nan = float("inf"), float("nan")
    start = [-inf, inf, 0.0, nan, nan, *[inf] * m] * n_q
    state = pieces.groupBy(*by).agg(F.max("salts").alias("salts")).withColumn("st", F.array(*[F.lit(x) for x in start]))
    group = [pieces.schema[c] for c in by]
    numbers = T.ArrayType(T.DoubleType())
    from pyspark.sql.pandas.types import to_arrow_schema

    said_schema = T.StructType([*group, T.StructField("salt", T.IntegerType()), T.StructField("said", numbers)])
    next_schema = T.StructType([*group, T.StructField("salts", T.IntegerType()), T.StructField("st", numbers)])
    said_arrow, next_arrow = to_arrow_schema(said_schema), to_arrow_schema(next_schema)
    report = 2 * m + 1 + (m + 1) * m

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists, st = b.column(len(by) + 1), _flat(b.column(len(by) + 2), width * n_q)
            v, w = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            said = np.concatenate([survey(v, w, offsets, st[:, k * width : (k + 1) * width], m) for k in range(n_q)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by) + 1], _lists(said)], schema=said_arrow)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            all_said = b.column(len(by) + 1)
            at = all_said.offsets.to_numpy().astype(np.int64)
            at, said = at - at[0], _flat(all_said.flatten(), report * n_q)
            one = [np.concatenate([merge_reports(said[i:j, k * report : (k + 1) * report], m) for k in range(n_q)]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by) + 1], _lists(np.stack(one))], schema=said_arrow)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            st = _flat(b.column(len(by) + 1), width * n_q)
            all_said = b.column(len(by) + 2)
            counts = np.diff(all_said.offsets.to_numpy().astype(np.int64))
            said = _flat(all_said.flatten(), report * n_q)
            new = [narrow(st[:, k * width : (k + 1) * width], said[:, k * report : (k + 1) * report], counts, q, m, rank_error) for k, q in enumerate(quantiles)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by) + 1], _lists(np.concatenate(new, axis=1))], schema=next_arrow)

    item = lambda k, what: F.col("st")[k * width + what]
    waiting = F.exists(F.array(*[F.isnan(item(k, FOUND)) for k in range(n_q)]), lambda x: x)
    finished: list[DataFrame] = []
    for r in range(max_rounds):
        sides = state.select(*[F.col(c).alias(f"__s_{c}") for c in by], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("__salt"), "st")
        if r and r % 2 == 0:
            # rule out for good: only values inside some open range stay
            inside = lambda x: F.exists(F.array(*[F.isnan(item(k, FOUND)) & (x["v"] > item(k, LO)) & (x["v"] < item(k, HI)) for k in range(n_q)]), lambda y: y)
            pieces = pieces.join(sides.hint("shuffle_hash"), _matches(pieces, by)).select(*by, "salt", F.filter("pairs", inside).alias("pairs"))
            held.append(pieces := pieces.where(F.size("pairs") > 0).persist(StorageLevel.MEMORY_AND_DISK))
        active = pieces.join(sides.hint("shuffle_hash"), _matches(pieces, by))
        said = active.select(*by, "salt", "pairs", "st").mapInArrow(propose, said_schema)
        reports = salts or 1
        while reports > fan:
            said = said.groupBy(*by, F.floor(F.col("salt") / fan).cast("int").alias("salt")).agg(F.collect_list("said").alias("said")).mapInArrow(combine, said_schema)
            reports = -(-reports // fan)
        gathered = said.groupBy(*by).agg(F.collect_list("said").alias("said")).withColumnsRenamed({c: f"__c_{c}" for c in by})
        on = F.lit(True)
        for c in by:
            on = on & state[c].eqNullSafe(F.col(f"__c_{c}"))
        seen = Observation()
        nxt = state.join(gathered.hint("merge"), on).select(*by, "salts", "st", "said").mapInArrow(decide, next_schema)
        state = scratch.write(nxt.observe(seen, F.count_if(waiting).alias("open")), f"round-{r}")
        finished.append(state.where(~waiting))
        if not seen.get["open"]:
            break
        state = state.where(waiting)
    else:
        raise RuntimeError(f"not found within {max_rounds} rounds")
    for df in held:
        df.unpersist()
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select(*by, *[item(k, FOUND).alias(f"p_{k}") for k in range(n_q)])


def _matches(pieces: DataFrame, by: Sequence[str]) -> Column:
    on = pieces["salt"] == F.col("__salt")
    for c in by:
        on = on & pieces[c].eqNullSafe(F.col(f"__s_{c}"))
    return on

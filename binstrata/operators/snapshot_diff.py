"""What changed between consecutive full snapshots, by subtracting invertible Bloom lookup tables.

Each snapshot's objects are spread over hash buckets, and every bucket is summarized by a table of cells: a
pair of key hash and state hash is added to three cells, which hold a count and sums of the hashes, and once
to the bucket's digest. The tables are as large as the differences to be expected, which a small sketch of
each snapshot tells beforehand, and they are filled inside the tasks that read the rows, so that cells travel
instead of objects. Subtracting the tables of two snapshots leaves the differing pairs, which are peeled from
cells that hold a single one. Buckets that can't be peeled, or whose digest does not come out as zero, are
tabulated again with larger tables. The keys recovered are then looked up in both snapshots and classified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binstrata.operators.archives import presence, scan_catalog, segments
from binstrata.session import Scratch, broadcast_if_small

#: Parts of a table; a pair has one cell in each.
PARTS = 3
#: Hashes have so many bits, and a pair may come so often: a product of both fits a long.
BITS, MOST = 56, 127
#: Cells that a task holds while it fills tables, and cells that are peeled at once.
HELD, STEP = 1 << 20, 1 << 18
#: Counters of the sketch of a snapshot; pairs expected in a bucket; cells in a part at least and at first at most.
COUNTERS, LOAD, SMALLEST, LARGEST = 32, 96, 8, 64

# fixed values: the constants of the public xxHash64 algorithm, as Spark's xxhash64 uses it
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SEED = np.uint64(42)
_MASK = (1 << BITS) - 1


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of one 8-byte integer, vectorized."""
    with np.errstate(over="ignore"):
        h = seed + _P5 + np.uint64(8)
        h = h ^ (_rotl(x * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def pair_hash(kh: np.ndarray, vh: np.ndarray, seed: int = int(_SEED)) -> np.ndarray:
    """Spark's ``xxhash64(kh, vh)`` of two bigint columns."""
    return _hash_long(vh.view(np.uint64), _hash_long(kh.view(np.uint64), np.broadcast_to(np.uint64(seed), kh.shape))).view(np.int64)


def _positions(p: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
    """A pair's cell in each part, from its hash."""
    u = p.view(np.uint64)
    return [k * size + ((u >> np.uint64(20 * k)) & np.uint64(0xFFFFF)).astype(np.int64) % size for k in range(PARTS)]


def combine(at: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Add up what has the same address; cells of zero go."""
    if not len(at):
        return at, sums
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
    at, sums = at[first], [np.add.reduceat(x[order], first) for x in sums]
    left = np.any([x != 0 for x in sums], axis=0)
    return at[left], [x[left] for x in sums]


def peel(tab: list[np.ndarray], size: int) -> tuple[np.ndarray, ...]:
    """Peel tables at once: arrays of counts and sums of shape (tables, PARTS * size). Returns the recovered
    ``(table, kh, vh, count)``; what could not be peeled stays in the arrays."""
    cnt, kx, vx, px = tab
    found: list[tuple[np.ndarray, ...]] = []
    look = np.nonzero((cnt != 0) & (np.abs(cnt) <= MOST))
    while len(look[0]):
        t, c = look
        n = cnt[t, c]
        k, v = kx[t, c] // n, vx[t, c] // n
        good = (kx[t, c] == k * n) & (vx[t, c] == v * n) & (k >= 0) & (k <= _MASK) & (v >= 0) & (v <= _MASK)
        p = pair_hash(k, v) & _MASK
        good &= px[t, c] == p * n
        good &= np.any([at == c for at in _positions(p, size)], axis=0)
        t, k, v, n, p = t[good], k[good], v[good], n[good], p[good]
        if not len(t):
            break
        # a pair shows in several cells: once for each table
        _, first = np.unique(t * np.int64(1 << 40) ^ p, return_index=True)
        t, k, v, n, p = t[first], k[first], v[first], n[first], p[first]
        touched = []
        for at in _positions(p, size):
            for a, x in ((cnt, n), (kx, k * n), (vx, v * n), (px, p * n)):
                np.subtract.at(a, (t, at), x)
            touched.append(t * (PARTS * size) + at)
        found.append((t, k, v, n))
        again = np.unique(np.concatenate(touched))
        t, c = again // (PARTS * size), again % (PARTS * size)
        live = (cnt[t, c] != 0) & (np.abs(cnt[t, c]) <= MOST)
        look = t[live], c[live]
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*found))


def _address(kh: np.ndarray, vh: np.ndarray, bucket: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Addresses of the cells of pairs, within the tables of their snapshot, one below the other, and what
    is added there: three cells, and the last of a bucket for its digest."""
    p = pair_hash(kh, vh) & _MASK
    base = bucket * (PARTS * size + 1)
    at = np.concatenate([*[base + x for x in _positions(p, size)], base + PARTS * size])
    one, q = np.ones(len(kh), np.int64), pair_hash(kh, vh, 7)
    return at, [np.tile(one, PARTS + 1), np.tile(kh, PARTS + 1), np.tile(vh, PARTS + 1), np.concatenate([np.tile(p, PARTS), q])]


_NUMBERS = T.ArrayType(T.LongType())
_TABLES = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("scan", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("size", T.LongType()), *[T.StructField(c, _NUMBERS) for c in ("cell", "cnt", "kx", "vx", "px")]])


def tables(elements: DataFrame) -> DataFrame:
    """``(dataset, scan, bucket, size, cell, cnt, kx, vx, px)``: the cells of each bucket's table, as far as one
    task has filled it; what several tasks say of a table adds up. The cell ``PARTS * size`` is its digest.

    ``elements``: ``(dataset, scan, bucket, size, kh, vh)``. A task holds about ``HELD`` cells and hands them on
    when there are more.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        sizes: list[int] = []
        at, sums = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 4
        waiting: list[tuple[np.ndarray, list[np.ndarray]]] = []

        def squeeze() -> None:
            nonlocal at, sums, waiting
            parts = [(at, sums), *waiting]
            at, sums = combine(np.concatenate([a for a, _ in parts]), [np.concatenate([s[k] for _, s in parts]) for k in range(4)])
            waiting = []

        def flush() -> pa.RecordBatch:
            nonlocal at, sums, names, sizes
            who, pos = at >> 40, at & ((1 << 40) - 1)
            stride = np.array(sizes, np.int64)[who] * PARTS + 1
            bucket, cell = pos // stride, pos % stride
            first = np.nonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (bucket[1:] != bucket[:-1])]))[0] if len(at) else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate([first, [len(at)]]).astype(np.int32))
            keys = list(names)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (cell, *sums)]
            cols = [pa.array([keys[w][0] for w in who[first]], pa.string()), pa.array([keys[w][1] for w in who[first]], pa.int64()), pa.array(bucket[first]), pa.array([sizes[w] for w in who[first]], pa.int64())]
            at, sums, names, sizes = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 4, {}, []
            return pa.RecordBatch.from_arrays([*cols, *lists], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            ds = b.column(0).dictionary_encode()
            scan, bucket, size, kh, vh = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 6))
            code = ds.indices.fill_null(len(ds.dictionary)).to_numpy().astype(np.int64)
            texts = [*ds.dictionary.to_pylist(), None]
            pairs, where, inverse = np.unique(np.stack([code, scan, size]), axis=1, return_index=True, return_inverse=True)
            mine = []
            for c, s, z in pairs.T:
                key = (texts[c], int(s), int(z))
                if key not in names:
                    names[key] = len(sizes)
                    sizes.append(int(z))
                mine.append(names[key])
            a, x = _address(kh, vh, bucket, size)
            waiting.append(combine((np.tile(np.array(mine, np.int64)[inverse.ravel()], PARTS + 1) << 40) | a, x))
            if sum(len(w) for w, _ in waiting) > max(HELD, len(at)):
                squeeze()
                if len(at) > HELD or len(sizes) > 1 << 20:
                    yield flush()
        squeeze()
        if len(at):
            yield flush()

    return elements.select("dataset", "scan", "bucket", "size", "kh", "vh").mapInArrow(run, _TABLES)


_PEELED = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("later", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("kh", T.LongType()), T.StructField("failed", T.BooleanType())])


def subtract_and_peel(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(dataset, later, bucket, kh, failed)``: the keys that differ between a snapshot and the one before,
    and the buckets that failed. ``parts`` as from :func:`tables`; ``pairs``: ``(dataset, later)``, and ``bucket`` if
    only some are wanted. Tables are peeled in steps of about ``STEP`` cells."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_PEELED)
    role = F.explode(F.array(F.struct(F.col("scan").alias("later"), F.lit(1).cast("long").alias("sign")), F.struct((F.col("scan") + 1).alias("later"), F.lit(-1).cast("long").alias("sign")))).alias("r")
    cells = ("cell", "cnt", "kx", "vx", "px")
    signed = parts.select("dataset", "bucket", "size", role, *cells).select("dataset", "r.later", "bucket", "size", "r.sign", *cells)
    wanted = broadcast_if_small(pairs.withColumnsRenamed({c: f"__{c}" for c in pairs.columns}))
    on = F.lit(True)
    for c in pairs.columns:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    signed = signed.join(wanted, on, "left_semi")
    # no more cells for a table than its size has, from each task that read some of the two snapshots
    both = signed.groupBy("dataset", "later", "bucket", "size").agg(F.collect_list(F.struct("sign", *cells)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column(3).to_numpy().astype(np.int64)
            lists = b.column(4)
            n_parts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), n_parts)
            fields = [flat.field(k) for k in range(1, 6)]
            n_cells = np.diff(fields[0].offsets.to_numpy()).astype(np.int64)
            sign = np.repeat(flat.field(0).to_numpy(), n_cells)
            row = np.repeat(row, n_cells)
            cell, *sums = (f.flatten().to_numpy() for f in fields)
            for z in np.unique(size):
                z, rows = int(z), np.nonzero(size == z)[0]
                step = max(1, STEP // (PARTS * z))
                for k in range(0, len(rows), step):
                    yield one_step(b, rows[k : k + step], z, row, cell, [x * sign for x in sums])

    def one_step(b: pa.RecordBatch, rows: np.ndarray, z: int, row: np.ndarray, cell: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
        local = np.full(b.num_rows, -1)
        local[rows] = np.arange(len(rows))
        mine = local[row] >= 0
        at, sums = combine(local[row[mine]] * (PARTS * z + 1) + cell[mine], [x[mine] for x in sums])
        full = [np.zeros((len(rows), PARTS * z + 1), np.int64) for _ in range(4)]
        for a, x in zip(full, sums):
            a.ravel()[at] = x
        tab, digest = [np.ascontiguousarray(a[:, :-1]) for a in full], [a[:, -1].copy() for a in full]
        t, k, v, n = peel(tab, z)
        for d, x in zip(digest, (n, k * n, v * n, pair_hash(k, v, 7) * n)):
            np.subtract.at(d, t, x)
        ok = np.all([~np.any(a, axis=1) for a in tab], axis=0) & np.all([d == 0 for d in digest], axis=0)
        keep = ok[t]
        bad = np.nonzero(~ok)[0]
        which = pa.array(rows[np.concatenate([t[keep], bad])])
        keys = np.concatenate([k[keep], np.zeros(len(bad), np.int64)])
        return pa.RecordBatch.from_arrays([*[b.column(c).take(which) for c in range(3)], pa.array(keys), pa.array(np.arange(len(keys)) >= int(keep.sum()))], schema=schema)

    return both.mapInArrow(run, _PEELED)


def recover(elements: DataFrame, pairs: DataFrame, scratch: Scratch, growth: int = 4, rounds: int = 5) -> DataFrame:
    """``(dataset, later, kh)``: keys that are in two consecutive snapshots with different states or numbers,
    or in one of them only.

    ``elements``: ``(dataset, scan, bucket, size, kh, vh)``, repeated ones allowed; ``pairs``: ``(dataset, later)``.
    Buckets that fail are tabulated again, alone, with tables ``growth`` times as large; after ``rounds`` the
    rest are compared pair by pair, summed before the shuffle.
    """
    out, todo, wanted = [], elements, pairs
    for k in range(rounds + 1):
        if k == rounds:
            sides = todo.select("dataset", "bucket", "kh", "vh", F.explode(F.array(F.struct(F.col("scan").alias("later"), F.lit(1).alias("n")), F.struct((F.col("scan") + 1).alias("later"), F.lit(-1).alias("n")))).alias("r"))
            left = sides.groupBy("dataset", "r.later", "bucket", "kh", "vh").agg(F.sum("r.n").alias("n")).where("n <> 0")
            w = wanted.withColumnsRenamed({c: f"__{c}" for c in wanted.columns})
            on = F.lit(True)
            for c in wanted.columns:
                on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
            out.append(left.join(w, on, "left_semi").select("dataset", "later", "kh"))
            break
        got = scratch.write(subtract_and_peel(tables(todo), wanted), f"peeled-{k}")
        out.append(got.where(~F.col("failed")).select("dataset", "later", "kh"))
        wanted = got.where("failed").select("dataset", "later", "bucket")
        if wanted.isEmpty():
            break
        again = wanted.select(F.col("dataset").alias("__d"), F.col("bucket").alias("__b"), F.explode(F.array(F.col("later"), F.col("later") - 1)).alias("__s")).distinct()
        on = F.col("dataset").eqNullSafe(F.col("__d")) & (F.col("scan") == F.col("__s")) & (F.col("bucket") == F.col("__b"))
        todo = elements.join(again, on, "left_semi").withColumn("size", F.col("size") * growth ** (k + 1))
    res = out[0]
    for more in out[1:]:
        res = res.unionByName(more)
    return res.distinct()


def expected_differences(hashed: DataFrame) -> DataFrame:
    """``(dataset, later, d)``: about how many pairs each snapshot and the one before don't share, from sums of
    random signs in ``COUNTERS`` counters a snapshot, whose squared differences add up to that number on
    average. ``hashed``: ``(dataset, scan, kh, vh)``."""
    h = F.xxhash64("kh", "vh")
    sketch = hashed.select("dataset", "scan", F.pmod(h, F.lit(COUNTERS)).alias("j"), (F.shiftrightunsigned(h, 63) * 2 - 1).alias("s")).groupBy("dataset", "scan", "j").agg(F.sum("s").alias("s"))
    role = F.explode(F.array(F.struct(F.col("scan").alias("later"), F.col("s").alias("s")), F.struct((F.col("scan") + 1).alias("later"), (-F.col("s")).alias("s")))).alias("r")
    apart = sketch.select("dataset", "j", role).groupBy("dataset", "r.later", "j").agg(F.sum("r.s").alias("s"))
    return apart.groupBy("dataset", "later").agg(F.sum(F.col("s").cast("double") * F.col("s")).alias("d"))


def _hash(*columns: str) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit(_MASK))


def archive_diffs(intervals: DataFrame, multiscans: DataFrame, scratch: Scratch, encoder: str = "densify") -> DataFrame:
    """``(dataset, scan, dt, path, op)`` for each two consecutive scans of a dataset that are both read
    from archives of ``encoder``; ``scan`` is the later label, ``op`` added, removed or changed.

    Repeated rows count once. Null dts and paths are values. A scan without rows is an empty snapshot.
    """
    catalog = scratch.write(scan_catalog(multiscans), "catalog")
    dense = catalog.where(F.col("encoder") == encoder).withColumn("scan", F.col("scan").cast("long"))
    prev = dense.select(F.col("dataset").alias("__d"), (F.col("scan") + 1).alias("__s"))
    same = F.col("dataset").eqNullSafe(F.col("__d")) & (F.col("scan") == F.col("__s"))
    pairs = scratch.write(dense.join(prev, same, "left_semi").select("dataset", F.col("scan").alias("later"), "label"), "pairs")
    # the snapshots of any pair
    used = pairs.select(F.col("dataset").alias("__d"), F.explode(F.array(F.col("later"), F.col("later") - 1)).alias("__s")).distinct()
    rows = presence(intervals, broadcast_if_small(segments(dense))).select("dataset", F.explode(F.sequence("lo", "hi")).alias("scan"), "dt", "path", "b", "o")
    hashed = rows.select("dataset", "scan", _hash("dt", "path").alias("kh"), _hash("b", "o").alias("vh"))
    hashed = scratch.write(hashed.join(broadcast_if_small(used), same, "left_semi"), "hashed")
    d = expected_differences(hashed).join(broadcast_if_small(pairs.select(F.col("dataset").alias("__d"), F.col("later").alias("__l"))), F.col("dataset").eqNullSafe(F.col("__d")) & (F.col("later") == F.col("__l")), "left_semi")
    # a snapshot that differs much more than the others of its dataset is left to the larger tables
    most = F.least(F.max("d"), F.avg("d") * 4)
    sizes = d.groupBy(F.col("dataset").alias("__d")).agg(most.alias("d")).select("__d", F.ceil(F.col("d") / LOAD).alias("n"), "d")
    sizes = sizes.select("__d", F.greatest(F.lit(1), "n").cast("long").alias("buckets"), F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.ceil(F.col("d") * 0.8))).cast("long").alias("size"))
    sizes = broadcast_if_small(scratch.write(sizes, "sizes"))
    elements = hashed.join(sizes, F.col("dataset").eqNullSafe(F.col("__d"))).select("dataset", "scan", F.pmod("kh", "buckets").alias("bucket"), "size", "kh", "vh")
    found = scratch.write(recover(elements, pairs.select("dataset", "later"), scratch), "found")
    # both states of each key found; one that is merely repeated in one of the snapshots has the same
    sides = found.select(F.col("dataset").alias("__d"), F.col("kh").alias("__k"), F.explode(F.array(F.struct(F.col("later").alias("at"), "later"), F.struct((F.col("later") - 1).alias("at"), "later"))).alias("r"))
    sides = broadcast_if_small(sides.select("__d", "__k", F.col("r.at").alias("__s"), F.col("r.later").alias("later")))
    held = rows.withColumn("kh", _hash("dt", "path")).join(sides, same & (F.col("kh") == F.col("__k")))
    state, new = F.struct("b", "o"), F.col("scan") == F.col("later")
    states = held.groupBy("dataset", "later", "dt", "path").agg(F.max(F.when(~new, state)).alias("x"), F.max(F.when(new, state)).alias("y"))
    op = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    labels = broadcast_if_small(pairs.select(F.col("dataset").alias("__d"), F.col("later").alias("__s"), "label"))
    named = states.withColumn("op", op).where(F.col("op").isNotNull())
    return named.join(labels, F.col("dataset").eqNullSafe(F.col("__d")) & (F.col("later") == F.col("__s"))).select("dataset", F.col("label").alias("scan"), "dt", "path", "op")

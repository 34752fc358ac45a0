"""Filling containers of fixed capacity with items, by bounded-space online best-fit.

A packer has a fixed number of open bins. A bitset has one bit for each amount of free space, so the
bin with the least space that still fits is found with one shift and the lowest bit. If no open bin
fits and all are in use, the fullest is closed. Every task packs its own items, so containers need no
coordination; it leaves at most its open bins partly filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY, OPEN_BINS = 2048, 64


class Packer:
    """Bounded-space best-fit of sizes between 0 and ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit s: some open bin has s units free
        self.free: dict[int, list[int]] = {}
        self.n_open = 0
        self.next_bin = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        b = bins.pop()
        if not bins:
            del self.free[space]
            self.bits &= ~(1 << space)
        return b

    def _put(self, b: int, space: int) -> None:
        self.free.setdefault(space, []).append(b)
        self.bits |= 1 << space

    def place(self, size: int) -> int:
        """The bin of an item; a full bin closes at once."""
        if not 0 <= size <= self.capacity:
            raise ValueError(f"size {size} is not within the capacity {self.capacity}")
        fits = self.bits >> size
        if fits:
            space = size + ((fits & -fits).bit_length() - 1)
            b = self._take(space)
        else:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes first
                self.n_open -= 1
            b, space = self.next_bin, self.capacity
            self.next_bin += 1
            self.n_open += 1
        if space == size:
            self.n_open -= 1
        else:
            self._put(b, space - size)
        return b


def pieces_of(df: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, n)``: items as they are packed. Only an item above the capacity is split, into
    full pieces and a rest. Null sizes count as 0."""
    n = F.coalesce(F.col(size), F.lit(0))
    last = F.greatest(F.lit(0), F.ceil(n / capacity) - 1).cast("int")
    out = df.select(key, n.alias("__n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return out.select(key, "piece", F.least(F.lit(capacity), F.col("__n") - F.col("piece") * capacity).cast("int").alias("n"))


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, partitions: int | None = None) -> DataFrame:
    """``(key, piece, n, container)``: every item, or piece of a larger one, in its container.

    ``container`` is unique over the result. Items are dealt to ``partitions`` by a hash of their key
    and piece, so that no source fills a task, and packed there in an order that depends on the data
    alone. Without ``partitions`` the shuffle decides (and small inputs use few packers).
    """
    items = pieces_of(df, key, size, capacity)
    order = F.xxhash64(key, "piece")
    items = items.repartition(partitions, order) if partitions else items.repartition(order)
    items = items.withColumn("__part", F.spark_partition_id().cast("long")).sortWithinPartitions(order, key, "piece")
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("container", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, open_bins)
        for b in batches:
            part = b.column(3)
            first = part[0].as_py() << 40 if len(part) else 0
            at = [first + packer.place(n) for n in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(at, pa.int64())], schema=arrow)

    return items.select(key, "piece", "n", "__part").mapInArrow(run, schema)

"""A sparse index of composed changesets over aligned dyadic blocks of scans.

Node ``(level, start)`` takes scan ``start`` to scan ``start + 2^level``. Appending a scan adds its own
changeset and, where a block is complete, the composition of two halves: at most two nodes amortised.
A diff over any span composes the few blocks that part it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binstrata.operators.scans import compose
from binstrata.plans.cover import dyadic_blocks
from binstrata.sources.store import VersionedStore


class DiffIndex:
    """The index, persisted in a versioned store; each node is a folder, the newest version lists them."""

    def __init__(self, store: VersionedStore, keys: Sequence[str], states: Sequence[str]):
        self.store, self.keys, self.states = store, list(keys), list(states)

    def nodes(self) -> dict[tuple[int, int], str]:
        return {(int(k.split(":")[0]), int(k.split(":")[1])): v for k, v in self.store.meta().get("nodes", {}).items()}

    def length(self) -> int:
        """Number of changesets appended."""
        return sum(1 for level, _ in self.nodes() if level == 0)

    def append(self, changeset: DataFrame, at: int | None = None) -> int:
        """Append the changeset of the next scan; returns the index of the step. Repeating a step that is
        there (``at`` below the length) changes nothing."""
        base = self.store.latest()
        nodes, n = self.nodes(), self.length()
        if at is not None and at < n:
            return at
        if at is not None and at > n:
            raise ValueError(f"step {at} would leave a hole after {n}")
        nodes[(0, n)] = self.store.write(changeset, "node")
        size, level, end = 2, 1, n + 1
        while end % size == 0:
            halves = [self._read(nodes[(level - 1, end - size + k * size // 2)]) for k in (0, 1)]
            nodes[(level, end - size)] = self.store.write(compose(halves, self.keys, self.states), "node")
            size, level = size * 2, level + 1
        self.store.commit(base, {"nodes": {f"{a}:{b}": p for (a, b), p in nodes.items()}, "paths": list(nodes.values())})
        return n

    def _read(self, path: str) -> DataFrame:
        return self.store.spark.read.parquet(path)

    def blocks(self, i: int, j: int) -> list[tuple[int, int]]:
        """``(level, start)`` of the nodes that a diff from scan i to scan j composes."""
        return [(size.bit_length() - 1, start) for start, size in dyadic_blocks(i, j)]

    def diff(self, i: int, j: int) -> DataFrame:
        """The changeset from scan i to scan j."""
        nodes = self.nodes()
        return compose([self._read(nodes[b]) for b in self.blocks(i, j)], self.keys, self.states)

    def entries(self) -> DataFrame:
        """``(level, start, n)``: size of each node."""
        out = None
        for (level, start), p in sorted(self.nodes().items()):
            one = self._read(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(level).alias("level"), F.lit(start).alias("start"), "n")
            out = one if out is None else out.unionByName(one)
        return out

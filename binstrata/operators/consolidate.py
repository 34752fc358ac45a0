"""Life cycle of scans: consolidation into archives by a policy, routing, and verified dropping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binstrata.functions.monoids import digest
from binstrata.operators.scans import densify, extract, islands, union_scans
from binstrata.plans.cover import sealed_groups
from binstrata.sources.store import VersionedStore


class Archives:
    """Archives of one dataset in a versioned store: each a table of several scans and its labels."""

    def __init__(self, store: VersionedStore, keys: Sequence[str], states: Sequence[str], encoder: str = "interval"):
        if encoder not in ("interval", "densify"):
            raise ValueError(f"unknown encoder {encoder!r}")
        self.store, self.keys, self.states, self.encoder = store, list(keys), list(states), encoder

    def manifest(self) -> list[dict]:
        """``{labels, path, encoder}`` of each archive, in order of sealing."""
        return self.store.meta().get("archives", [])

    def consolidate(self, labels: Sequence[str], scans: Sequence[DataFrame]) -> str:
        """Write one archive of some scans and publish it; returns its path."""
        base = self.store.latest()
        long = union_scans([s.select(*self.keys, *self.states) for s in scans])
        rows = islands(long, self.keys, self.states) if self.encoder == "interval" else densify(long, self.keys, self.states, len(scans))
        path = self.store.write(rows, "archive")
        kept = [*self.store.meta(base).get("archives", []), {"labels": list(labels), "path": path, "encoder": self.encoder}]
        self.store.commit(base, {"archives": kept, "paths": [a["path"] for a in kept]})
        return path

    def seal(self, labels: Sequence[str], scans: Sequence[DataFrame], scheme: str = "fixed", size: int = 8, base: int = 2) -> list[tuple[int, int]]:
        """Consolidate the groups of a policy that no archive holds yet; returns them."""
        held = {lab for a in self.manifest() for lab in a["labels"]}
        made = []
        for start, n in sealed_groups(len(labels), scheme, size, base):
            group = labels[start : start + n]
            if n > 1 and not set(group) <= held:
                self.consolidate(group, scans[start : start + n])
                made.append((start, n))
        return made

    def resolve(self, label: str) -> tuple[dict, int] | None:
        """The archive, the one sealed last, that holds a scan, and the scan's index in it."""
        return next(((a, a["labels"].index(label)) for a in reversed(self.manifest()) if label in a["labels"]), None)

    def scan(self, label: str) -> DataFrame:
        """A scan read out of its archive."""
        found = self.resolve(label)
        if found is None:
            raise KeyError(label)
        archive, k = found
        return extract(self.store.spark.read.parquet(archive["path"]), self.states, k).select(*self.keys, *self.states)

    def verified(self, label: str, original: DataFrame) -> bool:
        """Whether the archived scan has the rows of the original, all-identity rows aside, by digests of
        both; only then may the original be dropped."""
        zero = F.lit(True)
        for c in self.states:
            zero = zero & (F.coalesce(F.col(c), F.lit(0)) == 0)
        cols = [*self.keys, *self.states]
        return self.scan(label).agg(*digest(cols)).first() == original.where(~zero).select(*cols).agg(*digest(cols)).first()

    def drop_verified(self, originals: Mapping[str, str]) -> list[str]:
        """Delete the originals, paths of Parquet by label, that an archive holds and whose rows it gives back
        digest for digest; returns their labels. All others stay."""
        gone = []
        for label, path in originals.items():
            if self.resolve(label) is not None and self.verified(label, self.store.spark.read.parquet(path)):
                self.store.discard(path)
                gone.append(label)
        return gone

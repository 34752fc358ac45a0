"""Versioned tables: immutable Parquet folders, and a pointer that is swapped atomically.

Layout below ``root``::

    data/...                     immutable files
    _versions/00000001.json      one pointer file for each committed version

A commit creates the pointer file of the next number exclusively. Of two writers that started from
the same version only one can create it; the other gets :class:`CommitConflict`. A writer that dies
leaves files no pointer names, which readers never see.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class CommitConflict(RuntimeError):
    """Another writer committed first."""


class VersionedStore:
    """A sequence of committed versions, each a small JSON document."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def versions(self) -> list[int]:
        """The committed version numbers, ascending."""
        folder = self._path("_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max(self.versions(), default=0)

    def meta(self, version: int | None = None) -> dict:
        """The document of a version (default: the newest); empty for version 0."""
        version = self.latest() if version is None else version
        if version == 0:
            return {}
        stream = self._fs.open(self._path(f"_versions/{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: int, meta: dict) -> int:
        """Publish ``meta`` as version ``base + 1``; raise :class:`CommitConflict` if it exists."""
        version = base + 1
        path = self._path(f"_versions/{version:08d}.json")
        if self.latest() != base:
            raise CommitConflict(f"version {base} is no longer the newest")
        if not self._create(path, meta):
            raise CommitConflict(f"version {version} exists already")
        return version

    def _create(self, path, document: dict) -> bool:
        """Write a JSON document, unless the file exists: then False."""
        staged = self._path(f"_staged/{uuid.uuid4().hex}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        self._fs.mkdirs(path.getParent())
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE  # never over an existing file
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(path), how)
        except Exception:
            self._fs.delete(staged, False)
            return False
        return True

    def claim(self, base: int, lease_s: int):
        """Keep other writers from starting on version ``base + 1``; raise :class:`CommitConflict` if one is
        at work. A claim older than ``lease_s`` seconds is that of a dead writer and gives way. Returns what
        :meth:`release` takes."""
        path = self._path(f"_claims/{base + 1:08d}.json")
        if self.latest() != base:
            raise CommitConflict(f"version {base} is no longer the newest")
        for _ in range(2):
            if self._create(path, {"since": time.time()}):
                return path
            if self._fs.exists(path) and self._fs.getFileStatus(path).getModificationTime() / 1000 + lease_s > time.time():
                break
            self._fs.delete(path, False)
        raise CommitConflict(f"another writer is at work on version {base + 1}")

    def release(self, claim) -> None:
        """Give up a claim."""
        self._fs.delete(claim, False)

    def fresh(self, name: str) -> str:
        """A data path that nobody has used."""
        return f"{self.root}/data/{name}/gen={uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *by: str) -> str:
        """Write ``df``, in partitions ``by``, below a fresh path, unseen until a commit names it; returns the
        path."""
        path, writer = self.fresh(name), df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return path

    def read(self, paths: list[str], schema: str) -> DataFrame:
        """What several calls of :meth:`write` with one name and the same partitions have written."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(f"{schema}, `gen` string").option("basePath", paths[0].rsplit("/", 1)[0])
        return reader.parquet(*paths).drop("gen")

    def discard(self, path: str) -> None:
        """Delete a folder that no version names."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)

    def vacuum(self, keep: int = 2) -> None:
        """Delete pointers older than the newest ``keep`` versions (their data folders as well)."""
        for v in self.versions()[:-keep]:
            old, kept = self.meta(v), [self.meta(k) for k in self.versions()[-keep:]]
            for p in old.get("paths", []):
                if all(p not in k.get("paths", []) for k in kept):
                    target = self._jvm.org.apache.hadoop.fs.Path(p)
                    self._fs.delete(target, True)
            self._fs.delete(self._path(f"_versions/{v:08d}.json"), False)

"""Session helpers: reading tables, shared scratch space, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size (bytes) of a side that may be broadcast by hint.
BROADCAST_LIMIT = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves, but only in local mode; on a cluster a
    missing setting is an error, as a machine-local folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="binstrata-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Scratch:
    """A private folder below :func:`shared_dir` for tables that cut the lineage. It is deleted when the
    driver ends, if not dropped before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it again with the same schema."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table of this folder, or the whole folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def observed(seen: Observation, name: str, default=0):
    """A metric of a plan that has run; ``default`` where it reported nothing, as its rows were known to be
    none before it ran."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return default


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only where the estimate stays below ``limit``; else the join shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Within it, a reader lists its folders in as many tasks as a shuffle has partitions; Spark's own setting
    is a task for each folder, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(parallelism(spark)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hot_keys(df: DataFrame, key: str, share: float = 0.001, least: int = 1000) -> DataFrame:
    """Keys that hold at least ``share`` of all rows (and at least ``least`` rows), as ``(key)``.

    At most ``1 / share`` keys can pass, so the result has a proven bound and may be broadcast.
    The counts are pre-aggregated on the map side; nulls never count as hot.
    """
    rows = df.where(F.col(key).isNotNull())
    most = max(least, rows.count() * share)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= most).select(key)

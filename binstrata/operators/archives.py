"""Archives of repeated scans: which scan is read from where, and what is present in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binstrata.operators.registry import live_rows


def scan_catalog(multiscans: DataFrame) -> DataFrame:
    """``(dataset, scan, label, key, idx, encoder)``: each scan of a dataset, numbered from 1 in the
    order of the labels, and the archive it is read from.

    Of the rows of a ``(dataset, key)`` the newest counts; of the archives that list a scan, the one
    written last (ties: the greater key, then the later position). Rows whose ``scans`` is null or no
    JSON array list no scan.
    """
    archives = live_rows(multiscans.select("dataset", "key", "written_at", "scans", "encoder"), ("dataset", "key"))
    listed = archives.select("dataset", "key", "written_at", "encoder", F.posexplode(F.from_json("scans", "array<string>")).alias("idx", "label"))
    listed = listed.where(F.col("label").isNotNull())
    best = listed.groupBy("dataset", "label").agg(F.max(F.struct("written_at", "key", "idx", "encoder")).alias("s"))
    order = Window.partitionBy("dataset").orderBy("label")
    return best.select("dataset", F.row_number().over(order).alias("scan"), "label", "s.key", "s.idx", "s.encoder")


def segments(catalog: DataFrame) -> DataFrame:
    """``(dataset, key, encoder, idx_lo, idx_hi, shift)``: the stretches of an archive's indices that
    are read from it and follow each other in the dataset; ``scan = idx + shift``."""
    by_key = Window.partitionBy("dataset", "key").orderBy("idx")
    runs = catalog.withColumn("run", F.col("idx") - F.row_number().over(by_key))
    return runs.groupBy("dataset", "key", "encoder", "run", (F.col("scan") - F.col("idx")).alias("shift")).agg(F.min("idx").alias("idx_lo"), F.max("idx").alias("idx_hi")).drop("run")


def presence(intervals: DataFrame, parts: DataFrame) -> DataFrame:
    """``(dataset, dt, path, b, o, lo, hi)``: the scans, by number, in which an archive row's object
    holds its state. Nulls in ``b`` and ``o`` read as 0; rows of the state (0, 0), of archives not in
    ``parts`` and of indices outside them drop out. Repeated rows and pieces stay as they are."""
    rows = intervals.select(
        F.col("key").alias("__key"),
        "dt",
        "path",
        F.coalesce("b", F.lit(0)).alias("b"),
        F.coalesce("o", F.lit(0)).alias("o"),
        F.coalesce("__scan", "__scan_lo").alias("__lo"),
        F.coalesce("__scan", "__scan_hi").alias("__hi"),
    ).where((F.col("b") != 0) | (F.col("o") != 0))
    on = (F.col("__key") == F.col("key")) & (F.col("__lo") <= F.col("idx_hi")) & (F.col("__hi") >= F.col("idx_lo")) & (F.col("__lo") <= F.col("__hi"))
    return rows.join(parts, on).select(
        "dataset",
        "dt",
        "path",
        "b",
        "o",
        (F.greatest("__lo", "idx_lo") + F.col("shift")).alias("lo"),
        (F.least("__hi", "idx_hi") + F.col("shift")).alias("hi"),
    )


def object_series(intervals: DataFrame, multiscans: DataFrame, dataset: str, dt: int, path: str) -> DataFrame:
    """``(label, b, o)`` of one object over all scans of its dataset, whatever archive each is read from;
    identity (0, 0) where it is absent."""
    catalog = scan_catalog(multiscans.where(F.col("dataset") == dataset))
    rows = presence(intervals.where((F.col("dt") == dt) & (F.col("path") == path)), segments(catalog))
    states = rows.select(F.explode(F.sequence("lo", "hi")).alias("__s"), "b", "o").distinct()
    return catalog.join(states, F.col("scan") == F.col("__s"), "left").select("label", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("o", F.lit(0)).alias("o"))

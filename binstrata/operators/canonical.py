"""Rows of canonical identities put into shards that are already written, after the identities changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.functions.monoids import digest, histogram_json
from binstrata.operators.build import identity_rollup, rebin, write_tier
from binstrata.plans.cover import slot_key
from binstrata.plans.spec import PyramidSpec, expand_key
from binstrata.session import Scratch, folder_exists
from binstrata.sources.shards import Registry


def canonicalize_shards(spec: PyramidSpec, schema, root: str, registry: Registry, mapping: DataFrame, column: str, lo: int, hi: int, now: int, scratch: Scratch, prefix: str = "c:") -> DataFrame:
    """``(tier, shard_dur, period_start, key, status)``: what became of each period of each rung that touches
    ``[lo, hi)``.

    No source is read: the leaves in a shard are what its canonical rows are made of (see
    :func:`binstrata.operators.build.identity_rollup`), and ``mapping`` ``(raw, canonical)`` is small beside them.
    A shard whose rows come out as they were is ``unchanged``: neither written nor registered. The others are
    ``written``, staged first and then replaced as whole partitions in the layout of the build, with the
    registry's rows renewed by one commit for each rung; a ``{hash}`` of the key template is that of the new
    rows. A period that is not registered, or has no rows, is ``skipped``. One scan and one rewrite for each rung.
    """
    spark, out = scratch.spark, None
    live = registry.rows().where(F.col("pyramid") == spec.name)
    for tier in spec.tiers:
        for shard in tier.shards:
            spans = ta.periods(lo, hi, shard)
            wanted = spark.createDataFrame([(a, b, slot_key(spec, tier.name, shard, a), lab) for a, b, lab in spans], "period_start bigint, period_end bigint, slot string, label string")
            have = live.where((F.col("tier") == tier.name) & (F.col("shard_dur") == shard)).select(F.col("period_start").alias("__s"), F.col("key").alias("old_key"))
            path = f"{root}/tier={tier.name}/shard={shard}"
            rows = spark.read.schema(schema).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], schema)
            start = ta.floor_col(spec.bin_col, shard)
            # whole periods: pruned by the bins of a scan's row groups
            rows = rows.where((F.col(spec.bin_col) >= spans[0][0]) & (F.col(spec.bin_col) < spans[-1][1])) if spans else rows.where(F.lit(False))
            rows = rows.select(spec.bin_col, *spec.dims, *spec.state_columns)
            rows = rows.join(F.broadcast(wanted.join(have, F.col("period_start") == F.col("__s")).select("__s")), start == F.col("__s"), "left_semi")
            name = f"{tier.name}-{shard}"
            made = scratch.write(identity_rollup(rows, spec, column, mapping, prefix), f"made-{name}")
            before, after = (_digests(x, start, p) for x, p in ((rows, "b"), (made, "a")))
            both = wanted.join(have, F.col("period_start") == F.col("__s"), "left").join(before, F.col("period_start") == F.col("b_s"), "left").join(after, F.col("period_start") == F.col("a_s"), "left")
            status = F.when(F.col("__s").isNull() | F.col("b_n").isNull(), "skipped").when((F.col("b_n") == F.col("a_n")) & (F.col("b_digest") == F.col("a_digest")), "unchanged").otherwise("written")
            verdict = scratch.write(both.select("period_start", "period_end", "slot", "label", "old_key", status.alias("status"), F.col("a_n").alias("n_rows"), F.md5(F.concat_ws(":", "a_n", "a_digest")).alias("hash")), f"verdict-{name}")
            changed = verdict.where("status = 'written'")
            if not changed.isEmpty():
                part = made.join(F.broadcast(changed.select(F.col("period_start").alias("__p"))), start == F.col("__p"), "left_semi")
                write_tier(part, spec, tier.name, shard, root)
                key = F.col("slot")
                if "{hash" in spec.key_template:
                    at = expand_key(spec.key_template, tier=tier.name, shard=shard, period="\u0001", hash="\u0002" * 32)
                    size = at.count("\u0002")
                    key = F.replace(F.replace(F.lit(at), F.lit("\u0001"), F.col("label")), F.lit("\u0002" * size), F.substring("hash", 1, size))
                new = changed.select(F.lit(spec.name).alias("pyramid"), F.lit(tier.name).alias("tier"), F.lit(shard).alias("shard_dur"), "period_start", "period_end", key.alias("key"), F.lit(now).cast("long").alias("written_at"), "n_rows")
                registry.record(new)
            one = verdict.select(F.lit(tier.name).alias("tier"), F.lit(shard).alias("shard_dur"), "period_start", F.coalesce("old_key", "slot").alias("key"), "status")
            out = one if out is None else out.unionByName(one)
    return out


def _digests(rows: DataFrame, start, prefix: str) -> DataFrame:
    plain = rows.select(start.alias("__s"), *[histogram_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes])
    got = plain.groupBy("__s").agg(*digest(rows.columns))
    return got.withColumnsRenamed({"__s": f"{prefix}_s", "n": f"{prefix}_n", "digest": f"{prefix}_digest"})


def with_canonical(base: DataFrame, spec: PyramidSpec, column: str, mapping: DataFrame, tier: str, prefix: str = "c:") -> DataFrame:
    """A tier built with canonical rows from the start: what rewriting its shards must come to."""
    return identity_rollup(rebin(base, spec, spec.tier(tier).bin), spec, column, mapping, prefix)

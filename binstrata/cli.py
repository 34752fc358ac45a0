"""The command line: ``python -m binstrata VERB ...``. Each verb prints one JSON document.

A pyramid lives below a root folder: shards in ``shards``, the registry, the journal of repair requests and
diff indices beside them as versioned tables. ``CONFIG`` is the declaration, as JSON or YAML; ``--range`` is
``FROM/TO``, two ISO instants, half-open.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binstrata.functions import timeaxis as ta
from binstrata.operators import build, canonical, inventory, scans, serve, treediff
from binstrata.operators import fill as filling
from binstrata.operators.consolidate import Archives
from binstrata.operators.diffindex import DiffIndex
from binstrata.plans import cover
from binstrata.plans.spec import PyramidSpec, check_window, from_text
from binstrata.session import Scratch, folder_exists
from binstrata.sources.shards import Registry
from binstrata.sources.store import VersionedStore
from binstrata.streaming.tip import Journal


def _range(text: str) -> tuple[int, int]:
    try:
        a, b = (datetime.fromisoformat(x) for x in text.split("/"))
    except ValueError:
        raise argparse.ArgumentTypeError(f"no range FROM/TO: {text!r}") from None
    lo, hi = (ta.to_ms(x if x.tzinfo else x.replace(tzinfo=timezone.utc)) for x in (a, b))
    if lo >= hi:
        raise argparse.ArgumentTypeError("FROM must lie before TO")
    return lo, hi


def _pairs(items: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in items)


class Site:
    """A pyramid below its root folder."""

    def __init__(self, spark: SparkSession, spec: PyramidSpec, root: str):
        self.spark, self.spec, self.root, self.shards = spark, spec, root.rstrip("/"), f"{root.rstrip('/')}/shards"
        self.registry = Registry(VersionedStore(spark, f"{self.root}/registry"))
        self.journal = Journal(VersionedStore(spark, f"{self.root}/journal"))

    def schema(self) -> str:
        """Columns of the shards that were built, from the version of the first build."""
        meta = VersionedStore(self.spark, f"{self.root}/schema").meta()
        if not meta:
            raise SystemExit(f"nothing is built below {self.root}")
        return meta["schema"]

    def keep_schema(self, df: DataFrame) -> None:
        store = VersionedStore(self.spark, f"{self.root}/schema")
        if not store.latest():
            store.commit(0, {"schema": ", ".join(f"`{c}` {t}" for c, t in df.dtypes)})

    def stored(self) -> DataFrame:
        """Slots that have a folder of shards, with the key of the template."""
        out = self.spark.createDataFrame([], "tier string, shard_dur string, period string, n_rows bigint")
        for tier in self.spec.tiers:
            for shard in tier.shards:
                path = f"{self.shards}/tier={tier.name}/shard={shard}"
                if folder_exists(self.spark, path):
                    rows = self.spark.read.schema(f"{self.schema()}, period string").parquet(path)
                    out = out.unionByName(rows.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(tier.name).alias("tier"), F.lit(shard).alias("shard_dur"), "period", "n_rows"))
        return out


def plan(spark, spec, a) -> dict:
    lo, hi = a.range
    if a.dot:
        with open(a.dot, "w") as f:
            f.write(cover.plan_dot(spec))
    shards: dict[str, int] = {}
    for e in cover.expected_cover(spec, lo, hi):
        shards[f"{e.tier}@{e.shard_dur}"] = shards.get(f"{e.tier}@{e.shard_dur}", 0) + 1
    return {"layers": cover.build_layers(spec), "order": cover.build_order(spec), "expected": shards}


def build_(spark, spec, a) -> dict:
    """Build what is missing, window by window; what is registered is not built again."""
    site, (lo, hi) = Site(spark, spec, a.root), a.range
    values = {m: F.expr(x) for m, x in _pairs(a.value).items()}
    absent = [m.name for m in spec.metrics if m.name not in values]
    if absent:
        raise SystemExit(f"--value is missing for {', '.join(absent)}")
    raw, ms = spark.read.parquet(a.source), F.expr(a.ts).cast("long") if a.ms else ta.ms_of(a.ts)
    base = Scratch(spark, "build").write(build.from_raw(raw.where((ms >= lo) & (ms < hi)), spec, ms, values), "base")
    if a.min_rows and base.limit(a.min_rows).count() < a.min_rows:
        raise build.EmptySourceError(f"fewer than {a.min_rows} rows in the range")
    site.keep_schema(base)
    if a.window:
        check_window(a.window, spec)
    steps = [ta.floor(b - 1, a.window) for _, b, _ in ta.periods(lo, hi, a.window)][1:] if a.window else []
    now, requests, added = a.now or int(time.time() * 1000), site.journal.rows(), 0
    for end in [*steps, hi]:
        if end > lo:
            added = filling.fill(base, spec, site.shards, site.registry, lo, end, now, requests, a.limit, a.seconds).count()
    gone = filling.spent(requests, spec, site.registry, lo, hi)
    pruned = gone.count()
    if pruned:
        site.journal.prune(gone)
    return {"written": added, "pruned": pruned}


def invalidate(spark, spec, a) -> dict:
    site = Site(spark, spec, a.root)
    site.journal.invalidate(spec.name, *a.range, a.now or int(time.time() * 1000))
    return {"requests": site.journal.rows().count()}


def canonicalize(spark, spec, a) -> dict:
    site = Site(spark, spec, a.root)
    with open(a.map) as f:
        ids = spark.createDataFrame(list(json.load(f).items()), "raw string, canonical string")
    rollup = spec.rollup or {"col": a.column, "prefix": "c:"}
    got = canonical.canonicalize_shards(spec, site.schema(), site.shards, site.registry, ids, a.column or rollup["col"], *a.range, a.now or int(time.time() * 1000), Scratch(spark, "canonicalize"), rollup["prefix"])
    return {r.status: r["count"] for r in got.groupBy("status").count().collect()}


def gc(spark, spec, a) -> dict:
    """Registered shards that are no part of the cover; with --apply their rows and folders go."""
    site, now = Site(spark, spec, a.root), a.now or int(time.time() * 1000)
    live = site.registry.rows().where(F.col("pyramid") == spec.name)
    found = inventory.collectable(live, cover.expected_table(spark, spec, *a.range), now, grace=int(a.grace * ta.HOUR), limit=a.limit)
    out = {r.verdict: r["count"] for r in found.groupBy("verdict").count().collect()}
    if a.apply:
        gone = Scratch(spark, "gc").write(found.where("verdict = 'delete'").select(*live.columns), "gone")
        site.registry.drop(gone)
        for r in gone.toLocalIterator():
            site.registry.store.discard(f"{site.shards}/tier={r.tier}/shard={r.shard_dur}/period={ta.label(r.period_start, r.shard_dur)}")
    return out


def adopt(spark, spec, a) -> dict:
    """Register shards that are stored and not registered."""
    site, now = Site(spark, spec, a.root), a.now or int(time.time() * 1000)
    want = cover.expected_table(spark, spec, *a.range)
    labels = want.withColumn("period", F.coalesce(*[F.when(F.col("shard_dur") == s, ta.label_col("period_start", s)) for s in {s for t in spec.tiers for s in t.shards}]))
    have = labels.join(site.stored(), ["tier", "shard_dur", "period"])
    new = inventory.adoptable(have, site.registry.rows().where(F.col("pyramid") == spec.name).drop("pyramid"))
    new = Scratch(spark, "adopt").write(new.select(F.lit(spec.name).alias("pyramid"), "tier", "shard_dur", "period_start", "period_end", "key", F.lit(now).cast("long").alias("written_at"), "n_rows"), "new")
    n = new.count()
    if n:
        site.registry.record(new)
    return {"adopted": n}


def query(spark, spec, a) -> dict:
    site = Site(spark, spec, a.root)
    args = serve.query_params(spec, _pairs(a.param))
    tiers = {t.name: rows for t in spec.tiers if (rows := filling.written_tier(spark, spec, site.shards, t.name, site.schema())) is not None}
    df, said = serve.query(tiers, spec, args.pop("lo"), args.pop("hi"), **args)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
        return {"plan": said}
    return {"plan": said, "records": [r.asDict() for r in df.orderBy(spec.bin_col, *spec.dims).limit(a.rows).collect()]}


def _scans(spark, a) -> tuple[list[str], list[DataFrame]]:
    return a.scan, [spark.read.parquet(f"{a.scans.rstrip('/')}/{s}") for s in a.scan]


def _archives(spark, a) -> Archives:
    return Archives(VersionedStore(spark, a.out), a.keys.split(","), a.states.split(","), a.encoder)


def seal(spark, _, a) -> dict:
    archives = _archives(spark, a)
    made = archives.seal(*_scans(spark, a), scheme=a.scheme, size=a.size)
    gone = archives.drop_verified({s: f"{a.scans.rstrip('/')}/{s}" for s in a.scan}) if a.drop else []
    return {"sealed": made, "dropped": gone}


def extract(spark, _, a) -> dict:
    rows = _archives(spark, a).scan(a.scan[0])
    if a.to:
        rows.write.mode("overwrite").parquet(a.to)
    return {"rows": rows.count()}


def multiscan_bench(spark, _, a) -> dict:
    """Rows of both encoders over synthetic scans of a given churn (see :func:`synthetic_scans`)."""
    out = {}
    for churn in (float(x) for x in a.churn.split(",")):
        long = scans.synthetic_scans(spark, a.n_keys, a.n_scans, churn, a.births, a.seed)
        out[str(churn)] = {"densify": scans.densify(long, ["k"], ["v"], a.n_scans).count(), "interval": scans.islands(long, ["k"], ["v"]).count()}
    return out


def diffindex_update(spark, _, a) -> dict:
    index = DiffIndex(VersionedStore(spark, a.out), a.keys.split(","), a.states.split(","))
    _, tables = _scans(spark, a)
    for k in range(index.length(), len(tables) - 1):
        index.append(scans.diff_tables(tables[k], tables[k + 1], index.keys, index.states), at=k)
    return {"steps": index.length()}


def diffindex_diff(spark, _, a) -> dict:
    rows = DiffIndex(VersionedStore(spark, a.out), a.keys.split(","), a.states.split(",")).diff(a.a, a.b)
    if a.to:
        rows.write.mode("overwrite").parquet(a.to)
    return {"rows": rows.count()}


def diff(spark, _, a) -> dict:
    """Two snapshots of a tree: the nodes that a walk opens, or all that differ."""
    x, y = (treediff.rollup(spark.read.parquet(p)) for p in (a.a, a.b))
    rows = treediff.materialize(x, y) if a.all else treediff.walk(x, y, Scratch(spark, "walk"), a.floor, a.budget)
    return {r.status: r["count"] for r in rows.groupBy("status").count().collect()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("binstrata", description=__doc__.splitlines()[0])
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, config: bool = True, root: bool = True, range_: bool = True) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=(run.__doc__ or name).strip().splitlines()[0])
        v.set_defaults(run=run)
        if config:
            v.add_argument("config")
        if root:
            v.add_argument("--root", required=True)
            v.add_argument("--now", type=int, help="epoch milliseconds; default: the clock")
        if range_:
            v.add_argument("--range", type=_range, required=True)
        return v

    verb("plan", plan, root=False).add_argument("--dot")
    v = verb("build", build_)
    v.add_argument("--source", required=True, help="Parquet of raw rows")
    v.add_argument("--ts", required=True, help="column of instants")
    v.add_argument("--ms", action="store_true", help="--ts gives epoch milliseconds")
    v.add_argument("--value", action="append", default=[], help="METRIC=EXPRESSION")
    v.add_argument("--window", help="build so much at a time")
    v.add_argument("--limit", type=int, help="shards at most")
    v.add_argument("--seconds", type=float, help="time after which no further rung is begun")
    v.add_argument("--min-rows", type=int, default=0)
    verb("invalidate", invalidate)
    v = verb("canonicalize", canonicalize)
    v.add_argument("--map", required=True, help="JSON object from raw to canonical")
    v.add_argument("--column")
    v = verb("gc", gc)
    v.add_argument("--apply", action="store_true")
    v.add_argument("--grace", type=float, default=6.0, help="hours")
    v.add_argument("--limit", type=int)
    verb("adopt", adopt)
    v = verb("query", query, range_=False)
    v.add_argument("--param", action="append", default=[], help="NAME=VALUE, as of a query string")
    v.add_argument("--rows", type=int, default=100, help="records printed")
    v.add_argument("--out", help="write all records here instead")

    def scan_verb(name: str, run, scans_: bool = True) -> argparse.ArgumentParser:
        v = verb(name, run, config=False, root=False, range_=False)
        v.add_argument("--out", required=True, help="root of archives or index")
        v.add_argument("--keys", required=True)
        v.add_argument("--states", required=True)
        if scans_:
            v.add_argument("--scans", default="", help="folder of scans, each a folder of its label")
            v.add_argument("--scan", action="append", required=True, help="label, in order")
        return v

    for name, run in (("multiscan-seal", seal), ("multiscan-extract", extract)):
        v = scan_verb(name, run)
        v.add_argument("--encoder", default="interval", choices=["interval", "densify"])
        v.add_argument("--scheme", default="fixed", choices=["fixed", "exponential"])
        v.add_argument("--size", type=int, default=8)
        v.add_argument("--drop", action="store_true", help="delete originals that are verified")
        v.add_argument("--to")
    v = verb("multiscan-bench", multiscan_bench, config=False, root=False, range_=False)
    v.add_argument("--n-keys", type=int, default=100_000)
    v.add_argument("--n-scans", type=int, default=20)
    v.add_argument("--churn", default="0,0.01,0.05,0.2")
    v.add_argument("--births", type=float, default=0.0)
    v.add_argument("--seed", type=int, default=0)
    scan_verb("diffindex-update", diffindex_update)
    v = scan_verb("diffindex-diff", diffindex_diff, scans_=False)
    v.add_argument("a", type=int)
    v.add_argument("b", type=int)
    v.add_argument("--to")
    v = verb("diff", diff, config=False, root=False, range_=False)
    v.add_argument("a")
    v.add_argument("b")
    v.add_argument("--floor", type=float, default=0.0)
    v.add_argument("--budget", type=int)
    v.add_argument("--all", action="store_true", help="all nodes that differ")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spec = None
    if getattr(a, "config", None):
        with open(a.config) as f:
            spec = from_text(f.read())
    spark = spark or SparkSession.builder.appName("binstrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = a.run(spark, spec, a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])

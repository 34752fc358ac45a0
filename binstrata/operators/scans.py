"""The observation axis: repeated scans of keyed state, as validity intervals and changesets.

A scan table has key columns and state columns. Consolidated, it has ``__scan_lo`` and ``__scan_hi``
(both inclusive), or ``__scan`` if densified. An object whose state is all identity (zero, or null) is
the same as an absent one in extracts and diffs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binstrata.sources.store import VersionedStore

OPEN = 1 << 62


def union_scans(scans: Sequence[DataFrame]) -> DataFrame:
    """One long table of scans, numbered by position in ``__scan``."""
    out = scans[0].withColumn("__scan", F.lit(0).cast("long"))
    for j, s in enumerate(scans[1:], 1):
        out = out.unionByName(s.withColumn("__scan", F.lit(j).cast("long")))
    return out


def _identity(states: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in states:
        out = out & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return out


def _join_on(left: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns})


def unique_per_scan(long: DataFrame, keys: Sequence[str], scan: str = "__scan") -> DataFrame:
    """Raise at runtime if a key occurs twice in one scan; else pass the rows on."""
    w = Window.partitionBy(*keys, scan)
    return long.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("a key occurs twice in one scan")).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def islands(long: DataFrame, keys: Sequence[str], states: Sequence[str], carried_first: Sequence[str] = (), carried_last: Sequence[str] = (), scan: str = "__scan") -> DataFrame:
    """``(*keys, *states, *carried, __scan_lo, __scan_hi)``: the runs of consecutive scans in which a key
    holds one state (nulls equal). Carried columns never open a run; they give their value at the
    run's first or last scan. A key twice in one scan counts once, the greatest state winning.

    One shuffle on the keys serves the ordering, the numbering of runs and the aggregation."""
    carried = [*carried_first, *carried_last]
    rows = long.select(*keys, scan, *states, *carried)
    w = Window.partitionBy(*keys).orderBy(scan, *states)
    start = F.lag(scan).over(w).isNull() | (F.col(scan) - F.lag(scan).over(w) > 1)
    for c in states:
        start = start | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    last_of_scan = F.lead(scan).over(w)
    rows = rows.withColumn("__keep", last_of_scan.isNull() | (last_of_scan != F.col(scan))).where("__keep").drop("__keep")
    rows = rows.withColumn("__new", start.cast("int")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        rows.groupBy(*keys, "__run")
        .agg(*[F.min_by(c, scan).alias(c) for c in [*states, *carried_first]], *[F.max_by(c, scan).alias(c) for c in carried_last], F.min(scan).alias("__scan_lo"), F.max(scan).alias("__scan_hi"))
        .drop("__run")
        .select(*keys, *states, *carried, "__scan_lo", "__scan_hi")
    )


def densify(long: DataFrame, keys: Sequence[str], states: Sequence[str], n_scans: int, additive: Sequence[str] | None = None) -> DataFrame:
    """``(*keys, *states, __scan)``: every key in every scan; where it is absent additive states are 0
    and others null. The grid has keys times scans rows by definition; each key is spread in place, not by
    a join. A key twice in one scan raises an error; scans beyond ``n_scans`` don't count."""
    additive = states if additive is None else additive
    # a key's scans in order, each followed by the empty ones up to the next: no search
    rows = long.where(F.col("__scan").between(0, n_scans - 1))
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__scan", *states))).alias("__rows"))
    at = F.transform("__rows", lambda r: r["__scan"].cast("int"))
    twice = F.size(F.array_distinct(at)) < F.size(at)
    held = held.where(F.when(twice, F.raise_error(F.lit("a key occurs twice in one scan")).cast("boolean")).otherwise(F.lit(True)))
    ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(n_scans)))
    empty = lambda: F.struct(F.lit(None).cast("long").alias("__scan"), *[F.lit(None).cast(dict(long.dtypes)[c]).alias(c) for c in states])
    parts = F.zip_with("__rows", ends, lambda r, e: F.concat(F.array(r), F.array_repeat(empty(), e - r["__scan"].cast("int") - 1)))
    grid = held.select(*keys, F.posexplode(F.concat(F.array_repeat(empty(), at[0]), F.flatten(parts))).alias("__at", "__r"))
    value = F.col("__r")
    return grid.select(*keys, *[(F.coalesce(value[c], F.lit(0)) if c in additive else value[c]).alias(c) for c in states], F.col("__at").cast("long").alias("__scan"))


def extract(consolidated: DataFrame, states: Sequence[str], scan: int) -> DataFrame:
    """One scan out of either encoding; rows of identity state drop out."""
    at = (F.col("__scan") == scan) if "__scan" in consolidated.columns else (F.col("__scan_lo") <= scan) & (F.col("__scan_hi") >= scan)
    return consolidated.where(at & ~_identity(states)).drop("__scan", "__scan_lo", "__scan_hi")


def scan_digest(rows: DataFrame, dt: str = "dt", path: str = "path", states: Sequence[str] = ("b", "o")) -> DataFrame:
    """``(n, sha256)`` of the present rows of one scan, sorted by path and dt, each as compact JSON and a
    newline. The exact digest of an archive: it orders the whole scan in one task, so it is meant for
    single tiles; :func:`binstrata.functions.monoids.digest` compares scans of any size."""
    return rows.where(~_identity(states)).agg(F.count(F.lit(1)).alias("n"), _sorted_sha(dt, path, states))


def _json_string(text: Column) -> Column:
    """A string as JSON in ASCII: others than printable characters escaped, those beyond 16 bits as two."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        out = F.when(c.isin('"', "\\"), F.concat(F.lit("\\"), c))
        for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")):
            out = out.when(c == raw, F.lit(short))
        two = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return out.when((n >= 32) & (n < 127), c).when(n > 0xFFFF, two).otherwise(unit(n))

    plain = ~text.rlike(r'[^ -~]|["\\]')
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(chars, escaped), "")), F.lit('"'))


def _sorted_sha(dt: str, path: str, states: Sequence[str]) -> Column:
    cells = [F.coalesce(F.col(dt), F.lit(0)).cast("string"), _json_string(F.col(path)), *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in states]]
    text = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]\n"))
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(path, dt, text.alias("t")))), lambda r: r["t"]), ""), 256).alias("sha256")


def scan_digests(rows: DataFrame, by: Sequence[str], dt: str = "dt", path: str = "path", states: Sequence[str] = ("b", "o"), most: int = 250_000) -> DataFrame:
    """``(*by, n, sha256, digest)`` of each scan of ``rows``, told apart by ``by``, each in a group of its own:
    the exact digest of :func:`scan_digest` for scans of at most ``most`` present rows, null for larger
    ones, and for all the order-free sum of :func:`binstrata.functions.monoids.digest`, combined before
    the shuffle."""
    from binstrata.functions.monoids import digest

    there = rows.where(~_identity(states))
    sums = there.groupBy(*by).agg(*digest([dt, path, *states]))
    small = sums.where(F.col("n") <= most).select(*[F.col(c).alias(f"__by_{c}") for c in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    exact = _prefixed(there.join(small, on, "left_semi").groupBy(*by).agg(_sorted_sha(dt, path, states)), "__x_")
    return sums.join(exact, _join_on(sums, by, "__x_"), "left").select(*by, "n", F.col("__x_sha256").alias("sha256"), "digest")


def _changed(states: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in states:
        out = out | ~F.col(f"{c}__a").eqNullSafe(F.col(f"{c}__b"))
    return out


def diff_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], states: Sequence[str], null_identity: Sequence[str] = ()) -> DataFrame:
    """``(*keys, {c}__a, {c}__b)``: the changeset from one scan to another: keys whose state differs, an
    absent one reading as identity (0, or null for the columns of ``null_identity``)."""
    left = a.select(*keys, *states)
    right = _prefixed(b.select(*keys, *states), "__b_")
    both = left.join(right, _join_on(left, keys, "__b_"), "full_outer")
    fill = lambda c, name: F.col(c) if name in null_identity else F.coalesce(F.col(c), F.lit(0))
    out = both.select(*[F.coalesce(F.col(k), F.col(f"__b_{k}")).alias(k) for k in keys], *[fill(c, c).alias(f"{c}__a") for c in states], *[fill(f"__b_{c}", c).alias(f"{c}__b") for c in states])
    return out.where(_changed(states))


def diff_scans(consolidated: DataFrame, keys: Sequence[str], states: Sequence[str], a: int, b: int) -> DataFrame:
    """The changeset between two scans of an interval table, from the rows that are valid at exactly one
    of them: a row that spans both can't differ. One aggregation, no join."""
    at_a = (F.col("__scan_lo") <= a) & (F.col("__scan_hi") >= a)
    at_b = (F.col("__scan_lo") <= b) & (F.col("__scan_hi") >= b)
    rows = consolidated.where(at_a != at_b)
    side = lambda cond, c: F.coalesce(F.max(F.when(cond, F.col(c))), F.lit(0))
    out = rows.groupBy(*keys).agg(*[side(at_a, c).alias(f"{c}__a") for c in states], *[side(at_b, c).alias(f"{c}__b") for c in states])
    return out.where(_changed(states))


def series(consolidated: DataFrame, states: Sequence[str], labels: DataFrame, **key) -> DataFrame:
    """``(label, *states)`` of one key over all scans, identity where it is absent. ``labels``:
    ``(scan, label)``."""
    rows = consolidated
    for k, v in key.items():
        rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
    spans = rows.select(*[F.col(c).alias(f"__v_{c}") for c in states], F.explode(F.sequence("__scan_lo", "__scan_hi")).alias("__at"))
    return labels.join(spans, F.col("scan") == F.col("__at"), "left").select("label", *[F.coalesce(f"__v_{c}", F.lit(0)).alias(c) for c in states])


def stamped(consolidated: DataFrame, stamps: Sequence[int], open_end: int = OPEN) -> DataFrame:
    """Scan indices as validity ``[vf, vt)`` in stamps; a run at the newest scan stays open."""
    ts = F.array(*[F.lit(s).cast("long") for s in [*stamps, open_end]])
    cols = [c for c in consolidated.columns if c not in ("__scan_lo", "__scan_hi")]
    return consolidated.select(*cols, F.element_at(ts, F.col("__scan_lo").cast("int") + 1).alias("vf"), F.element_at(ts, F.col("__scan_hi").cast("int") + 2).alias("vt"))


def as_of(intervals: DataFrame, stamp: int) -> DataFrame:
    """Rows valid at a stamp."""
    return intervals.where((F.col("vf") <= stamp) & (F.col("vt") > stamp))


def as_of_join(events: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, cell: int) -> DataFrame:
    """Each event with the interval of its key that holds its instant, if any (left join). Intervals are
    cut into cells of ``cell`` units, so that a key with very many rows is spread over its time."""
    right = _prefixed(intervals, "__i_")
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    if lo is None:
        lo, hi = 0, -1
    right = right.where((F.col("__i_vt") > lo) & (F.col("__i_vf") <= hi) & (F.col("__i_vt") > F.col("__i_vf")))
    first = F.floor(F.greatest(F.col("__i_vf"), F.lit(lo)) / cell)
    last = F.floor((F.least(F.col("__i_vt"), F.lit(hi + 1)) - 1) / cell)
    right = right.withColumn("__cell", F.explode(F.sequence(first, last)))
    on = _join_on(events, keys, "__i_") & (F.floor(events[at] / cell) == F.col("__cell")) & (events[at] >= F.col("__i_vf")) & (events[at] < F.col("__i_vt"))
    rest = [c for c in intervals.columns if c not in keys]
    return events.join(right, on, "left").select(*[events[c] for c in events.columns], *[F.col(f"__i_{c}").alias(c if c not in events.columns else f"i_{c}") for c in rest])


def append_scan(prev: DataFrame, new: DataFrame, keys: Sequence[str], states: Sequence[str], stamp: int, carried_last: Sequence[str] = (), open_end: int = OPEN) -> DataFrame:
    """Stamped intervals after one more scan: the same as consolidating all scans anew.

    Keys of the new scan whose state differs from their open run, or that have none, open a run at
    ``stamp``; open runs whose key is gone or differs close at it; carried columns of runs that go on
    take the new values. Closed runs are passed through without a join. The result has ``change``:
    ``opened``, ``closed`` or null."""
    cols = [*keys, *states, *carried_last, "vf", "vt"]
    closed = prev.where(F.col("vt") != open_end).select(*cols, F.lit(None).cast("string").alias("change"))
    return closed.unionByName(_appended(prev.where(F.col("vt") == open_end).select(*cols), new, keys, states, stamp, carried_last, open_end))


def _appended(live: DataFrame, new: DataFrame, keys: Sequence[str], states: Sequence[str], stamp: int, carried_last: Sequence[str], open_end: int) -> DataFrame:
    """What becomes of the open runs with one more scan: one join."""
    rising = F.when(F.col("vf") >= stamp, F.raise_error(F.lit("stamps must increase")).cast("boolean")).otherwise(F.lit(True))
    live = live.where(rising)
    scan = _prefixed(new.select(*keys, *states, *carried_last), "__n_").withColumn("__in", F.lit(True))
    both = live.withColumn("__was", F.lit(True)).join(scan, _join_on(live, keys, "__n_"), "full_outer")
    same = F.lit(True)
    for c in states:
        same = same & F.col(c).eqNullSafe(F.col(f"__n_{c}"))
    goes_on = F.col("__was").isNotNull() & F.col("__in").isNotNull() & same
    old = F.struct(*[F.col(k).alias(k) for k in keys], *[F.col(c).alias(c) for c in states], *[F.when(goes_on, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) for c in carried_last], F.col("vf").alias("vf"), F.when(goes_on, F.lit(open_end)).otherwise(F.lit(stamp)).alias("vt"), F.when(~goes_on, "closed").alias("change"))
    fresh = F.struct(*[F.col(f"__n_{c}").alias(c) for c in [*keys, *states, *carried_last]], F.lit(stamp).cast("long").alias("vf"), F.lit(open_end).cast("long").alias("vt"), F.lit("opened").alias("change"))
    made = F.array_compact(F.array(F.when(F.col("__was").isNotNull(), old), F.when(F.col("__in").isNotNull() & ~goes_on, fresh)))
    return both.select(F.explode(made).alias("r")).select("r.*")


class IntervalTable:
    """Stamped intervals in a versioned store. An append reads and replaces the open runs only, and adds a
    partition of what it closed; closed runs are never read or written again. It fits ``foreachBatch``: a
    batch that comes again with the stamp of the newest version changes nothing."""

    def __init__(self, store: VersionedStore, keys: Sequence[str], states: Sequence[str], carried_last: Sequence[str] = (), open_end: int = OPEN):
        self.store, self.keys, self.states, self.carried_last, self.open_end = store, list(keys), list(states), list(carried_last), open_end

    def _read(self, meta: dict, paths: list[str], is_open: bool) -> DataFrame:
        return self.store.read(paths, meta["schema"]).where(F.col("__open") == is_open).drop("__open")

    def rows(self, version: int | None = None) -> DataFrame:
        """All runs as of a version, the newest by default. There must be one."""
        meta = self.store.meta(version)
        return self._read(meta, meta["closed"], False).unionByName(self._read(meta, [meta["open"]], True))

    def append(self, new: DataFrame, stamp: int) -> int:
        """Append one scan; returns the version that holds it. The same as :func:`append_scan`."""
        base, meta = self.store.latest(), self.store.meta()
        if base and meta["stamp"] == stamp:
            return base
        if base and meta["stamp"] > stamp:
            raise ValueError("stamps must increase")
        cols = [*self.keys, *self.states, *self.carried_last]
        if base:
            live = self._read(meta, [meta["open"]], True)
        else:
            live = new.select(*cols, F.lit(stamp).cast("long").alias("vf"), F.lit(self.open_end).cast("long").alias("vt")).where(F.lit(False))
        made = _appended(live, new, self.keys, self.states, stamp, self.carried_last, self.open_end).drop("change")
        schema = ", ".join([*(f"`{c}` {t}" for c, t in made.dtypes), "`__open` boolean"])
        path = self.store.write(made.withColumn("__open", F.col("vt") == self.open_end), "runs", "__open")
        closed = [*meta.get("closed", []), path]
        return self.store.commit(base, {"schema": schema, "stamp": stamp, "open": path, "closed": closed, "paths": closed})


def delta(intervals: DataFrame, stamp: int) -> DataFrame:
    """Rows opened (``op`` 1) and closed (``op`` -1) at a stamp."""
    one = lambda cond, op: intervals.where(cond).withColumn("op", F.lit(op).cast("byte"))
    return one(F.col("vf") == stamp, 1).unionByName(one(F.col("vt") == stamp, -1))


def interval_digests(intervals: DataFrame, columns: Sequence[str], open_end: int = OPEN) -> DataFrame:
    """``(stamp, op, n, digest)`` of what opened and closed at each stamp, in any order of rows."""
    from binstrata.functions.monoids import digest

    opened = intervals.select(F.col("vf").alias("stamp"), F.lit(1).alias("op"), *columns)
    closed = intervals.where(F.col("vt") != open_end).select(F.col("vt").alias("stamp"), F.lit(-1).alias("op"), *columns)
    return opened.unionByName(closed).groupBy("stamp", "op").agg(*digest(columns))


def merge_runs(runs: Sequence[DataFrame], identity: Sequence[str], policy: str | None = None, low: Sequence[str] = (), high: Sequence[str] = ()) -> DataFrame:
    """Merge tables of one schema. Without a policy all rows stay. ``minmax`` reduces rows of one identity:
    columns of ``low`` to their least, of ``high`` to their greatest value, all others must agree (a
    disagreement raises at runtime). ``newest`` keeps the row of the last table that has the identity."""
    out = runs[0].withColumn("__src", F.lit(0))
    for k, r in enumerate(runs[1:], 1):
        out = out.unionByName(r.withColumn("__src", F.lit(k)))
    rest = [c for c in runs[0].columns if c not in identity]
    if policy is None:
        return out.drop("__src")
    if policy == "newest":
        best = F.max_by(F.struct(*rest), "__src").alias("__r")
        return out.groupBy(*identity).agg(best).select(*identity, "__r.*")
    others = [c for c in rest if c not in low and c not in high]
    aggs = [F.min(c).alias(c) for c in low] + [F.max(c).alias(c) for c in high]
    for c in others:
        agree = F.min(F.struct(F.col(c))) <= F.max(F.struct(F.col(c)))
        same = F.min(F.struct(F.col(c))).eqNullSafe(F.max(F.struct(F.col(c))))
        aggs.append(F.when(agree & same, F.min(c)).otherwise(F.raise_error(F.lit(f"rows of one identity disagree on {c}"))).alias(c))
    return out.groupBy(*identity).agg(*aggs).select(*runs[0].columns)


def compose(changesets: Sequence[DataFrame], keys: Sequence[str], states: Sequence[str]) -> DataFrame:
    """One changeset that does what several do in order: the first before and the last after of each key;
    keys that come back to where they were drop out. Associative."""
    out = changesets[0].withColumn("__seq", F.lit(0))
    for k, c in enumerate(changesets[1:], 1):
        out = out.unionByName(c.withColumn("__seq", F.lit(k)))
    before = F.min_by(F.struct(*[F.col(f"{c}__a") for c in states]), "__seq").alias("__x")
    after = F.max_by(F.struct(*[F.col(f"{c}__b") for c in states]), "__seq").alias("__y")
    return out.groupBy(*keys).agg(before, after).select(*keys, "__x.*", "__y.*").where(_changed(states))


def patch(rows: DataFrame, changeset: DataFrame, keys: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Apply a changeset to a scan; keys whose state becomes identity drop out."""
    c = _prefixed(changeset.select(*keys, *[f"{s}__b" for s in states]), "__c_").withColumn("__hit", F.lit(True))
    left = rows.select(*keys, *states)
    both = left.join(c, _join_on(left, keys, "__c_"), "full_outer")
    out = both.select(*[F.coalesce(F.col(k), F.col(f"__c_{k}")).alias(k) for k in keys], *[F.when(F.col("__hit").isNotNull(), F.col(f"__c_{s}__b")).otherwise(F.col(s)).alias(s) for s in states])
    return out.where(~_identity(states))


def synthetic_scans(spark, n_keys: int, n_scans: int, churn: float, births: float = 0.0, seed: int = 0) -> DataFrame:
    """``(k, v, __scan)``: generated scans, by arithmetic, so the same everywhere. From scan to scan the value of
    a share ``churn`` of the keys rises by one, and a share ``births`` of them comes or goes."""
    hit = lambda i, share, salt: F.pmod(F.col("k") * 7919 + i * 104729 + (seed + salt) * 611953, F.lit(10_000)) < int(share * 10_000)
    steps = lambda share, salt: F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("__scan")), F.lit(0).cast("long"), lambda a, i: a + F.when((i > 0) & hit(i, share, salt), 1).otherwise(0))
    grid = spark.range(n_keys).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_scans - 1).cast("long"))).alias("__scan"))
    rows = grid.select("k", (F.pmod(F.col("k") * 31, F.lit(997)) + steps(churn, 0)).alias("v"), "__scan", (F.pmod(steps(births, 1), F.lit(2)) == 0).alias("__there"))
    return rows.where("__there").drop("__there")

import random

import numpy as np
import pytest

from binstrata.operators import geo
from binstrata.plans import geo_cover as g


def test_known_cells():
    # published examples of the grid: the six face cells and a leaf's face and level
    assert [g.to_token(f << 61 | g.lsb(0)) for f in range(6)] == ["1", "3", "5", "7", "9", "b"]
    assert g.to_token(int(g.cells_at(np.array([0.0]), np.array([0.0]), 30)[0])) == "1000000000000001"
    faces = g.cells_at(np.array([0, 0, 90, 0, 0, -90.0]), np.array([0, 90, 0, 180, -90, 0.0]), 0)
    assert [int(c) >> 61 for c in faces] == [0, 1, 2, 3, 4, 5]


def test_points_lie_in_their_cells_and_parents_agree():
    rng = np.random.default_rng(1)
    lat, lng = np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), rng.uniform(-180, 180, 300)
    fine = g.cells_at(lat, lng, 14)
    for k in (0, 3, 9, 13):
        up = g.cells_at(lat, lng, k)
        assert [g.parent(int(c), k) for c in fine] == [int(c) for c in up]
    for c, a, b in list(zip(fine, lat, lng))[:60]:
        x, y = g.cell_samples(int(c), 9)
        # every inner sample of a cell maps back to it
        inner = g.cells_at(x[2:-2, 2:-2].ravel(), y[2:-2, 2:-2].ravel(), 14)
        assert set(inner.tolist()) == {int(c)}
        assert x.min() - 0.05 <= a <= x.max() + 0.05


def test_ranges():
    face = 2 << 61 | g.lsb(0)
    kids = g.children(face)
    assert all(g.parent(k) == face for k in kids)
    lo, hi = g.descendants(face, 30)
    assert lo == g.descendants(kids[0], 30)[0] and hi == g.descendants(kids[3], 30)[1]
    assert g.cover_ranges([face, kids[1]], 30) == [(lo, hi)]
    random.seed(2)
    for _ in range(100):
        a = [(x, x + random.randrange(5)) for x in random.sample(range(40), 5)]
        b = [(x, x + random.randrange(5)) for x in random.sample(range(40), 5)]
        both = {v for lo, hi in a for v in range(lo, hi + 1)} & {v for lo, hi in b for v in range(lo, hi + 1)}
        assert {v for lo, hi in g.intersect_ranges(a, b) for v in range(lo, hi + 1)} == both


def test_box_cells_cover_the_box():
    rng = np.random.default_rng(3)
    for box in (g.BBox(40, -20, 60, 30), g.BBox(-10, 170, 10, -170), g.BBox(84, -180, 90, 180), g.BBox(40.7, -74.02, 40.75, -73.95)):
        for level in (3, 6):
            cells = set(g.bbox_cells(box, level))
            width = (box.east - box.west) % 360 if box.west > box.east else box.east - box.west
            lat = rng.uniform(box.south, box.north, 500)
            lng = (box.west + rng.uniform(0, 1, 500) * width + 180) % 360 - 180
            assert set(g.cells_at(lat, lng, level).tolist()) <= cells
    level, cells = g.pick_resolution(g.BBox(40, -20, 60, 30), [8, 5, 3], 100)
    assert level in (5, 3) and 0 < len(cells) <= 100


def brute_cover(roots, wanted):
    """Least number of terms by trying all sets of terms."""
    from itertools import combinations

    nodes, up = [], {}

    def visit(n, parent):
        nodes.append(n)
        up[id(n)] = parent
        for k in n.kids:
            visit(k, n)

    for r in roots:
        visit(r, None)
    leaves = [n for n in nodes if n.leaf]
    for size in range(len(nodes) + 1):
        for terms in combinations(nodes, size):
            for signs in range(1 << size):
                op = {id(t): bool(signs >> k & 1) for k, t in enumerate(terms)}

                def selected(n):
                    while n is not None:
                        if id(n) in op:
                            return op[id(n)]
                        n = up[id(n)]
                    return False

                if all(selected(n) == (n.term in wanted) for n in leaves):
                    return size


def test_least_cover_by_brute_force():
    random.seed(4)
    for _ in range(25):
        count = iter(range(100))

        def tree(depth):
            n = g.Node(next(count))
            if depth == 0:
                n.leaf = True
            else:
                n.kids = [tree(depth - 1) for _ in range(random.randrange(1, 4))]
            return n

        roots = [tree(2)]
        leaves = [k.term for n in roots[0].kids for k in n.kids]
        if len(leaves) > 6:
            continue
        wanted = {x for x in leaves if random.random() < 0.6}
        inc, exc = g.least_cover(roots, wanted)
        assert len(inc) + len(exc) == brute_cover(roots, wanted)


def test_minimal_cover_selects_exactly():
    random.seed(5)
    base = [g.children(c) for c in g.children(1 << 61 | g.lsb(0))]
    system = [x for cs in base for c in cs for x in g.children(c)]
    for _ in range(50):
        include = random.sample(system, random.randrange(1, len(system) + 1))
        for subtract in (True, False):
            inc, exc = g.minimal_cover(include, system, subtract)
            assert subtract or not exc
            assert {c for c in system if g.in_cover(c, set(inc), set(exc))} == set(include)
    assert len(g.minimal_cover(system, system)[0]) == 1
    assert g.minimal_cover([], system) == ([], [])
    with pytest.raises(ValueError):
        g.minimal_cover([base[0][0]], [base[0][0], g.children(base[0][0])[0]])


def test_vocabulary():
    face = 0 << 61 | g.lsb(0)
    leaves = {f"s{k}": g.children(g.children(face)[k % 4])[k // 4] for k in range(12)}
    forest = g.vocabulary_forest([face, *g.children(face)], leaves)
    inc, exc = g.vocabulary_cover(forest, [k for k in leaves if k != "s3"])
    assert (inc, exc) == ([face], ["s3"])
    assert not g.vocabulary_cover(forest, [k for k in leaves if k != "s3"], positive_only=True)[1]
    with pytest.raises(ValueError):
        g.vocabulary_cover(forest, ["unknown"])


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10.0, 20.0), (-80.0, -170.0), (45.0, 179.0), (None, 1.0), (float("nan"), 2.0)], "lat double, lng double")
    rows = df.withColumn("c", geo.cell_at("lat", "lng", 12)).select("lat", "lng", "c", geo.level_of("c").alias("l"), geo.to_token("c").alias("t"), geo.parent("c", 5).alias("p"), geo.from_token(geo.to_token("c")).alias("back"), geo.descendants("c", 14).alias("r"), geo.parent("c", 13).alias("none")).collect()
    for r in rows[:3]:
        want = int(g.cells_at(np.array([r.lat]), np.array([r.lng]), 12)[0])
        assert geo.unsigned(r.c) == want and r.l == 12 and r.t == g.to_token(want) and r.back == r.c and r.none is None
        assert geo.unsigned(r.p) == g.parent(want, 5)
        assert (geo.unsigned(r.r.lo), geo.unsigned(r.r.hi)) == g.descendants(want, 14)
    assert rows[3].c is None and rows[4].c is None
    ids = [1 << 61 | g.lsb(0), 5 << 61 | g.lsb(0), 3 << 61 | g.lsb(2)]
    got = spark.createDataFrame([(geo.signed(i),) for i in ids], "c bigint").orderBy(geo.ordered("c")).collect()
    assert [geo.unsigned(r.c) for r in got] == sorted(ids)
    assert geo.where_cover(spark.createDataFrame([(1,)], "c bigint"), "c", [], []).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_cover_terms_are_as_few_as_those_of_the_driver(spark, scratch):
    import random

    rng = random.Random(4)
    base = [geo.unsigned(c) for c in (1 << 61 | g.lsb(0), 3 << 61 | g.lsb(0))]
    for _ in range(4):
        base = [k for c in base for k in g.children(c)]
    for share in (0.1, 0.5, 0.9):
        system = rng.sample(base, 300)
        wanted = [c for c in system if rng.random() < share or (c >> 56) % 3 == 0]
        df = spark.createDataFrame([(geo.signed(c), c in set(wanted)) for c in system] + [(None, True)], "c bigint, w boolean")
        terms = geo.cover_terms(df, "c", "w", scratch)
        inc, exc = g.minimal_cover(wanted, system)
        assert terms.count() == len(inc) + len(exc)
        got = {geo.unsigned(r.c) for r in geo.where_terms(df, "c", terms).select("c").collect()}
        assert got == set(wanted)
    assert geo.cover_terms(df.where("false"), "c", "w", scratch).count() == 0
    both = spark.createDataFrame([(geo.signed(base[0]), True), (geo.signed(g.children(base[0])[0]), False)], "c bigint, w boolean")
    with pytest.raises(Exception, match="contain each other"):
        geo.cover_terms(both, "c", "w", scratch).count()


def test_ranges_are_merged_on_both_sides_of_the_greatest_bigint(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from tools.verify import rows

    # keys of the places 0, 1, 262142, 262143 (whose last leaf is the greatest bigint), 262144 and 393215 (the last one)
    keys = [0, 5046512, 4587040, 3342096, 2097152, 1244944]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    got = entry.queries()["G5_ranges_merged"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()["G5_ranges_merged"])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert rows(got.columns, got.collect()) == want == rows(["lo", "hi"], [(0, 1), (262142, 262144), (393215, 393215)])

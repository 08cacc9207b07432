import math
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trellis.functions import tables as T
from trellis.operators import intervals, measures, network, routing, selection, spatial
from trellis.operators.routing import Lcg
from trellis.plans import queries
from trellis.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf, columns):
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)
    return sorted((tuple(clean(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want.astype(object).where(want.notna(), None), columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-6)) for u, v in zip(x, y)), (x, y)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.gauss(0, 1) * 10 ** rng.randint(0, 4), rng.gauss(0, 50)) for i in range(80)]
    right = [(i, rng.gauss(0, 1) * 10 ** rng.randint(0, 4), rng.gauss(0, 50)) for i in range(60)] + [(100, left[0][1], left[0][2]), (99, left[0][1], left[0][2])]
    got = {r.lid: r.rid for r in spatial.nearest(spark.createDataFrame(left, "lid bigint, lx double, ly double"), spark.createDataFrame(right, "rid bigint, rx double, ry double")).collect()}
    assert got == {i: min(((x - a) * (x - a) + (y - b) * (y - b), k) for k, a, b in right)[1] for i, x, y in left}
    none = spark.createDataFrame([], "rid bigint, rx double, ry double")
    assert spatial.nearest(spark.createDataFrame(left, "lid bigint, lx double, ly double"), none).count() == 0


def test_nearest_by_small_tasks_and_cells(spark, monkeypatch):
    """Crowded tiles, copies, null places, wide tiles in parts and either side as the smaller one; the number of tasks follows from the rows."""
    for name, value in (("TASK", 50), ("CELL", 3), ("PART", 8)):
        monkeypatch.setattr(spatial, name, value)
    rng = random.Random(9)
    spots = [(rng.gauss(0, 3), rng.gauss(0, 3)) for _ in range(70)] + [(5.0, 5.0)] * 20 + [(rng.gauss(0, 4000), rng.gauss(0, 4000)) for _ in range(20)]
    many, few = [(i, *p) for i, p in enumerate(spots)], [(i, *p) for i, p in enumerate(spots[60:95])]
    near = lambda x, y, of: min(((x - a) * (x - a) + (y - b) * (y - b), k) for k, a, b in of)
    frame = lambda rows, s: spark.createDataFrame([*rows, (-1, None, 2.0)], f"{s}id bigint, {s}x double, {s}y double")
    for left, right in ((many, few), (few, many)):
        got = spatial.nearest(frame(left, "l"), frame(right, "r"))
        assert sorted((r.lid, (r.d2, r.rid)) for r in got.collect()) == [(i, near(x, y, right)) for i, x, y in left]
        assert got.rdd.getNumPartitions() == math.ceil(len(left) / 50)
    got = spatial.nearest(frame(many, "l"), frame(many, "r"), self_join=True)
    assert sorted((r.lid, (r.d2, r.rid)) for r in got.collect()) == [(i, near(x, y, [p for p in many if p[0] != i])) for i, x, y in many]


def test_pareto_equals_brute_force(spark):
    rng = random.Random(4)
    data = [(i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(300)]
    got = sorted(r.i for r in selection.pareto(spark.createDataFrame(data, "i int, x double, y double"), "x", "y", 7).collect())
    assert got == sorted(i for i, x, y in data if not any(a <= x and b <= y and (a < x or b < y) for _, a, b in data))


def test_cycles_and_depth(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    found = {r.root: r.is_tree for r in network.forest(e, 2).collect()}
    assert found["a"] and not any(v for k, v in found.items() if k in "xy")
    deep = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(40)], "child string, parent string")
    sums = {r.node: r.value for r in network.accumulate(deep, spark.createDataFrame([("n40", 2.0), ("n10", 1.0)], "node string, value double")).collect()}
    assert sums["n0"] == 3 and sums["n11"] == 2
    assert {r.root for r in network.roots(deep, 6).collect()} == {"n0"}


def test_intervals(spark):
    iv = spark.createDataFrame([("k", 1, 0, 10, 5), ("k", 2, 5, 7, 7), ("k", 3, 7, 12, 7), ("k", 4, 20, 21, 20)], "key string, id int, lo int, hi int, mid int")
    assert {r.id: r.covering for r in intervals.stabbed(iv, "key", "mid").collect()} == {1: 2, 2: 3, 3: 3, 4: 1}
    assert [(r.gap_from, r.gap_to) for r in intervals.gaps(iv, "key").collect()] == [(12, 20)]
    assert sorted((r.lo, r.hi) for r in intervals.merged(iv, "key").collect()) == [(0, 12), (20, 21)]


def test_measures(spark):
    cuts = spark.createDataFrame([([5.0, 0.0, 0.3, 0.9, 4.8],)], "c array<double>").select(measures.kept_cuts("c", 0.5).alias("c")).first().c
    assert cuts == [0.0, 0.9, 4.8]
    seg = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0), ("a", 0.0, 0.0, 0.0, 5.0), ("b", 0.0, 0.0, 1.0, 1.0)], "k string, x1 double, y1 double, x2 double, y2 double")
    got = {r.k: r.orientation for r in measures.orientation(seg, "k").collect()}
    assert min(got["a"], 90 - got["a"]) < 1e-6 and abs(got["b"] - 45) < 1e-6


def test_generator():
    g = Lcg(42)
    assert [g.below(10) for _ in range(5)] == [0, 3, 8, 4, 0]


def test_jobs(spark):
    at = lambda s: F.to_timestamp(F.lit(f"2024-01-01 00:00:0{s}"))
    table = spark.createDataFrame([("a", "UPLOADED"), ("b", "RUNNING"), ("c", "CANCELLED"), ("d", "UPLOADED")], "id string, status string").select("id", "status", *[F.lit(None).cast(t).alias(n) for n, t in (("error", "string"), ("started", "timestamp"), ("finished", "timestamp"))], at(0).alias("created"))
    ev = spark.createDataFrame([("a", "DONE", 2), ("a", "RUNNING", 1), ("b", "CANCELLED", 1), ("b", "FAILED", 2), ("c", "DONE", 1)], "id string, status string, s int").select("id", "status", F.timestamp_seconds("s").alias("at"), F.lit(None).cast("string").alias("error"))
    assert {r.id: r.status for r in jobs.apply(table, ev).collect()} == {"a": "DONE", "b": "CANCELLED", "c": "CANCELLED", "d": "UPLOADED"}
    assert {r.id: r.status for r in jobs.recovered(table).collect()}["b"] == "FAILED"
    assert [r.id for r in jobs.listed(table, ["UPLOADED"], 0, 1).collect()] == ["d"] and jobs.estimate(17) == 22


def test_drop_folder(spark, tmp_path):
    from tests.core.test_districts import CASES, MAIN, collection

    for d in ("in", "out", "chk"):
        (tmp_path / d).mkdir()
    (tmp_path / "in/one.geojson").write_text(collection(MAIN + CASES["straight"]))
    q = jobs.watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/chk", strategies=("flow",))
    q.processAllAvailable()
    q.stop()
    assert abs(spark.read.parquet(f"{tmp_path}/out/variants").first().score - 0.6913) < 1e-4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-1, 30), st.floats(1, 900), st.integers(0, 6)), min_size=1, max_size=14))
def test_sized_forest(nodes):
    """Edges only go up; none is smaller than one below it, no run is too long unless at the table's end, and no single step can be taken back."""
    above = [None if p < 0 or p >= i else p for i, (p, _, _) in enumerate(nodes)]
    length, start = [n for _, n, _ in nodes], [s for *_, s in nodes]
    got = routing.sized(length, above, start)
    assert routing.sized(length, above, got) == got

    def fits(step):
        for i in range(len(step)):
            run, e = 0.0, i
            while e is not None:
                below = [j for j in range(len(step)) if above[j] == e]
                if any(step[j] > step[e] for j in below):
                    return False
                run = run + length[e] if e == i or step[e] == last else length[e]
                last = step[e]
                if run > T.DIAMETERS[last][2] + 1e-9 and last + 1 < len(T.DIAMETERS):
                    return False
                e = above[e]
        return True

    assert fits(got) and all(a >= b for a, b in zip(got, start))
    if fits(start):
        assert got == start


def test_sized_path_goes_up_run_by_run():
    # 181 m is the longest run of the first row, 245 m of the second.
    assert routing.sized([100, 100, 100], [None, 0, 1], [0, 0, 0]) == [2, 2, 2]
    assert routing.sized([100, 100, 50], [None, 0, 0], [0, 0, 0]) == [1, 1, 0]


@settings(max_examples=8, deadline=None)
@given(parents=st.lists(st.integers(0, 10**6), min_size=1, max_size=25), lengths=st.lists(st.integers(1, 5), min_size=25, max_size=25))
def test_longest_paths_equal_a_walk_over_all(spark, parents, lengths):
    """Random trees (node i hangs on one of smaller number): longest way down and longest simple path against walks from every node."""
    edges = [(i + 1, p % (i + 1), lengths[i]) for i, p in enumerate(parents)]
    near = {}
    for c, p, w in edges:
        near.setdefault(c, []).append((p, w))
        near.setdefault(p, []).append((c, w))

    def far(at, back):
        return max((w + far(n, at) for n, w in near[at] if n != back), default=0)

    up = {c: p for c, p, _ in edges}
    want = {n: max(w + far(c, n) for c, w in near[n] if up.get(c) == n) for n in set(up.values())}
    got = {r.node: r for r in network.longest(spark.createDataFrame(edges, "child int, parent int, length int")).collect()}
    assert {n: r.longest for n, r in got.items()} == want
    assert max(r.through for r in got.values()) == max(far(n, None) for n in near)
    assert all(r.leaf not in want for r in got.values())


def test_longest_paths_of_nothing(spark):
    assert network.longest(spark.createDataFrame([], "child int, parent int, length int")).collect() == []
    twice = spark.createDataFrame([(1, 0, 2), (1, 0, 2), (2, 0, 3)], "child int, parent int, length int")
    assert [tuple(r) for r in network.longest(twice, levels=5).collect()] == [(0, 3, 2, 5)]

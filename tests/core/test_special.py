"""Checks of special stretches, over hand-made networks: a main at y = 0, a chamber at (0, 0), a point at (0, 100)."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.core.test_districts import box, collection
from trellis.operators import zones
from trellis.plans import special
from trellis.sources import geojson

MAIN = [("src", "source", [180, 0], {}), ("old", "heat_network", [[-150, 0], [180, 0]], {"diameter": 300}), ("ch", "heat_chamber", [0, 0], {})]
POINT = ("p", "oks_connection_point", [0, 100], {"flow_tph": 20})
X, Y = 414000.0, 6173000.0
PRICE = 89748.0
SCHEMA = "district string, variant string, kind string, key string, start string, end string, line array<struct<x:double,y:double>>, flow double, diameter int, length double, laying string, k_special double, k_depth double, depth_start double, depth_end double, cost double, tie_in_pipe string"


def wall(name, kind, coords):
    return (name, "restriction", coords, {"restriction_type": kind})


def pipe(key, start, end, line, laying="base", k=1.0, depths=(None, None), dn=100):
    length = float(sum(np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(line, line[1:])))
    return {"kind": "pipe", "key": key, "start": start, "end": end, "line": [{"x": X + x, "y": Y + y} for x, y in line], "flow": 20.0, "diameter": dn, "length": length, "laying": laying, "k_special": k, "k_depth": 1.0, "depth_start": depths[0], "depth_end": depths[1], "cost": length * PRICE * k}


def straight(*cuts, **kinds):
    """One line from the chamber to the point, cut at ys; kinds by piece number: (laying, k)."""
    ys = [0, *cuts, 100]
    names = ["s:ch", *(f"t{i}" for i in range(len(cuts))), "s:p"]
    return [pipe(f"n{i}", names[i], names[i + 1], [(0, a), (0, b)], *kinds.get(f"p{i}", ("base", 1.0))) for i, (a, b) in enumerate(zip(ys, ys[1:]))]


def gas(y):
    return wall("gas", "gas_pipeline", [[-10, y], [10, y]])


CASES = {}
for kind in ("road", "tram_tracks", "gas_pipeline", "power_cable", "heat_network"):
    CASES[f"missing {kind}"] = ([wall("c", kind, [[-10, 50], [10, 50]])], straight(), True)
ROAD = wall("road", "road", [box(-10, 40, 10, 60)])
CASES |= {
    "road in its limits": ([ROAD], straight(37, 63, p1=("special", 1.6)), False),
    "road, limits within the crossing": ([ROAD], straight(45, 55, p1=("special", 1.6)), True),
    "road, limits too wide": ([ROAD], straight(30, 70, p1=("special", 1.6)), True),
    "road, wrong factor": ([ROAD], straight(37, 63, p1=("special", 1.5)), True),
    "gas joint": ([gas(50)], straight(48, 52, p1=("special", 1.25)), False),
    "special without a crossing": ([], straight(48, 52, p1=("special", 1.25)), True),
    "no crossing": ([wall("far", "road", [box(-300, 300, 300, 320)])], straight(), False),
    "beside a road": ([wall("side", "road", [box(1.0, 20, 8, 60)])], straight(), True),
    "far enough from a road": ([wall("side", "road", [box(2.0, 20, 8, 60)])], straight(), False),
    "flat angle": ([wall("tilted", "road", [[-30, 40], [30, 65]])], straight(49.5, 55.5, p1=("special", 1.6)), False),
    "too flat": ([wall("tilted", "road", [[-30, 10], [30, 90]])], straight(45, 55, p1=("special", 1.6)), True),
    "wholly inside a road": ([wall("big", "road", [box(-500, -500, 500, 500)])], straight(), True),
    "inside a road, special": ([wall("big", "road", [box(-500, -500, 500, 500)])], [pipe("n0", "s:ch", "s:p", [(0, 0), (0, 100)], "special", 1.6)], False),
    "two crossings in one piece": ([gas(40), wall("cable", "power_cable", [[-10, 60], [10, 60]])], [*straight(38, 62, p1=("special", 1.25))], True),
    "two crossings in two pieces": ([gas(40), wall("cable", "power_cable", [[-10, 60], [10, 60]])], straight(38, 42, 58, 62, p1=("special", 1.25), p3=("special", 1.15)), False),
    "overlapping zones, cut": ([gas(50), wall("cable", "power_cable", [[-10, 52], [10, 52]])], straight(48, 50, 52, 54, p1=("special", 1.25), p2=("special", 1.25), p3=("special", 1.15)), False),
    "overlapping zones, one piece": ([gas(50), wall("cable", "power_cable", [[-10, 52], [10, 52]])], straight(48, 54, p1=("special", 1.25)), True),
    "bent special": ([ROAD], [*straight(37, 63)[:1], pipe("n1", "t0", "t1", [(0, 37), (3, 50), (0, 63)], "special", 1.6), *straight(37, 63)[2:]], True),
}


#: A special stretch that ends at a new chamber on the main, inside a road: neither crosses the main nor needs a base piece there.
CHAMBER = {"kind": "chamber", "key": "c1", "line": [{"x": X, "y": Y}], "diameter": 300, "tie_in_pipe": "s:old"}
CASES["tie-in inside a road"] = ([wall("road", "road", [box(-10, -10, 10, 10)])], [CHAMBER, pipe("n0", "c1", "t0", [(0, 0), (0, 13)], "special", 1.6), pipe("n1", "t0", "s:p", [(0, 13), (0, 100)])], False)


def deep(depth, kind, coords=((-10, 50), (10, 50)), k=1.25, margin=2):
    line = straight(50 - margin, 50 + margin, p1=("special", k))
    return ([wall("c", kind, [list(c) for c in coords])], [r | {"depth_start": depth, "depth_end": depth} for r in line])


#: A pipe of DN 100 is 0.18 high. Gas lies at 2.8 to 3.2 with 0.2 of room, a cable at 2.7 to 2.9 with 0.5; under a road 1.0 is asked.
DEPTHS = {
    "over gas": (*deep(2.4, "gas_pipeline"), False),
    "just over gas": (*deep(2.42, "gas_pipeline"), False),
    "too near over gas": (*deep(2.43, "gas_pipeline"), True),
    "through gas": (*deep(3.0, "gas_pipeline"), True),
    "too near under gas": (*deep(3.39, "gas_pipeline"), True),
    "under gas": (*deep(3.4, "gas_pipeline"), False),
    "over a cable": (*deep(2.0, "power_cable", k=1.15), False),
    "too near a cable": (*deep(2.1, "power_cable", k=1.15), True),
    "under a road": (*deep(1.0, "road", k=1.6, margin=3), False),
    "too high under a road": (*deep(0.9, "road", k=1.6, margin=3), True),
}
#: The depth counts where the crossing is, not at the ends of the piece.
_, slope = deep(3.0, "gas_pipeline")
slope[1] |= {"depth_start": 3.0, "depth_end": 1.8}
DEPTHS["sloping over gas"] = ([gas(50)], slope, False)


def tables(spark, cases):
    files = spark.createDataFrame([(k, collection([*MAIN, POINT, *v[0]])) for k, v in cases.items()], "district string, text string")
    names = [c.split()[0] for c in SCHEMA.replace("array<struct<x:double,y:double>>", "a").split(", ")]
    rows = [dict.fromkeys(names) | {"district": k, "variant": "v"} | r for k, v in cases.items() for r in v[1]]
    cell = lambda v: [(p["x"], p["y"]) for p in v] if isinstance(v, list) else v
    return geojson.scan_text(files).cache(), spark.createDataFrame([tuple(cell(r[c]) for c in names) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def made(spark):
    return tables(spark, CASES)


def test_special_stretches(made):
    features, net = made
    found = special.special_checks(features, net, "PLAN_2D").where("failed AND severity = 'error'").collect()
    by = {}
    for r in found:
        by.setdefault(r.district, set()).add((r.rule, r.message))
    wrong = {k: by.get(k) for k, v in CASES.items() if v[2] != (k in by)}
    assert not wrong, wrong
    assert all(any(rule == "§4" for rule, _ in by[k]) for k, v in CASES.items() if v[2])
    assert ("§4", "angle of crossing too small: road") in by["too flat"]
    assert ("§4", "too near outside a special stretch: road") in by["beside a road"]
    assert ("§4", "a special stretch isn't straight") in by["bent special"]
    assert ("§4", "a node is needed where the set of crossed obstacles changes") in by["overlapping zones, one piece"]
    assert ("§4", "k_special") in by["road, wrong factor"]


def test_depths_at_crossings(spark):
    features, net = tables(spark, DEPTHS)
    found = special.special_checks(features, net, "DEPTH_3D").where("failed AND rule = '§5'")
    assert {r.district for r in found.collect()} == {k for k, v in DEPTHS.items() if v[2]}


def test_chains_of_special_pieces(spark):
    """A chain of pieces reaches as far as it may; another obstacle, a gap and a piece alone aren't chained; a cycle ends."""
    line = [("d", "v", f"p{i:02d}", f"a{i}", f"a{i + 1}") for i in range(40)]
    ring = [("r", "v", f"q{i}", f"b{i}", f"b{(i + 1) % 5}") for i in range(5)]
    pieces = spark.createDataFrame([*line, *ring, ("d", "v", "alone", "x", "y"), ("d", "v", "off", "z", "w")], "district string, variant string, key string, start string, end string")
    crossing = spark.createDataFrame([("d", "v", "p00", "gas"), ("d", "v", "p00", "road"), ("d", "v", "p01", "road"), ("r", "v", "q0", "gas"), ("d", "v", "alone", "gas")], "district string, variant string, key string, obstacle string")
    got = {(r.district, r.key, r.obstacle) for r in special.chained(pieces, crossing, hops=5).collect()}
    want = {("d", f"p{i:02d}", "gas") for i in range(1, 6)} | {("d", f"p{i:02d}", "road") for i in range(0, 7)} | {("r", f"q{i}", "gas") for i in range(1, 5)}
    assert got == want


def sampled(edge, u, distance):
    x1, y1, x2, y2 = edge
    t = np.clip(((u - x1) * (x2 - x1) - y1 * (y2 - y1)) / np.maximum((x2 - x1) ** 2 + (y2 - y1) ** 2, 1e-300), 0, 1)
    return np.hypot(x1 + t * (x2 - x1) - u, y1 + t * (y2 - y1)).min() <= distance


number = st.floats(-20, 20, allow_nan=False).map(lambda v: round(v, 2))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(number, number, number, number), min_size=1, max_size=6), st.floats(0.1, 6))
def test_near_equals_sampling(edges, distance):
    edge = tuple(np.array(c, float) for c in zip(*edges))
    got = zones.near(*edge, distance)
    for u in np.linspace(-30, 30, 241):
        if any(abs(u - e) < 1e-6 for i in got for e in i):
            continue
        assert any(a <= u <= b for a, b in got) == sampled(edge, u, distance)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(number, number), min_size=3, max_size=9))
def test_inside_equals_parity_of_points(ring):
    """Stretches inside a ring from the places where the axis passes it, told for a segment of 12 m with what lies before it."""
    p = np.array([*ring, ring[0]], float)
    (x1, y1), (x2, y2) = p[:-1].T, p[1:].T
    passed = (y1 > 0) != (y2 > 0)
    u = (x1 - y1 * (x2 - x1) / np.where(y2 == y1, 1, y2 - y1))[passed]
    got = zones.inside(sorted(u[(u >= -zones.BEYOND) & (u <= 12 + zones.BEYOND)]), bool((u < -zones.BEYOND).sum() % 2), 12.0)
    for v in np.linspace(-zones.BEYOND, 12 + zones.BEYOND, 77):
        if len(u) and np.abs(u - v).min() < 1e-9:
            continue
        assert any(a <= v <= b for a, b in got) == bool((u < v).sum() % 2)


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 10)), max_size=6), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 10)), max_size=6))
def test_without_equals_cells(pieces, holes):
    pieces, holes = zones.merged([(a, a + n) for a, n in pieces]), [(a, a + n) for a, n in holes]
    cells = lambda of: {i for a, b in of for i in range(a, b)}
    assert cells(zones.without(pieces, holes)) == cells(pieces) - cells(holes)


def test_local_keeps_what_lies_inside_large_areas(spark):
    """A pipe far from the boundary of an area that holds it is met with it; one outside its box, or in its hole, isn't inside."""
    ring = lambda *b: [[float(v) for v in p] for p in box(*b)]
    shapes = spark.createDataFrame([("d", "area", True, [ring(0, 0, 3000, 900), ring(1000, 200, 2000, 700)]), ("d", "far", True, [ring(9000, 9000, 9100, 9100)])], "district string, obstacle string, area boolean, rings array<array<array<double>>>")
    lines = [("in", 500.0, 400.0), ("hole", 1500.0, 400.0), ("edge", 995.0, 400.0), ("out", -900.0, 400.0)]
    pipes = spark.createDataFrame([("d", "v", k, [(x, y), (x + 10, y)]) for k, x, y in lines], "district string, variant string, key string, line array<struct<x:double,y:double>>")
    got = {r.key: r for r in zones.local(pipes, shapes).collect()}
    inner = {k: zones.clipped(zones.inside(r.passes, r.within, r.size), 0, r.size) for k, r in got.items()}
    assert inner == {"in": [(0, 10)], "hole": [], "edge": [(0, 5)]} and {r.obstacle for r in got.values()} == {"area"}


def test_forbidden_areas_far_from_their_edges(spark):
    """A piece deep inside a forbidden area is found, though no edge is near; a long diagonal area is met only where it runs."""
    from trellis.plans import validate

    diagonal = [[-2000, -1990], [2000, 2010], [2000, 2000], [-2000, -2000], [-2000, -1990]]
    features, net = tables(spark, {"inside": ([wall("big", "park", [box(-900, -900, 900, 900)])], straight(40, 60)), "beside": ([wall("long", "park", [diagonal])], straight(40, 60))})
    found = {(r.district, r.key, r.bad) for r in validate.near_obstacles(features, net.where("kind = 'pipe'")).collect()}
    assert {f for f in found if f[2]} == {("inside", "n0", True), ("inside", "n1", True), ("beside", "n0", True)}

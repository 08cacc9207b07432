import numpy as np
import pytest

from tests.core.test_districts import box
from trellis.operators import union

SCHEMA = "district string, obstacle string, rings array<array<array<double>>>"


def ring(points):
    return [[float(x), float(y)] for x, y in points]


CASES = {
    "one": [[box(0, 0, 10, 10)]],
    "apart": [[box(0, 0, 4, 4)], [box(6, 0, 9, 4)]],
    "overlap": [[box(0, 0, 10, 10)], [box(5, 5, 15, 15)]],
    "touching sides": [[box(0, 0, 10, 10)], [box(10, 0, 20, 10)]],
    "part of a side": [[box(0, 0, 10, 10)], [box(10, 3, 20, 7)]],
    "corner only": [[box(0, 0, 10, 10)], [box(10, 10, 20, 20)]],
    "inside": [[box(0, 0, 10, 10)], [box(3, 3, 6, 6)]],
    "same twice": [[box(0, 0, 10, 10)], [box(0, 0, 10, 10)[::-1]]],
    "hole": [[box(0, 0, 12, 12), box(4, 4, 8, 8)]],
    "hole filled": [[box(0, 0, 12, 12), box(4, 4, 8, 8)], [box(4, 4, 8, 8)]],
    "hole half filled": [[box(0, 0, 12, 12), box(4, 4, 8, 8)], [box(3, 3, 6, 9)]],
    "ring of four makes a hole": [[box(0, 0, 12, 3)], [box(0, 9, 12, 12)], [box(0, 0, 3, 12)], [box(9, 0, 12, 12)]],
    "cross": [[box(0, 4, 12, 8)], [box(4, 0, 8, 12)]],
    "triangles": [[[(0, 0), (12, 0), (0, 12), (0, 0)]], [[(12, 12), (0, 12), (12, 0), (12, 12)]]],
    "star": [[[(0, 0), (12, 2), (1, 9), (0, 0)]], [[(2, 11), (6, 0), (11, 10), (2, 11)]]],
}


def raster(areas, n=480, size=24.0):
    """Area of the union from cell centres, by parity."""
    c = (np.arange(n) + 0.5) * size / n - 1
    x, y = np.meshgrid(c, c)
    filled = np.zeros_like(x, bool)
    for rings in areas:
        odd = np.zeros_like(x, bool)
        for r in rings:
            p = np.array(r, float)
            for (x1, y1), (x2, y2) in zip(p, p[1:]):
                if y1 != y2:
                    odd ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
        filled |= odd
    return filled.sum() * (size / n) ** 2


def unions(spark, cases):
    rows = [(k, f"{k}-{i}", [ring(r) for r in rings]) for k, v in cases.items() for i, rings in enumerate(v)]
    return union.boundary(spark.createDataFrame(rows, SCHEMA)).cache()


def test_area_equals_raster(spark):
    rng = np.random.default_rng(3)
    cases = dict(CASES)
    for i in range(25):
        made = []
        for _ in range(rng.integers(2, 6)):
            if rng.random() < 0.5:  # whole numbers, so sides and corners often touch
                x, y = rng.integers(0, 14, 2)
                made.append([box(x, y, x + rng.integers(1, 8), y + rng.integers(1, 8))])
            else:
                turn = np.sort(rng.random(rng.integers(3, 8))) * 2 * np.pi
                points = [(10 + 9 * rng.random() * np.cos(t), 10 + 9 * rng.random() * np.sin(t)) for t in turn]
                made.append([[*points, points[0]]])
        cases[f"random {i}"] = made
    pieces = unions(spark, cases)
    got = {r.district: r.area for r in union.area(pieces).collect()}
    assert set(got) == set(cases)
    for k, v in cases.items():
        assert got[k] == pytest.approx(raster(v), abs=1.5), k
    exact = {"one": 100, "apart": 28, "overlap": 175, "touching sides": 200, "part of a side": 140, "corner only": 200, "inside": 100, "same twice": 100, "hole": 128, "hole filled": 144, "ring of four makes a hole": 108, "cross": 80, "triangles": 144}
    assert all(got[k] == pytest.approx(a, abs=1e-6) for k, a in exact.items())
    length = {}
    for r in pieces.collect():
        length[r.district] = length.get(r.district, 0) + np.hypot(r.b.x - r.a.x, r.b.y - r.a.y)
    assert length["touching sides"] == pytest.approx(60) and length["part of a side"] == pytest.approx(60) and length["same twice"] == pytest.approx(40) and length["hole filled"] == pytest.approx(48)


def test_empty_and_null_rings(spark):
    areas = spark.createDataFrame([("d", "a", None), ("d", "b", []), ("e", "c", [ring(box(0, 0, 2, 2))])], SCHEMA)
    assert {r.district for r in union.boundary(areas).collect()} == {"e"}
    assert union.boundary(areas.where("district = 'none'")).count() == 0

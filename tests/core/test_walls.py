"""The last stretch to a point in a building; networks as in test_special."""

import pytest
from pyspark.sql import functions as F

from tests.core.test_districts import box, collection
from tests.core.test_special import MAIN, SCHEMA, pipe, wall
from trellis.plans import walls
from trellis.plans.special import obstacles
from trellis.sources import geojson


def point(x, y):
    return ("p", "oks_connection_point", [x, y], {"flow_tph": 20})


HOUSE = wall("house", "oks", [box(-20, 90, 20, 110)])
STRAIGHT = [(0, 0), (0, 104)]
#: obstacles, point, line, outcome (None: fine).
CASES = {
    "nearest wall": ([HOUSE], (0, 97), [(0, 0), (0, 97)], None),
    "farther wall": ([HOUSE], (0, 104), STRAIGHT, "error"),
    "nearest blocked": ([HOUSE, wall("park", "park", [box(-25, 110, 25, 125)])], (0, 104), STRAIGHT, "warning"),
    "blocked farther off": ([HOUSE, wall("park", "park", [box(-25, 118, 25, 125)])], (0, 104), STRAIGHT, "error"),
    "an area that holds the point doesn't block": ([HOUSE, wall("school", "school", [box(-50, 50, 50, 150)])], (0, 104), STRAIGHT, "error"),
    "equally near walls": ([HOUSE], (0, 100), [(0, 0), (0, 100)], None),
    "out of the complex": ([HOUSE, wall("annex", "oks", [box(-20, 100, 20, 130)])], (0, 104), STRAIGHT, None),
    "inner wall of a complex": ([HOUSE, wall("annex", "oks", [box(-20, 80, 20, 107)])], (0, 104), [(60, 0), (60, 104), (0, 104)], "error"),
    "whole stretch inside": ([HOUSE], (0, 104), [(0, 95), (0, 104)], None),
    "no building": ([wall("school", "school", [box(-50, 50, 50, 150)])], (0, 104), STRAIGHT, "none"),
    "courtyard": ([wall("yard", "oks", [box(-40, 80, 40, 160), box(-20, 100, 20, 140)[::-1]])], (0, 97), [(0, 0), (0, 97)], "error"),
    "small courtyard": ([wall("yard", "oks", [box(-40, 80, 40, 160), box(-3, 100, 3, 104)[::-1]])], (0, 97), [(0, 0), (0, 97)], "warning"),
}


def tables(spark, cases):
    files = spark.createDataFrame([(k, collection([*MAIN, point(*at), *walls_])) for k, (walls_, at, *_) in cases.items()], "district string, text string")
    names = [c.split()[0] for c in SCHEMA.replace("array<struct<x:double,y:double>>", "a").split(", ")]
    cell = lambda v: [(p["x"], p["y"]) for p in v] if isinstance(v, list) else v
    rows = [tuple(cell((dict.fromkeys(names) | {"district": k, "variant": "v"} | pipe("n", "s:ch", "s:p", line))[c]) for c in names) for k, (_, _, line, _) in cases.items()]
    return geojson.scan_text(files).cache(), spark.createDataFrame(rows, SCHEMA).cache()


def test_last_stretches(spark):
    features, net = tables(spark, CASES)
    held = []
    found = {r.district: (r.failed, r.severity) for r in walls.wall_checks(features, net, held=held).collect()}
    got = {k: found[k][1] if k in found and found[k][0] else None if k in found else "none" for k in CASES}
    assert got == {k: v[3] for k, v in CASES.items()}
    reasoned = net.withColumn("approach", F.lit("no route"))
    told = {r.district: (r.severity, r.message) for r in walls.wall_checks(features, reasoned).where("failed").collect()}
    assert told["farther wall"] == ("warning", "not through the nearest wall: no route") and all(s == "warning" for s, _ in told.values())
    assert len(held) > 3


@pytest.mark.parametrize("turned", [False, True])
def test_areas_that_belong_to_a_building(spark, turned):
    """Overlap by more than a square metre, or a building against its wall."""
    others = {
        "overlaps": wall("o", "park", [box(15, 95, 40, 105)]),
        "overlaps a little": wall("o", "park", [box(19.99, 95, 40, 105)]),
        "inside it": wall("o", "social_area", [box(-3, 92, 3, 95)]),
        "around it": wall("o", "social_area", [box(-60, 60, 60, 160)]),
        "against it": wall("o", "oks", [box(20.3, 95, 40, 105)]),
        "near it": wall("o", "oks", [box(21, 95, 40, 105)]),
        "park against it": wall("o", "park", [box(20.3, 95, 40, 105)]),
        "far": wall("o", "oks", [box(300, 95, 340, 105)]),
    }
    cases = {k: ([o, HOUSE] if turned else [HOUSE, o], (0, 104), STRAIGHT, None) for k, o in others.items()}
    features, _ = tables(spark, cases)
    areas = obstacles(features).where("area AND NOT is_special").cache()
    got = {r.district for r in walls.belonging(walls.holders(features, areas), areas).collect() if r.obstacle == "s:o"}
    assert got == {"overlaps", "inside it", "around it", "against it"}

"""The last stretch of a pipe to its point: out of a building through the nearest wall of all buildings that hold the point.

Buildings that hold a point are one complex, and its walls are the boundary of their union. What may be crossed on the last stretch
besides is told by pairs of areas: one that holds the point, overlaps a building that holds it, or stands against that building.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import tables as T
from trellis.operators import shared, spatial, union, zones
from trellis.operators.zones import EPS, KEY
from trellis.plans.special import obstacles

#: How much farther than the nearest a wall may be, overlap in square metres and gap in metres of areas that belong together.
NEAREST, OVERLAP, AGAINST = 0.05, 1.0, 0.5


def holders(features: DataFrame, areas: DataFrame) -> DataFrame:
    """(district, point, x, y, obstacle, kind) of each connection point and each of areas that holds it."""
    xy = F.from_json("coords", "array<double>")
    points = features.where("message IS NULL AND object_type = 'oks_connection_point'").select("district", F.col("id_key").alias("point"), xy[0].alias("x"), xy[1].alias("y")).dropDuplicates(["district", "point"])
    by = ["district", "point", "x", "y", "obstacle"]
    told = zones.parity(zones.containing(points, areas), zones.edges(areas), "x", "y", *by).where("inside")
    return told.join(areas.select("district", "obstacle", "kind"), ["district", "obstacle"]).select(*by, "kind")


def belonging(inside: DataFrame, areas: DataFrame, held: list | None = None) -> DataFrame:
    """(district, point, obstacle) of areas that overlap a building holding the point by more than OVERLAP, or are buildings against its walls.

    inside: holders(). The overlap of two areas is what their union lacks of their sum; only areas that are near each other are paired.
    held: the tables that were written for it, until the caller lets go of them.
    """
    building = shared.written(inside.where("kind = 'oks'").select("district", F.col("obstacle").alias("building")).distinct(), "buildings", held)
    cut = spatial.tiled(zones.edges(areas), zones.TILE, AGAINST)
    own = cut.withColumnRenamed("obstacle", "building").join(building, ["district", "building"], "left_semi")
    met = own.select("district", "building", "tx", "ty", F.struct("a", "b").alias("l")).join(cut.select("district", "obstacle", "tx", "ty", F.struct("a", "b").alias("r")), ["district", "tx", "ty"]).where("building <> obstacle")
    gap = F.least(*[_distance(f"{p}.{e}", q) for p, q in (("l", "r"), ("r", "l")) for e in "ab"])
    near = met.groupBy("district", "building", "obstacle").agg(F.min(gap).alias("gap")).where(f"gap <= {AGAINST}")
    inner = zones.containing(zones.edges(areas).groupBy("district", "obstacle").agg(F.min("a").alias("p")).select("district", F.col("obstacle").alias("other"), F.col("p.x").alias("x"), F.col("p.y").alias("y")), areas).where("obstacle <> other")
    boxed = inner.select("district", F.col("obstacle").alias("building"), F.col("other").alias("obstacle")).unionByName(inner.select("district", F.col("other").alias("building"), "obstacle")).join(building, ["district", "building"], "left_semi")
    pairs = near.select("district", "building", "obstacle", "gap").unionByName(boxed.withColumn("gap", F.lit(None).cast("double"))).groupBy("district", "building", "obstacle").agg(F.min("gap").alias("gap"))
    pairs = shared.written(pairs, "near-buildings", held)
    group = F.concat_ws("\0", "district", "building", "obstacle")
    rings = areas.select("district", "obstacle", "rings", "kind")
    both = pairs.select("*", group.alias("g")).select("district", "building", F.col("obstacle").alias("other"), "gap", "g", F.explode(F.array("building", "obstacle")).alias("obstacle")).join(rings, ["district", "obstacle"])
    both = shared.written(both, "pairs-of-areas", held)
    alone = both.select(F.concat_ws("\0", "district", "obstacle").alias("district"), "obstacle", "rings").dropDuplicates(["district"])
    sizes = shared.written(union.area(shared.written(union.boundary(alone.unionByName(both.select(F.col("g").alias("district"), "obstacle", "rings"))), "walls-of-areas", held)), "sizes", held)
    single, whole = sizes.withColumnRenamed("area", "own"), sizes.withColumnRenamed("area", "whole")
    sums = both.select("g", "district", "building", "other", "gap", "obstacle", "kind").join(single.withColumnRenamed("district", "_o"), F.concat_ws("\0", "district", "obstacle") == F.col("_o"))
    sums = sums.groupBy("g", "district", "building", "other", "gap").agg(F.sum("own").alias("own"), F.max(F.when(F.col("obstacle") == F.col("other"), F.col("kind"))).alias("kind")).join(whole.withColumnRenamed("district", "g"), "g")
    found = sums.where((F.col("own") - F.col("whole") > OVERLAP) | ((F.col("kind") == "oks") & (F.col("gap") <= AGAINST))).select("district", "building", F.col("other").alias("obstacle"))
    return inside.where("kind = 'oks'").select("district", "point", F.col("obstacle").alias("building")).join(found, ["district", "building"]).select("district", "point", "obstacle").distinct()


def spared(features: DataFrame, profile: str = "heat", held: list | None = None) -> DataFrame:
    """(district, point, obstacle) of forbidden areas that the last stretch to a point may enter: they hold it, or belong to its building."""
    areas = shared.written(obstacles(features, profile).where("area AND NOT is_special"), "areas", held)
    inside = shared.written(holders(features, areas), "holders", held)
    return shared.written(inside.select("district", "point", "obstacle").unionByName(belonging(inside, areas, held)).distinct(), "spared", held)


def _distance(p: str, segment: str):
    """Distance of a point from a segment, both structs."""
    x, y, ax, ay, bx, by = (F.col(c) for c in (f"{p}.x", f"{p}.y", f"{segment}.a.x", f"{segment}.a.y", f"{segment}.b.x", f"{segment}.b.y"))
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    return F.hypot(ax + t * dx - x, ay + t * dy - y)


def _nearest_place(x: str, y: str):
    """(distance, place) of the point of piece a-b that is nearest to (x, y)."""
    px, py, ax, ay, dx, dy = F.col(x), F.col(y), F.col("a.x"), F.col("a.y"), F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    qx, qy = ax + t * dx, ay + t * dy
    return F.struct(F.hypot(qx - px, qy - py).alias("d"), qx.alias("x"), qy.alias("y"))


def wall_checks(features: DataFrame, net: DataFrame, profile: str = "heat", held: list | None = None) -> DataFrame:
    """Findings on last stretches that leave a building elsewhere than through its nearest wall.

    A warning where the way out through the nearest wall is blocked, or where the pipe gives its reason (approach); an error otherwise.
    held: the tables that were written for it, until the caller lets go of them.
    """
    shapes = shared.written(obstacles(features, profile).where("area AND NOT is_special"), "areas", held)
    inside = shared.written(holders(features, shapes), "holders", held)
    own = inside.where("kind = 'oks'")
    group = F.concat_ws("\0", "district", "point").alias("g")
    members = own.select("district", "obstacle", group).join(shapes.select("district", "obstacle", "rings"), ["district", "obstacle"])
    walls = shared.written(union.boundary(members.select(F.col("g").alias("district"), "obstacle", "rings")).withColumnRenamed("district", "g"), "walls", held)
    points = own.select("district", "point", "x", "y", group).distinct()
    near = walls.join(points, "g").groupBy("g", "district", "point", "x", "y").agg(F.min(_nearest_place("x", "y")).alias("near"))

    reason = F.col("approach") if "approach" in net.columns else F.lit(None).cast("string")
    line = F.col("line")
    pipes = net.where("kind = 'pipe'").select(*KEY, "key", "diameter", reason.alias("approach"), F.inline(F.array(F.struct(F.col("end").alias("point"), F.element_at(line, -2).alias("q")), F.struct(F.col("start").alias("point"), line[1].alias("q")))))
    last = pipes.join(near, ["district", "point"])
    # Where the last segment passes a wall, and how far from the point.
    c = F.col
    rx, ry, sx, sy = c("q.x") - c("x"), c("q.y") - c("y"), c("b.x") - c("a.x"), c("b.y") - c("a.y")
    wx, wy, cross = c("a.x") - c("x"), c("a.y") - c("y"), rx * sy - ry * sx
    t, u = (wx * sy - wy * sx) / F.nullif(cross, F.lit(0.0)), (wx * ry - wy * rx) / F.nullif(cross, F.lit(0.0))
    at = F.when(t.between(-1e-9, 1 + 1e-9) & u.between(-1e-6, 1 + 1e-6), t * F.hypot(rx, ry))
    out = [*KEY, "key", "g", "point", "x", "y", "near", "q", "approach", "diameter"]
    told = last.join(walls, "g").groupBy(*out).agg(F.max(F.abs(at - c("near.d"))).alias("off"))
    told = shared.written(told.withColumn("wrong", F.coalesce(c("off") > NEAREST, F.lit(False))), "last-stretches", held)
    wrong = told.where("wrong")

    # The straight way out through the nearest wall, as far as the clearance goes.
    need = T.clearance(F.lit("oks"), "diameter", F.lit(5.0)) + F.coalesce(T.diameter_value("diameter", "width"), F.lit(0.0)) / 2
    dx, dy, d = c("near.x") - c("x"), c("near.y") - c("y"), F.nullif(c("near.d"), F.lit(0.0))
    ways = wrong.where(f"near.d > {EPS}").select(*KEY, "key", "point", "diameter", F.array(F.struct(c("near.x").alias("x"), c("near.y").alias("y")), F.struct((c("near.x") + dx * (need + EPS) / d).alias("x"), (c("near.y") + dy * (need + EPS) / d).alias("y"))).alias("line"))
    ways = shared.written(ways.withColumn("key", F.concat_ws("\0", "key", "point")), "ways-out", held)
    beyond = ways.select("district", "point", "key", "variant", c("line")[1]["x"].alias("px"), c("line")[1]["y"].alias("py")).join(own.select("district", "point", "obstacle"), ["district", "point"])
    back = zones.parity(beyond, zones.edges(shapes), "px", "py", *KEY, "key", "obstacle").where("inside").select(*KEY, "key")
    met = zones.local(ways.select(*KEY, "key", "line"), shapes).join(ways.select(*KEY, "key", "point", "diameter"), [*KEY, "key"]).join(inside.select("district", "point", "obstacle"), ["district", "point", "obstacle"], "left_anti")
    met = met.join(shapes.select("district", "obstacle", "kind", "base", "own_half"), ["district", "obstacle"])
    met = met.select(*KEY, "key", "size", "within", "passes", "x1", "y1", "x2", "y2", (T.clearance("kind", "diameter", "base") + F.coalesce(T.diameter_value("diameter", "width"), F.lit(0.0)) / 2 + c("own_half") - EPS).alias("need"))

    def blocked(batches):
        for pdf in batches:
            bad = []
            for r in pdf.itertuples(index=False):
                edge = tuple(np.asarray(x, float) for x in (r.x1, r.y1, r.x2, r.y2))
                bad.append(bool(zones.clipped(zones.near(*edge, r.need) + zones.inside(list(r.passes), bool(r.within), r.size), 0.0, r.size)))
            yield pdf[bad][[*KEY, "key"]]

    shut = met.mapInPandas(blocked, "district string, variant string, key string").unionByName(back).select(*KEY, F.split("key", "\0")[0].alias("key"), F.split("key", "\0")[1].alias("point"), F.lit(True).alias("shut")).distinct()
    told = told.join(shut, [*KEY, "key", "point"], "left")
    why = F.when(c("shut"), "the way out through it is blocked").otherwise(c("approach"))
    text = F.concat(F.lit("not through the nearest wall"), F.coalesce(F.concat(F.lit(": "), why), F.lit("")))
    return told.select(*KEY, c("key").alias("object_id"), F.lit("§2.2").alias("rule"), F.when(c("wrong") & why.isNotNull(), "warning").otherwise("error").alias("severity"), c("wrong").alias("failed"), text.alias("message"))

"""Union of areas by group, as the pieces of their edges that bound it.

Edges of a group are cut where they meet others of the group (met by tiles); a piece bounds the union if exactly one of its sides is inside
some area. So holes, overlaps, equal contours and touching sides need no cases of their own, and a group is never gathered: cuts, sides and
pieces are joins and partial aggregates over edges. Two unions of one group merge by taking their pieces' areas again as members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import spatial, zones

#: How far beside a piece its two sides are looked at, and how near two cuts are one.
SIDE, SAME = 1e-4, 1e-7
TILE = 50.0


def boundary(areas: DataFrame) -> DataFrame:
    """(district, a, b): the pieces that bound the union of areas(district, obstacle, rings) of each district, the union on their left.

    district is the group; rings are closed, shells and holes in any order and direction. An area repeated, or one inside another, adds nothing;
    sides where two areas touch are no boundary. Null or empty rings have no edges.
    """
    members = areas.withColumn("area", F.lit(True))
    cut = zones.edges(members).where("a <> b").withColumn("e", F.xxhash64("district", "obstacle", "a", "b"))
    # Cuts: places on an edge where another edge of the group meets it, or ends beside it.
    tiles = spatial.tiled(cut, TILE, 1e-3)
    names = ["e", "a", "b"]
    left, right = (tiles.select("district", "tx", "ty", F.struct(*names).alias(n)) for n in "lr")
    met = left.join(right, ["district", "tx", "ty"]).where("l.e <> r.e").select("district", "l", "r").distinct()
    c = F.col
    rx, ry, sx, sy = c("l.b.x") - c("l.a.x"), c("l.b.y") - c("l.a.y"), c("r.b.x") - c("r.a.x"), c("r.b.y") - c("r.a.y")
    wx, wy = c("r.a.x") - c("l.a.x"), c("r.a.y") - c("l.a.y")
    cross, n2, m2 = rx * sy - ry * sx, rx * rx + ry * ry, sx * sx + sy * sy
    slack = 1e-6
    level = F.abs(cross) <= 1e-9 * F.sqrt(n2 * m2)
    t, u = (wx * sy - wy * sx) / F.nullif(cross, F.lit(0.0)), (wx * ry - wy * rx) / F.nullif(cross, F.lit(0.0))
    crossing = F.when(~level & u.between(-slack, 1 + slack), t)
    beside = lambda x, y: F.when(level & (F.abs(x * ry - y * rx) <= 1e-3 * F.sqrt(n2)), (x * rx + y * ry) / n2)
    shares = F.filter(F.array(crossing, beside(wx, wy), beside(c("r.b.x") - c("l.a.x"), c("r.b.y") - c("l.a.y"))), lambda v: v.isNotNull() & (v > SAME) & (v < 1 - SAME))
    cuts = met.select("district", c("l.e").alias("e"), F.explode(shares).alias("t")).groupBy("district", "e").agg(F.array_sort(F.collect_set(F.round("t", 9))).alias("t"))
    whole = cut.join(cuts, ["district", "e"], "left").select("district", "obstacle", "e", "a", "b", F.concat(F.array(F.lit(0.0)), F.coalesce("t", F.array().cast("array<double>")), F.array(F.lit(1.0))).alias("t"))
    at = lambda s: F.struct((c("a.x") + (c("b.x") - c("a.x")) * s).alias("x"), (c("a.y") + (c("b.y") - c("a.y")) * s).alias("y"))
    steps = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(at(F.get("t", i - 1)).alias("a"), at(F.get("t", i)).alias("b")))
    pieces = whole.select("district", F.inline(steps))
    # One piece for all edges that run along each other, whatever their direction.
    near = lambda p: F.struct(F.round(c(f"{p}.x"), 5).alias("x"), F.round(c(f"{p}.y"), 5).alias("y"))
    ends = F.array_sort(F.array(near("a"), near("b")))
    pieces = pieces.withColumn("id", F.xxhash64("district", ends)).groupBy("district", "id").agg(F.first(F.struct("a", "b")).alias("p")).select("district", "id", "p.a", "p.b")
    pieces = pieces.withColumn("n", F.hypot(c("b.x") - c("a.x"), c("b.y") - c("a.y"))).where(f"n > {SAME}")
    ox, oy = (c("b.y") - c("a.y")) / c("n") * SIDE, (c("a.x") - c("b.x")) / c("n") * SIDE
    mx, my = (c("a.x") + c("b.x")) / 2, (c("a.y") + c("b.y")) / 2
    sides = pieces.select("district", "id", F.inline(F.array(F.struct(F.lit("right").alias("side"), (mx + ox).alias("x"), (my + oy).alias("y")), F.struct(F.lit("left").alias("side"), (mx - ox).alias("x"), (my - oy).alias("y")))))
    asked = zones.containing(sides, members)
    told = zones.parity(asked, cut.select("district", "obstacle", "a", "b"), "x", "y", "district", "id", "side", "obstacle")
    inner = told.where("inside").groupBy("district", "id").agg(F.bool_or(c("side") == "left").alias("left"), F.bool_or(c("side") == "right").alias("right")).where("left <> right")
    return pieces.join(inner, ["district", "id"]).select("district", F.when(c("left"), c("a")).otherwise(c("b")).alias("a"), F.when(c("left"), c("b")).otherwise(c("a")).alias("b"))


def area(pieces: DataFrame) -> DataFrame:
    """(district, area) inside the pieces of boundary(), by the sum over their oriented ends, about the first corner of each group."""
    origin = pieces.groupBy("district").agg(F.min("a").alias("o"))
    x = lambda p: F.col(f"{p}.x") - F.col("o.x")
    y = lambda p: F.col(f"{p}.y") - F.col("o.y")
    return pieces.join(origin, "district").groupBy("district").agg((F.sum(x("a") * y("b") - x("b") * y("a")) / 2).alias("area"))

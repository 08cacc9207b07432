"""Where lines run inside, across and near shapes: intervals along each segment of a line, for all pairs that can matter.

A shape is its rings (areas) or chains (lines). Pairs of a segment and a shape come from tile keys: tiles along the shape's
edges for what is near its boundary, and tiles of the size of the shape for what may lie inside it. For each pair one join with the
shape's edges, aggregated at once, leaves the edges near the segment in the segment's own frame (x along it, y across) and the places where
the segment's line passes the boundary; so no task holds a whole shape, and the kernel sees a few numbers whatever the shape's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators import spatial

KEY = ["district", "variant"]
#: Side of the tiles; how far an edge can matter to a segment; how far a segment is looked at beyond its ends.
TILE, REACH, BEYOND = 50.0, 16.0, 4.0
EPS = 0.02
_TINY = 1e-9
#: Side of the smallest tiles for containment; each level is four times as wide.
_LOWEST = 64.0


def rings(geometry_type: Column | str, coords: Column | str) -> Column:
    """All rings or chains of a geometry as array<array<array<double>>>."""
    kind = F.col(geometry_type) if isinstance(geometry_type, str) else geometry_type
    chains = lambda depth: F.from_json(coords, "array<" * depth + "double" + ">" * depth)
    return F.when(kind.isin("Polygon", "MultiLineString"), chains(3)).when(kind == "MultiPolygon", F.flatten(chains(4))).when(kind == "LineString", F.array(chains(2)))


def edges(shapes: DataFrame, *more: str) -> DataFrame:
    """The edges a-b of shapes(district, obstacle, rings), with more columns."""
    xy = lambda ring: F.transform(ring, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    chains = shapes.select("district", "obstacle", *more, F.explode("rings").alias("_r")).select("district", "obstacle", *more, xy(F.col("_r")).alias("_l"))
    return spatial.segments(chains, "_l", "district", "obstacle", *more).drop("n")


def boxes(shapes: DataFrame) -> DataFrame:
    """district, obstacle, the box of each area and its level, by which the box lies in four tiles at most."""
    points = F.flatten("rings")
    side = lambda f, i: f(F.transform(points, lambda p: p[i]))
    box = shapes.where("area").select("district", "obstacle", side(F.array_min, 0).alias("x1"), side(F.array_max, 0).alias("x2"), side(F.array_min, 1).alias("y1"), side(F.array_max, 1).alias("y2"))
    extent = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(_LOWEST))
    return box.withColumn("level", F.ceil(F.log2(extent / _LOWEST) / 2).cast("int"))


def containing(points: DataFrame, shapes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points(district, ...) with each obstacle whose box holds them: an equi-join on tiles as wide as the box."""
    box = boxes(shapes)
    levels = sorted(r[0] for r in box.select("level").distinct().collect())  # a few numbers: extents grow fourfold
    if not levels:
        return points.select("*", F.lit(None).cast("string").alias("obstacle")).where("false")
    side = F.lit(_LOWEST) * F.pow(F.lit(4.0), F.col("level"))
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}1") / side), F.floor(F.col(f"{c}2") / side)))
    dealt = box.select("*", span("x").alias("_tx")).select("*", span("y").alias("_ty"))
    asked = points.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level")).select("*", F.floor(F.col(x) / side).alias("_tx"), F.floor(F.col(y) / side).alias("_ty"))
    met = asked.join(dealt, ["district", "level", "_tx", "_ty"]).where(F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2")))
    return met.select(*points.columns, "obstacle")


def parity(pairs: DataFrame, cut: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """pairs' columns ``by`` with inside: whether the point is inside the obstacle, by the number of edges that a ray to the right passes."""
    x1, y1, x2, y2 = (F.col(c) for c in ("a.x", "a.y", "b.x", "b.y"))
    px, py = F.col(x), F.col(y)
    passed = ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)))
    return pairs.join(cut, ["district", "obstacle"]).groupBy(*by).agg((F.count_if(F.coalesce(passed, F.lit(False))) % 2 == 1).alias("inside"))


def local(lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """(KEY, key, n, obstacle) of each segment n of lines(KEY, key, line) and each shape that is near it or may hold it, with what the kernel needs.

    size: length of the segment; before: times that the segment's line passes the boundary more than BEYOND before it; passes: where it
    does from there to BEYOND behind it; x1, y1, x2, y2: the edges within REACH, in the segment's frame.
    """
    cut = spatial.segments(lines, "line", *KEY, "key").withColumn("size", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))).where(F.col("size") > EPS)
    own, at = edges(shapes, "area"), [*KEY, "key", "n"]
    near = spatial.tiled(cut.select(*at, "a", "b"), TILE, 0.0).join(spatial.tiled(own.drop("area"), TILE, REACH).select("district", "obstacle", "tx", "ty").distinct(), ["district", "tx", "ty"]).select(*at, "obstacle")
    held = containing(cut.select(*at, F.col("a.x").alias("x"), F.col("a.y").alias("y")), shapes).select(*at, "obstacle")
    pairs = near.unionByName(held).distinct().join(cut.select(*at, F.col("a").alias("p"), F.col("b").alias("q"), "size"), at).join(own, ["district", "obstacle"])
    ux, uy = (F.col(f"q.{c}") - F.col(f"p.{c}") for c in "xy")
    ux, uy = ux / F.col("size"), uy / F.col("size")
    frame = {}
    for end, i in (("a", 1), ("b", 2)):
        dx, dy = F.col(f"{end}.x") - F.col("p.x"), F.col(f"{end}.y") - F.col("p.y")
        frame |= {f"x{i}": dx * ux + dy * uy, f"y{i}": dy * ux - dx * uy}
    told = pairs.withColumns(frame).select(*at, "obstacle", "area", "size", *frame)
    passes = F.when((F.col("y1") > 0) != (F.col("y2") > 0), F.col("x1") - F.col("y1") * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))
    close = (F.least("x1", "x2") <= F.col("size") + REACH) & (F.greatest("x1", "x2") >= -REACH) & (F.least("y1", "y2") <= REACH) & (F.greatest("y1", "y2") >= -REACH)
    told = told.withColumn("u", passes)
    grouped = told.groupBy(*at, "obstacle", "area", "size").agg(
        F.count_if(F.col("u") < -BEYOND).alias("before"),
        F.collect_list(F.when(F.col("u").between(-BEYOND, F.col("size") + BEYOND), F.col("u"))).alias("passes"),
        F.collect_list(F.when(close, F.struct("x1", "y1", "x2", "y2"))).alias("e"),
    )
    return grouped.select(*at, "obstacle", "area", "size", (F.col("before") % 2 == 1).alias("within"), "passes", *[F.col(f"e.{c}").alias(c) for c in frame])


def merged(pieces: list[tuple[float, float]], gap: float = _TINY) -> list[tuple[float, float]]:
    """Intervals in order, those that touch made one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(pieces):
        if out and lo <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def inside(passes, within: bool, size: float) -> list[tuple[float, float]]:
    """Where a segment extended by BEYOND is inside an area, from the places where it passes the boundary."""
    cuts = [-BEYOND, *sorted(passes), size + BEYOND]
    return [(a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if (i % 2 == 1) != within]


def touched(x1, y1, x2, y2) -> list[tuple[float, float]]:
    """Where the x axis meets edges of a line: points, and stretches where they run along it."""
    out = []
    flat = (np.abs(y1) <= _TINY) & (np.abs(y2) <= _TINY)
    out += [(float(a), float(b)) for a, b in zip(np.minimum(x1, x2)[flat], np.maximum(x1, x2)[flat])]
    hit = ~flat & (np.minimum(y1, y2) <= _TINY) & (np.maximum(y1, y2) >= -_TINY)
    u = x1[hit] - y1[hit] * (x2[hit] - x1[hit]) / (y2[hit] - y1[hit])
    return merged(out + [(float(v), float(v)) for v in u], 1e-6)


def near(x1, y1, x2, y2, distance: float) -> list[tuple[float, float]]:
    """Where the x axis is within a distance of edges: for each edge the hull of its strip and the discs at its ends."""
    low, high = np.full(len(x1), np.inf), np.full(len(x1), -np.inf)
    for x, y in ((x1, y1), (x2, y2)):
        half = np.sqrt(np.maximum(distance**2 - y**2, -1.0), where=np.abs(y) <= distance, out=np.full(len(x), -np.inf))
        low, high = np.where(half >= 0, np.minimum(low, x - half), low), np.where(half >= 0, np.maximum(high, x + half), high)
    dx, dy = x2 - x1, y2 - y1
    length = np.hypot(dx, dy)
    ok = length > _TINY
    ex, ey = np.divide(dx, length, where=ok, out=np.zeros_like(dx)), np.divide(dy, length, where=ok, out=np.zeros_like(dy))
    lo, hi = np.full(len(x1), -np.inf), np.full(len(x1), np.inf)
    # Along the edge: 0 <= (u - x1) ex - y1 ey <= length; across it: |(u - x1) ey + y1 ex| <= distance.
    for slope, base, least, most in ((ex, -x1 * ex - y1 * ey, np.zeros_like(length), length), (ey, -x1 * ey + y1 * ex, np.full_like(length, -distance), np.full_like(length, distance))):
        level = np.abs(slope) <= 1e-12
        safe = np.where(level, 1.0, slope)
        a, b = (least - base) / safe, (most - base) / safe
        fits = (base >= least) & (base <= most)
        lo = np.where(level, np.where(fits, lo, np.inf), np.maximum(lo, np.minimum(a, b)))
        hi = np.where(level, np.where(fits, hi, -np.inf), np.minimum(hi, np.maximum(a, b)))
    strip = ok & (lo <= hi)
    low, high = np.where(strip, np.minimum(low, lo), low), np.where(strip, np.maximum(high, hi), high)
    return merged([(float(a), float(b)) for a, b in zip(low, high) if a <= b])


def clipped(pieces: list[tuple[float, float]], low: float, high: float) -> list[tuple[float, float]]:
    return [(max(a, low), min(b, high)) for a, b in pieces if b >= low and a <= high]


def without(pieces: list[tuple[float, float]], holes: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Intervals less the holes."""
    out, holes = [], merged(holes)
    for lo, hi in pieces:
        for a, b in holes:
            if b <= lo or a >= hi:
                continue
            if a > lo:
                out.append((lo, a))
            lo = max(lo, b)
        if lo < hi:
            out.append((lo, hi))
    return out


def least_angle(u: float, x1, y1, x2, y2) -> float | None:
    """The smallest angle (degrees, 0 to 90) between the x axis and the edges at its place u; None where there is no edge."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = np.clip(np.divide((u - x1) * dx - y1 * dy, n, where=n > 0, out=np.zeros_like(n)), 0, 1)
    here = (np.hypot(x1 + t * dx - u, y1 + t * dy) <= EPS) & (n > 0)
    return float(np.degrees(np.arctan2(np.abs(dy[here]), np.abs(dx[here]))).min()) if here.any() else None

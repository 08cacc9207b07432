"""Spatial joins: tile keys turn distance and crossing predicates into equi-joins that Spark can partition."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points in one row of a tile at most; rows of one task, and points of one part of a tile, where they are spread evenly.
CELL, TASK, PART = 256, 50_000, 4096


def tile(c: Column | str, size: float) -> Column:
    """Tile number of a coordinate."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def along(ax: Column, ay: Column, bx: Column, by: Column, size: float, margin: float = 0.0) -> Column:
    """Tiles (tx, ty) within margin of a segment, from the boxes of its pieces of one tile side, so they grow with its length alone."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(bx - ax, by - ay) / size))

    def box(a: Column, b: Column, i: Column) -> Column:
        p, q = a + (b - a) * i / n, a + (b - a) * (i + 1) / n
        return F.sequence(tile(F.least(p, q) - margin, size), tile(F.greatest(p, q) + margin, size))

    tiles = lambda i: F.flatten(F.transform(box(ax, bx, i), lambda x: F.transform(box(ay, by, i), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), tiles)))


def segments(df: DataFrame, line: str, *cols: str) -> DataFrame:
    """Rows of df once for each segment of an array of points: its number n (from 1), its ends a and b as struct<x,y>."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(i.alias("n"), F.get(line, i - 1).alias("a"), F.get(line, i).alias("b")))
    return df.where(F.size(line) > 1).select(*cols, F.inline(pairs))


def tiled(cut: DataFrame, size: float, margin: float) -> DataFrame:
    """Segments a-b once for each tile within margin of them."""
    return cut.select("*", F.inline(along(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"), size, margin)))


def around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Rows once for each of the nine tiles around their own, as tx and ty."""
    near = F.array(*[F.struct((tile(x, size) + i).alias("tx"), (tile(y, size) + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.select("*", F.inline(near))


def distance2(x1, y1, x2, y2) -> Column:
    """Squared distance."""
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return dx * dx + dy * dy


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left(lid, lx, ly) and right(rid, rx, ry) at most radius apart, with d2. Only the tiles around are met."""
    tiled = right.withColumns({"tx": tile("rx", radius), "ty": tile("ry", radius)})
    return around(left, "lx", "ly", radius).join(tiled, ["tx", "ty"]).withColumn("d2", distance2("lx", "ly", "rx", "ry")).where(F.col("d2") <= radius * radius).drop("tx", "ty")


def cells(right: DataFrame, keys: list[str]) -> DataFrame:
    """Points rid, rx, ry by the keys, as an array in rows of at most CELL points."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("rid"))
    return right.withColumn("cell", F.floor((n - 1) / CELL)).groupBy(*keys, "cell").agg(F.collect_list(F.struct("rid", "rx", "ry")).alias("points"))


def nearest(left: DataFrame, right: DataFrame, size: float | None = None, self_join: bool = False, growth: int = 8) -> DataFrame:
    """For each row of left(lid, lx, ly) the nearest of right(rid, rx, ry): lid, rid, d2; ties go to the smallest rid.

    The search window widens: what lies within one tile side is final (anything nearer would be in the nine tiles),
    the rest looks again in tiles ``growth`` times as wide, until the tiles span the data. The first side (unless
    given) holds about four rows of right if they are spread evenly. One lazy plan of few levels.

    A row meets the points of a tile as an array, so pairs are never rows to be sorted. In the first level the smaller side is
    repeated for the tiles around, later what is left over; wide tiles are dealt in parts. The number of
    tasks follows from the counts of rows, so what one of them holds doesn't grow with the input.
    """
    left, right = left.where("lx IS NOT NULL AND ly IS NOT NULL"), right.where("rx IS NOT NULL AND ry IS NOT NULL")
    box = [df.agg(F.min(f"{s}x"), F.max(f"{s}x"), F.min(f"{s}y"), F.max(f"{s}y"), F.count("*")).first() for df, s in ((left, "l"), (right, "r"))]
    if not all(b[4] for b in box):
        return left.select("lid", F.lit(None).cast("bigint").alias("rid"), F.lit(None).cast("double").alias("d2")).where("false")
    extent = max(max(b[i + 1] for b in box) - min(b[i] for b in box) for i in (0, 2))
    size = size or max(2 * extent / max(1.0, box[1][4]) ** 0.5, 1e-9)
    n_left, n_right = box[0][4], box[1][4]
    keys, row = ["tx", "ty", "part"], ["lid", "lx", "ly"]
    points = F.filter("points", lambda p: p["rid"] != F.col("lid")) if self_join else F.col("points")
    d2 = lambda p: (F.col("lx") - p["rx"]) * (F.col("lx") - p["rx"]) + (F.col("ly") - p["ry"]) * (F.col("ly") - p["ry"])
    best = F.array_min(F.transform(points, lambda p: F.struct(d2(p).alias("d2"), p["rid"].alias("rid")))).alias("b")
    own = lambda df, s: df.withColumns({"tx": tile(f"{s}x", size), "ty": tile(f"{s}y", size)})
    found, rest, turned = [], left.select(*row), n_right <= n_left
    while True:
        last = size > extent
        parts = ceil(n_right / max(1.0, extent / size) ** 2 / PART)
        tasks = ceil(max(n_left * (1 if turned else 9), n_right * (9 if turned else 1)) / TASK)
        there = (around(right, "rx", "ry", size) if turned else own(right, "r")).withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)))
        here = (own(rest, "l") if turned else around(rest, "lx", "ly", size)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        met = here.repartition(tasks, *keys).join(cells(there.repartition(tasks, *keys), keys), keys, "left").select(*keys, *row, best)
        if turned and parts == 1:
            met = met.groupBy(*keys, *row)
        else:
            met = met.repartition(tasks, "lid").groupBy(*row)
        met = met.agg(F.min("b").alias("b"))
        near = F.col("b").isNotNull() & (F.lit(last) | (F.col("b.d2") <= size * size))
        found.append(met.where(near).select("lid", "b"))
        if last:
            return reduce(DataFrame.unionByName, found).repartition(ceil(n_left / TASK), "lid").groupBy("lid").agg(F.min("b").alias("b")).select("lid", "b.rid", "b.d2")
        rest = met.where(~F.coalesce(near, F.lit(False))).select(*row)
        size *= growth
        turned = False


def crossings(segments: DataFrame, size: float) -> DataFrame:
    """Pairs a < b of segments(id, x1, y1, x2, y2) that cross properly. Segments meet in the tiles of their boxes."""
    boxed = segments.select(
        "*",
        F.explode(F.sequence(tile(F.least("x1", "x2"), size), tile(F.greatest("x1", "x2"), size))).alias("tx"),
    ).select("*", F.explode(F.sequence(tile(F.least("y1", "y2"), size), tile(F.greatest("y1", "y2"), size))).alias("ty"))
    a = boxed.select("tx", "ty", *[F.col(c).alias(f"a_{c}") for c in segments.columns])
    b = boxed.select("tx", "ty", *[F.col(c).alias(f"b_{c}") for c in segments.columns])
    side = lambda p, q, r: F.signum((F.col(f"{q}x") - F.col(f"{p}x")) * (F.col(f"{r}y") - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col(f"{r}x") - F.col(f"{p}x")))
    pairs = a.join(b, ["tx", "ty"]).where("a_id < b_id").withColumns({f"{s}{n}{c}": F.col(f"{s}_{c}{n}") for s in "ab" for n in "12" for c in "xy"})
    proper = (side("a1", "a2", "b1") * side("a1", "a2", "b2") < 0) & (side("b1", "b2", "a1") * side("b1", "b2", "a2") < 0)
    return pairs.where(proper).select("a_id", "b_id").distinct()


def bounds(df: DataFrame, x: str, y: str, margin: float) -> tuple[float, float, float, float] | None:
    """Box of the points, widened by margin: one row, so predicates on it are literals that reach the scan."""
    r = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return None if r[0] is None else (r[0] - margin, r[1] + margin, r[2] - margin, r[3] + margin)


def crop(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside the box."""
    return df.where(F.col(x).between(box[0], box[1]) & F.col(y).between(box[2], box[3]))

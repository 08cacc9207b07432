"""Measures of networks and paths: route metrics, overlap of variants, orientation, cuts with a least piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators import network


def turns(line: str) -> Column:
    """Turn in degrees at every inner vertex of array<struct<x,y>>."""
    p = lambda i: F.get(F.col(line), i)
    step = lambda i: (p(i + 1)["x"] - p(i)["x"], p(i + 1)["y"] - p(i)["y"])

    def turn(i):
        (ux, uy), (vx, vy) = step(i - 1), step(i)
        return F.degrees(F.atan2(F.abs(ux * vy - uy * vx), ux * vx + uy * vy))

    return F.when(F.size(line) > 2, F.transform(F.sequence(F.lit(1), F.size(line) - 2), turn)).otherwise(F.array().cast("array<double>"))


def route_metrics(net: DataFrame) -> DataFrame:
    """Per variant: turns (all, near 45 and near 90 degrees), segments, mean and least segment, specials, chambers and tie-ins, longest path and where it leads.

    The loop over levels of the longest path ends at the leaves; routes have a few dozen levels at most.
    """
    pipes = net.where("kind = 'pipe'").select("district", "variant", "laying", turns("line").alias("t"), F.size("line").alias("n"), "length")
    p = pipes.groupBy("district", "variant").agg(
        F.sum(F.size("t")).alias("turns"),
        F.sum(F.size(F.filter("t", lambda a: F.abs(a - 45) <= 5))).alias("turns_45"),
        F.sum(F.size(F.filter("t", lambda a: F.abs(a - 90) <= 5))).alias("turns_90"),
        F.sum(F.col("n") - 1).alias("segments"),
        (F.sum("length") / F.sum(F.col("n") - 1)).alias("mean_segment"),
        F.min("length").alias("least_piece"),
        F.count_if(F.col("laying") == "special").alias("specials"),
    )
    c = net.groupBy("district", "variant").agg(F.count_if((F.col("kind") == "chamber") & F.col("tie_in_pipe").isNotNull()).alias("new_tie_ins"), F.count_if((F.col("kind") == "chamber") & F.col("tie_in_pipe").isNull()).alias("branches"), F.count_if(F.col("kind") == "existing_tie_in").alias("existing_tie_ins"))
    node = lambda n: F.struct("district", "variant", F.col(n).alias("key"))
    down = network.longest(net.where("kind = 'pipe'").select(node("end").alias("child"), node("start").alias("parent"), "length"))
    best = down.groupBy("node.district", "node.variant").agg(F.max(F.struct(F.round("longest", 2).alias("longest"), F.col("leaf.key").alias("leaf"))).alias("b")).select("district", "variant", F.col("b.longest").alias("longest_path"), F.col("b.leaf").alias("longest_path_to"))
    return c.join(p, ["district", "variant"], "left").join(best, ["district", "variant"], "left")


def overlaps(net: DataFrame, step: float = 5.0) -> DataFrame:
    """district, a, b and overlap: share of variant a's route (sampled every ``step`` m) that runs where b's does.

    Samples become tiles, tiles distinct per variant, and variants meet on equal tiles: an equi-join.
    """
    seg = net.where("kind = 'pipe'").select("district", "variant", F.explode(F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(F.get("line", i - 1).alias("a"), F.get("line", i).alias("b")))).alias("s"))
    n = F.ceil(F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")) / step).cast("int")
    at = seg.select("district", "variant", "s", n.alias("n")).where("n > 0").select("district", "variant", "s", F.explode(F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: i / F.col("n"))).alias("t"))
    mix = lambda c: F.floor((F.col(f"s.a.{c}") + (F.col(f"s.b.{c}") - F.col(f"s.a.{c}")) * F.col("t")) / step)
    tiles = at.select("district", "variant", mix("x").alias("tx"), mix("y").alias("ty")).distinct()
    size = tiles.groupBy("district", "variant").agg(F.count("*").alias("size"))
    a, b = tiles.withColumnRenamed("variant", "a"), tiles.withColumnRenamed("variant", "b")
    shared = a.join(b, ["district", "tx", "ty"]).where("a <> b").groupBy("district", "a", "b").agg(F.count("*").alias("shared"))
    return shared.join(size.withColumnRenamed("variant", "a"), ["district", "a"]).select("district", "a", "b", (F.col("shared") / F.col("size")).alias("overlap"))


def orientation(segments: DataFrame, key: str) -> DataFrame:
    """Dominant direction modulo 90 degrees of segments(key, x1, y1, x2, y2), weighted by length: a circular mean of four times the angle."""
    a = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")) * 4
    w = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    mean = F.degrees(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))) / 4
    return segments.groupBy(key).agg(F.pmod(mean, F.lit(90.0)).alias("orientation"), F.sum(w).alias("length"))


def kept_cuts(cuts: Column | str, least: float) -> Column:
    """Sorted cuts with those dropped that lie closer than ``least`` behind the last one kept: a fold, as each choice rests on the one before."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(cuts), start, lambda kept, c: F.when((F.size(kept) == 0) | (c - F.element_at(kept, -1) >= least), F.concat(kept, F.array(c))).otherwise(kept))


def hints(net: DataFrame) -> DataFrame:
    """Largest diameter at the end that each point hangs on, for a second build."""
    return net.where("kind = 'pipe'").groupBy("district", "variant", "end").agg(F.max("diameter").alias("diameter"))


def largest_root(net: DataFrame) -> DataFrame:
    """The node that feeds the most flow, per variant."""
    p = net.where("kind = 'pipe'")
    down = p.select("district", "variant", F.col("end").alias("start")).distinct()
    tops = p.join(down, ["district", "variant", "start"], "left_anti")
    return tops.groupBy("district", "variant", "start").agg(F.sum("flow").alias("flow")).groupBy("district", "variant").agg(F.max_by("start", "flow").alias("root"), F.max("flow").alias("flow"))

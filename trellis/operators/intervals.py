"""Interval operators as sweeps over sorted boundaries: no interval meets another in a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stabbed(intervals: DataFrame, key: str, point: str) -> DataFrame:
    """intervals(key, id, lo, hi, point) with covering: how many intervals of the same key hold the point, ends included."""
    # At equal places starts come first, then points, then ends.
    edge = lambda at, order, step: F.struct(F.col(at).alias("at"), F.lit(order).alias("order"), F.lit(step).alias("step"))
    swept = intervals.select(key, "id", F.inline(F.array(edge("lo", 0, 1), edge(point, 1, 0), edge("hi", 2, -1))))
    w = Window.partitionBy(key).orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    return swept.withColumn("covering", F.sum("step").over(w)).where("order = 1").select(key, "id", "covering")


def gaps(intervals: DataFrame, key: str) -> DataFrame:
    """Stretches between a key's intervals that none of them covers: key, gap_from, gap_to."""
    w = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("_reach", F.max("hi").over(w)).where("lo > _reach").select(key, F.col("_reach").alias("gap_from"), F.col("lo").alias("gap_to"))


def merged(intervals: DataFrame, key: str) -> DataFrame:
    """Unions of touching or overlapping intervals: key, lo, hi."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = intervals.withColumn("_new", F.when(F.col("lo") <= reach, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")

"""Choosing among variants: Pareto front, deduplication by signature, ranking, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pareto(df: DataFrame, x: str, y: str, buckets: int = 256) -> DataFrame:
    """Rows that no other row equals or beats in both x and y and beats in one (smaller is better).

    Rows are dealt into ranges of x; the least y of the ranges before is a table of that many rows, and the rest is
    a running minimum inside each range: no pairs of rows, and no sort of the whole table in one task.
    """
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df
    width = (high - low) / buckets or 1
    ranged = df.withColumn("_r", F.least(F.floor((F.col(x) - low) / width), F.lit(buckets - 1)))
    least = ranged.groupBy("_r").agg(F.min(y).alias("_m"))
    before = least.select("_r", F.min("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy("_r").orderBy(x)
    inside = ranged.join(F.broadcast(before), "_r").withColumns({
        "_less": F.min(y).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "_prior": F.min(F.struct(F.col(y).alias("y"), F.col(x).alias("x"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    # Least y so far must be the row's own, first reached at this x.
    keep = (F.col("_before").isNull() | (F.col("_before") > F.col(y))) & (F.col("_less") == F.col(y)) & (F.col("_prior.x") == F.col(x))
    return inside.where(keep).select(*df.columns)


def best_of(df: DataFrame, signature: list[Column], order: list[str]) -> DataFrame:
    """One row for each signature, the first in the given order: a partial aggregation instead of a sorted window."""
    rest = [c for c in df.columns if c not in order]
    return df.groupBy(*signature).agg(F.min(F.struct(*order, *rest)).alias("_b")).select("_b.*").select(*df.columns)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered in order; for the handful of variants of a run."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rank_faults(df: DataFrame, group: str, rank: str, score: str) -> DataFrame:
    """Rows whose rank isn't their place in the group, or whose score is lower than that of the rank before."""
    w = Window.partitionBy(group).orderBy(rank)
    checked = df.withColumns({"_n": F.row_number().over(w), "_s": F.lag(score).over(w)})
    return checked.where((F.col("_n") != F.col(rank)) | (F.col("_s") > F.col(score))).select(*df.columns)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered table, pages counted from 0, sizes from 1 to 100."""
    size = max(1, min(100, size))
    return df.orderBy(*order).offset(number * size).limit(size)

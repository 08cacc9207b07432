"""Operators over rooted networks: accumulation, paths, runs, components and node measures.

A network is a DataFrame edges(child, parent); flow gathers from the leaves to the roots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators import shared


def accumulate(edges: DataFrame, values: DataFrame, agg: str = "sum", levels: int | None = None) -> DataFrame:
    """node and value over its whole subtree (itself included), from values(node, value).

    Each level is a join on the parent and a partial aggregation, so the rows shrink toward the root. levels fixes the
    depth (one lazy plan); without it the loop ends when no value has a parent left.
    """
    step = {"sum": F.sum, "max": F.max, "min": F.min}[agg]
    front, parts, n = values.groupBy("node").agg(step("value").alias("value")), [], 0
    while True:
        parts.append(front)
        if levels is not None and n >= levels:
            break
        up = front.join(edges, front["node"] == edges["child"]).groupBy("parent").agg(step("value").alias("value")).select(F.col("parent").alias("node"), "value")
        if levels is None and up.limit(1).count() == 0:
            break
        front, n = up, n + 1
    return reduce(DataFrame.unionByName, parts).groupBy("node").agg(step("value").alias("value"))


def ancestors(edges: DataFrame, levels: int) -> DataFrame:
    """child, ancestor and hops for every pair up to that many levels apart."""
    base = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("hops"))
    up = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("_next"))
    parts = [base]
    for n in range(2, levels + 1):
        parts.append(parts[-1].join(up, "ancestor").select("child", F.col("_next").alias("ancestor"), F.lit(n).alias("hops")))
    return reduce(DataFrame.unionByName, parts)


def roots(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """node and root of every node, by pointer jumping: each round doubles the reach (2 ** rounds levels).

    A node on a cycle, or deeper than that, keeps a root that has a parent of its own.
    """
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    point = nodes.join(edges, nodes["node"] == edges["child"], "left").select("node", F.coalesce("parent", "node").alias("root"))
    for _ in range(rounds):
        step = point.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        point = point.join(step, "root").select("node", F.col("_up").alias("root"))
    return point


def forest(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """Per root: its nodes and edges, and whether they form a tree (one edge fewer than nodes)."""
    home = roots(edges, rounds)
    degree = edges.groupBy("child").count().select(F.col("child").alias("node"), F.col("count").alias("up"))
    return home.join(degree, "node", "left").groupBy("root").agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("up"), F.lit(0)).alias("n_edges")).withColumn("is_tree", F.col("n_edges") == F.col("n_nodes") - 1)


def longest(edges: DataFrame, levels: int | None = None, held: list | None = None) -> DataFrame:
    """node, longest, leaf and through of every inner node, from edges(child, parent, length).

    longest leads down to leaf (at ties the largest), through joins the two longest branches, so the largest through of a tree is
    its longest simple path. Each level moves one row an edge at most; lengths of chains of equal hops are combined before they
    move on. levels bounds the depth (one lazy plan); without it each level is written to the shared folder (noted in held)
    and the loop ends when nothing is left to hand on, so edges must not form a cycle then. Repeated edges count once, at
    their longest.
    """
    e = edges.groupBy("child", "parent").agg(F.max("length").alias("length"))
    e = e if levels is not None else shared.written(e, "edges", held)
    front = e.join(e.select(F.col("parent").alias("child")).distinct(), "child", "left_anti").select(F.col("child").alias("node"), F.lit(0).cast(e.schema["length"].dataType).alias("d"), F.col("child").alias("leaf"))
    branches, n = [], 0
    while levels is None or n < levels:
        step = front.join(e, front["node"] == e["child"]).select(F.col("parent").alias("node"), F.col("child").alias("via"), (F.col("d") + F.col("length")).cast(e.schema["length"].dataType).alias("d"), "leaf")
        if levels is None:
            step = shared.written(step, "branches", held)
            if step.isEmpty():
                break
        branches.append(step)
        front = step.groupBy("node").agg(F.max(F.struct("d", "leaf")).alias("b")).select("node", "b.*")
        n += 1
    if not branches:
        return front.where("false").select("node", F.col("d").alias("longest"), "leaf", F.col("d").alias("through"))
    each = reduce(DataFrame.unionByName, branches).groupBy("node", "via").agg(F.max(F.struct("d", "leaf")).alias("b"))
    first = each.groupBy("node").agg(F.max(F.struct("b", "via")).alias("f")).select("node", "f.b", F.col("f.via").alias("_via"))
    second = each.select("node", "via", F.col("b.d").alias("_d")).join(first.select("node", "_via"), "node").where("via <> _via").groupBy("node").agg(F.max("_d").alias("_d"))
    return first.join(second, "node", "left").select("node", F.col("b.d").alias("longest"), F.col("b.leaf").alias("leaf"), (F.col("b.d") + F.coalesce("_d", F.lit(0))).cast(e.schema["length"].dataType).alias("through"))


def runs(df: DataFrame, path: str, order: list[str], value: str) -> DataFrame:
    """Rows with the number of their run: consecutive rows of equal value along a path."""
    w = Window.partitionBy(path).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def run_lengths(df: DataFrame, path: str, order: list[str], value: str, length: Column) -> DataFrame:
    """One row for each run: path, run, value, pieces and total length."""
    return runs(df, path, order, value).groupBy(path, "run", value).agg(F.count("*").alias("pieces"), F.sum(length).alias("run_length"))


def ends(edges: DataFrame, carried: list[str]) -> DataFrame:
    """Both ends of every edge as node, with carried columns: one pass over the edges, no union of two scans."""
    return edges.select(F.explode(F.array("child", "parent")).alias("node"), *carried)


def degrees(edges: DataFrame) -> DataFrame:
    """Incident edges of every node."""
    return ends(edges, []).groupBy("node").agg(F.count("*").alias("degree"))


def incident_max(edges: DataFrame, value: str) -> DataFrame:
    """Largest value of the edges at every node."""
    return ends(edges, [value]).groupBy("node").agg(F.max(value).alias("largest"))

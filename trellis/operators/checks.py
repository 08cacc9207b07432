"""Checks as rows: every rule yields findings, and a report counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(df: DataFrame, object_id: Column | str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """object_id, rule, severity and failed for each row and rule: {rule: (severity, condition that must hold)}."""
    each = [F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), (~F.coalesce(ok, F.lit(False))).alias("failed")) for n, (s, ok) in rules.items()]
    return df.select((F.col(object_id) if isinstance(object_id, str) else object_id).alias("object_id"), F.inline(F.array(*each)))


def summary(found: DataFrame) -> DataFrame:
    """Per rule: checks, errors and warnings."""
    bad = F.col("failed").cast("int")
    return found.groupBy("rule").agg(
        F.count("*").alias("checks"),
        F.sum(F.when(F.col("severity") == "error", bad).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("severity") == "warning", bad).otherwise(0)).alias("warnings"),
    )


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys found more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")

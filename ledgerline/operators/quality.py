"""Validation rules as a table joined with unpivoted metrics, and tolerance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, metric, value: one row per metric."""
    return df.unpivot([key], metrics, "metric", "value")


def range_findings(df: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """Rows of (key, metric, value) outside their rule's (low, high); ``skip_zero`` spares zeros. Rules are a small fixed table."""
    j = df.join(F.broadcast(rules), "metric").where("value is not null and not (skip_zero and value = 0)")
    side = F.when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above")
    return j.withColumn("finding", side).where("finding is not null").select(key, "metric", "value", "finding")


def agree(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two sources agree within a share of the second; null without both."""
    return F.when(b != 0, F.abs(a / b - 1) <= tolerance)


def agreed(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """The value of a key where all its rows agree within the tolerance, else null: keys, value, n."""
    return df.groupBy(*keys).agg(F.when(F.max(value) - F.min(value) <= tolerance, F.min(value)).alias(value), F.count(value).alias("n"))


def coverage_gate(fresh: DataFrame, stored: DataFrame, key: str, least: float = 0.9) -> Column:
    """A scalar: whether a fresh snapshot covers enough of the stored one's keys to replace it. Both are aggregated first."""
    a = fresh.select(key).distinct().count()
    b = stored.select(key).distinct().count()
    return F.lit(b == 0 or a >= least * b)

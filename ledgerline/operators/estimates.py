"""Analyst estimates: one unit per metric, consensus, beats and misses. Tables have (ticker, period, firm, metric, value, unit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units as multiples of the canonical one (millions for money).
SCALES = {"$M": 1.0, "$B": 1000.0, "$K": 0.001, "$": 0.000001, "%": 1.0, "bps": 0.01, "x": 1.0}


def canonical(value: Column, unit: Column) -> Column:
    """The value in the canonical unit; null for an unknown one."""
    out = F.lit(None).cast("double")
    for u, scale in SCALES.items():
        out = F.when(unit == u, value * scale).otherwise(out)
    return out


def consensus(df: DataFrame) -> DataFrame:
    """ticker, period, metric: mean, low, high, n over firms, each firm's last row by ``firm`` counted once as its mean."""
    v = df.withColumn("_v", canonical(F.col("value"), F.col("unit"))).where("_v is not null")
    firm = v.groupBy("ticker", "period", "metric", "firm").agg(F.avg("_v").alias("_v"))
    return firm.groupBy("ticker", "period", "metric").agg(F.avg("_v").alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n"))


def surprise(actual: Column, estimate: Column) -> Column:
    """(actual - estimate) / |estimate| in percent."""
    return F.when(estimate != 0, (actual - estimate) / F.abs(estimate) * 100)


def outcome(actual: Column, estimate: Column, lower_better: Column, within: float = 1.0) -> Column:
    """beat, miss or inline (within a percent), in the metric's direction."""
    s = F.when(lower_better, -surprise(actual, estimate)).otherwise(surprise(actual, estimate))
    return F.when(F.abs(s) <= within, "inline").when(s > 0, "beat").when(s < 0, "miss")

"""A declarative metric registry compiled to one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import annualised, number


@dataclass(frozen=True)
class Metric:
    """``source``: column or expression; thousands: scale by 1000; ytd: annualise by the quarter; higher is better, worse or neither."""

    key: str
    source: str
    thousands: bool = False
    ytd: bool = False
    better: str = "higher"


def compiled(metric: Metric, quarter: Column) -> Column:
    value = number(F.expr(metric.source))
    if metric.ytd:
        value = annualised(value, quarter)
    return (value * 1000.0 if metric.thousands else value).alias(metric.key)


def project(df: DataFrame, metrics: list[Metric], keys: list[str], quarter: Column) -> DataFrame:
    """All metrics in one select, so that the scan reads only their sources."""
    return df.select(*keys, *(compiled(m, quarter) for m in metrics))

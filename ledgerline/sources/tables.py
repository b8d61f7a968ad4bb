"""Loaders of the Parquet tables in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

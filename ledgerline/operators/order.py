"""Places of rows in one order over a whole table, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.workspace import folder


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row, from 1, by an order without ties.

    Rows are dealt by ranges of the order and written, so that a lost task finds the same
    ranges again; a row's place is its place in the range after the counts of all ranges before.
    """
    path = folder(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    counts = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.join(F.broadcast(counts), "_range").select(*df.columns, (F.col("_before") + own).alias(name))

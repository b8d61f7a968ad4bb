"""The event store as a stream: read, deduplicate within a watermark, count, land.

Event times without zone are cast, since watermarks need timestamps. The watermark must
cover the longest look-back of any source, or late rows that a batch would keep are lost.
State is bounded by it; sinks are files with a checkpoint in the shared folder, so a
restarted stream goes on exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.workspace import folder


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, or at a pattern that also matches a single file."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], horizon: str = "5 days") -> DataFrame:
    """The first row of each key within the horizon."""
    return stream.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


def hourly(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and sums by hour and event type, given out once the watermark has passed."""
    hour = F.window("ts", "1 hour")
    return stream.withWatermark("ts", late).groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("hour"), "event_type", "n", "value")


def landed(stream: DataFrame, spark: SparkSession, once: bool = True) -> DataFrame:
    """Appends a stream to Parquet files, all that is available now, and reads them."""
    out = folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=once).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def collected(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """An aggregate's last state: each batch replaces the changed keys' rows, the newest batch wins on reading."""
    out = folder(spark, "updates")
    keys = [c for c in stream.columns if c not in ("n", "value")]

    def land(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).foreachBatch(land).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
    return newest.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))

"""The stream of stories tells what the batch tells, also over a restart."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import events
from ledgerline.sources.sinks import Table
from ledgerline.streaming.stories import land, stories

SCHEMA = "event_id long, ticker string, source string, ts timestamp"


def test_shuffled_arrivals_and_a_restart(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, rng.choice("AB") + str(rng.randrange(6)), rng.choice(["wire", "site", "sec_8k"]), rng.randrange(60 * 24)) for k in range(240)]
    df = spark.createDataFrame(rows, "event_id long, ticker string, source string, h int").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600 + 1_700_000_000)).drop("h")
    arrivals, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    table = Table(spark, f"file://{tmp_path}/table")
    order = ["wire", "site"]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(arrivals)
        land(stories(stream, ["ticker"], order, eligible=order, late="400 days"), table, ["ticker"], progress)

    def arrive(part):
        part.coalesce(1).write.mode("append").parquet(arrivals)

    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    arrive(df.where(third == 0))
    arrive(df.where(third == 1))
    run()
    arrive(df.where(third == 2))
    arrive(spark.createDataFrame([(-1, "close", "close", None)], SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + 900 * 86400))))
    run()  # a new query on the old progress
    got = sorted((r.ticker, r.event_id, r.copies) for r in table.read().where("event_id >= 0").collect())
    wanted = events.deduplicated(df, ["ticker"], order, eligible=order)
    assert got == sorted((r.ticker, r.event_id, r.copies) for r in wanted.collect())
    before = table.version()
    run()  # nothing new
    assert table.version() == before


def test_keys_share_states(spark, tmp_path, monkeypatch):
    """A state for each key took a call of Python a key and batch."""
    monkeypatch.setattr("ledgerline.streaming.stories.BUCKETS", 8, raising=False)
    df = spark.range(600).select(F.col("id").alias("event_id"), F.when(F.col("id") % 150 > 0, F.concat(F.lit('T "'), F.col("id") % 150)).alias("ticker"), F.lit("wire").alias("source"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    told, states = [], []
    stream = stories(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["ticker"], ["wire"], eligible=["wire"], late="1 minute")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).foreachBatch(lambda b, n: told.extend(b.collect())).start()
    query.awaitTermination()
    states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert 0 < max(states) <= 8
    last = {r.ticker: (r.event_id, r.copies) for r in sorted(told, key=lambda r: r.copies)}
    assert len(last) == 150 and last[None] == (0, 4) and last['T "7'] == (7, 4)

"""The event store as a stream with state: one row a story, upgraded in place by a better source.

Arrivals come in any order, but stories are told in the order of event times. Each key holds
back what the watermark hasn't reached, and its bucket (keys dealt by hash to BUCKETS states) a timer
at the earliest of it; once the watermark is there, it goes on where the key's story stands: a copy within the days counts,
a copy from a better source takes the stored row's place, a later event is a new story.
A story that nothing can join any longer leaves the state. Changed rows are merged into a
versioned table batch by batch; they carry the count of copies, so a batch that is played
again after a restart changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.operators.events import rank
from ledgerline.sources.sinks import Table

DAY = 86_400_000_000
#: Groups of keys that share a state: a call of Python for each key costs far more than its events.
BUCKETS = 4096


def stories(stream: DataFrame, keys: list[str], order: list[str], days: int = 5, eligible: list[str] | None = None, late: str = "1 day") -> DataFrame:
    """Changes of stories as they are told: keys, story (its first event), event_id (the stored row), at, copies.

    ``stream``: event_id (a number), source, ts and the keys. Rules are those of
    ``operators.events.deduplicated``: events of sources that aren't ``eligible`` are each a
    story. Events later than ``late`` behind the newest are dropped, and events without time
    don't enter: a watermark can't place them. What is told last waits until the watermark,
    which other events move, has passed it.
    """
    own = F.lit("") if eligible is None else F.when(F.col("source").isin(eligible), "").otherwise(F.concat_ws("/", F.coalesce("source", F.lit("")), "event_id"))
    rows = stream.where("ts is not null").select(*keys, own.alias("_own"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), rank(F.col("source"), order).alias("_rank"))
    kinds = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "_own"])
    rows = rows.select(F.pmod(F.xxhash64(*keys, "_own"), F.lit(BUCKETS)).cast("int").alias("_bucket"), F.to_json(F.struct(*keys, "_own")).alias("_key"), "event_id", "ts", "_rank")

    def one(stored: dict | None, waiting: list, reached: int) -> tuple[dict | None, list, dict]:
        """What a key has stored and what it holds back once the watermark is at ``reached``, and the stories that changed."""
        changed = {}
        waiting.sort()
        told = [x for x in waiting if x[0] <= reached]
        for at, event, place in told:
            if stored is None or at > stored["at"] + days * DAY:
                stored = {"story": event, "event": event, "at": at, "rank": place, "copies": 1}
            else:
                stored["copies"] += 1
                if place < stored["rank"]:
                    stored |= {"event": event, "at": at, "rank": place}
            changed[stored["story"]] = dict(stored)
        waiting = waiting[len(told) :]
        if stored and not waiting and stored["at"] + days * DAY < reached:
            stored = None  # nothing on time can join it
        return stored, waiting, changed

    def tell(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        for b in () if state.hasTimedOut else batches:
            at = pd.to_datetime(b["ts"]).to_numpy("datetime64[us]").astype("int64")
            for key, *event in zip(b["_key"].tolist(), at.tolist(), b["event_id"].tolist(), b["_rank"].tolist()):
                held.setdefault(key, [None, []])[1].append(event)
        reached, kept, out, due = state.getCurrentWatermarkMs() * 1000, {}, [], []
        for key, (stored, waiting) in held.items():
            stored, waiting, changed = one(stored, waiting, reached)
            out += [(key, r["story"], r["event"], r["at"], r["copies"]) for r in changed.values()]
            if stored or waiting:
                kept[key] = [stored, waiting]
                due.append(waiting[0][0] if waiting else stored["at"] + days * DAY)
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max(min(due) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if out:
            found = pd.DataFrame(out, columns=["_key", "story", "event_id", "at", "copies"])
            yield found.assign(at=pd.to_datetime(found["at"], unit="us"))

    told = rows.withWatermark("ts", late).groupBy("_bucket").applyInPandasWithState(tell, "_key string, story long, event_id long, at timestamp, copies long", "held string", "update", GroupStateTimeout.EventTimeTimeout)
    return told.withColumn("_key", F.from_json("_key", named)).select(*(F.col("_key")[k].alias(k) for k in keys), "story", "event_id", "at", "copies")


def land(changes: DataFrame, table: Table, keys: list[str], progress: str) -> None:
    """Merges all that is available now into the table and returns; called again with the same ``progress`` it goes on where it ended."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            table.upsert(batch, [*keys, "story"], [F.col("copies")])
        batch.unpersist()

    changes.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()

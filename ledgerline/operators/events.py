"""The event store: content keys, priority among sources, feeds and calendars. Events have (event_id, ticker, source, headline, ts)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headline_key(text: Column) -> Column:
    """Lower case, runs of other characters than ASCII letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def rank(source: Column, order: list[str]) -> Column:
    """Place of a source in the order of priority; unknown ones last."""
    out = F.lit(len(order))
    for k, name in reversed(list(enumerate(order))):
        out = F.when(source == name, k).otherwise(out)
    return out


def clamped(ts: Column, now: Column, hours: int = 12) -> Column:
    """A time more than ``hours`` ahead of now is now."""
    return F.when(ts > now + F.expr(f"interval {hours} hours"), now).otherwise(ts)


def deduplicated(df: DataFrame, keys: list[str], order: list[str], days: int = 5, eligible: list[str] | None = None) -> DataFrame:
    """The stored row of each story, by order of arrival (ts, event_id): event_id, keys, copies.

    Among the ``eligible`` sources (all, if None) an event with the keys of a stored row no
    more than ``days`` older is a copy; from a better source it takes the stored row's
    place, its time too. Later ones are new stories. Events of other sources, whose
    headlines may be generic, and events without time, which can't be placed, are each a
    story of their own; only the same event of the same source repeats it. Rows stream by
    in order, so a key that holds a third of all events is one row of state; rows alone
    with their key pass as whole columns.
    """
    named = [F.col(k) for k in keys]
    placed = F.col("ts").isNotNull() & (F.lit(True) if eligible is None else F.coalesce(F.col("source").isin(eligible), F.lit(False)))
    rows = df.where(placed).select(*named, F.col("ts").cast("timestamp").alias("ts"), "event_id", rank(F.col("source"), order).alias("_rank"))
    alone = df.where(~placed).groupBy("source", "event_id", *named).agg(F.count("*").alias("copies")).select("event_id", *named, "copies")
    width = len(keys)
    schema = f"event_id {dict(df.dtypes)['event_id']}, " + ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", copies long"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = stored = None  # stored: time, rank, event_id, copies
        span = timedelta(days=days)
        for b in batches:
            out = []
            if not b.num_rows:
                continue
            if stored:
                if (own := [c[0].as_py() for c in b.columns[:width]]) != key:  # a story that the last batch left open, and that ended there
                    yield made([(stored[2], *key, stored[3])], b.schema)
                    key = stored = None
            shared = between(b)
            first, last = shared[:-1], shared[1:]
            first[0], last[-1] = stored is not None, True  # the last row's key may go on in the next batch
            single = ~(first | last)
            if single.any():
                some = b.filter(pa.array(single))
                yield pa.RecordBatch.from_arrays([some.column(width + 1), *some.columns[:width], pa.array(np.ones(some.num_rows, np.int64))], names)
                b = b.filter(pa.array(~single))
            for *own, ts, event, place in zip(*(c.to_pylist() for c in b.columns)):
                if own != key or ts > stored[0] + span:
                    if stored:
                        out.append((stored[2], *key, stored[3]))
                    key, stored = own, (ts, place, event, 1)
                else:
                    stored = (ts, place, event, stored[3] + 1) if place < stored[1] else (*stored[:3], stored[3] + 1)
            yield made(out, b.schema)
        if stored:
            yield made([(stored[2], *key, stored[3])], b.schema)

    def between(b: pa.RecordBatch) -> np.ndarray:
        """Whether each row has the keys of the row before it; one more at the end."""
        same = np.zeros(b.num_rows + 1, bool)
        same[1:-1] = True
        for c in b.columns[:width]:
            coded = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            same[1:-1] &= coded[1:] == coded[:-1]
        return same

    def made(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        types = [schema.field("event_id").type, *(schema.field(k).type for k in range(width)), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    names = ["event_id", *keys, "copies"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id").mapInArrow(walk, schema).unionByName(alone)


def capped_feed(df: DataFrame, per: list[str], cap: int, n: int) -> DataFrame:
    """The newest n events, at most ``cap`` of each group; the cap is a ranked window that Spark limits before its shuffle."""
    w = Window.partitionBy(*per).orderBy(F.desc("ts"), "event_id")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r").orderBy(F.desc("ts"), "event_id").limit(n)


def calendar(responses: list[DataFrame], keys: list[str], released: str) -> DataFrame:
    """Union of schedules, one row per key: released ones win, then the larger value."""
    every = responses[0]
    for r in responses[1:]:
        every = every.unionByName(r)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.max(F.struct(F.col(released).isNotNull(), *rest)).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def curated(df: DataFrame, keywords: dict[str, int], n: int) -> DataFrame:
    """Rows by keyword score, the best of each headline's first eight words, n in all: event_id, score."""
    text = headline_key(F.col("headline"))
    score = sum((F.when(F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {k} "), w).otherwise(0) for k, w in keywords.items()), F.lit(0))
    stem = F.array_join(F.slice(F.split(text, " "), 1, 8), " ")
    scored = df.select("event_id", score.alias("score"), stem.alias("_k")).where("score > 0")
    best = scored.groupBy("_k").agg(F.max(F.struct("score", (-F.col("event_id")).alias("i"))).alias("_b"))
    return best.select((-F.col("_b.i")).alias("event_id"), F.col("_b.score").alias("score")).orderBy(F.desc("score"), "event_id").limit(n)


def universe_feed(df: DataFrame, n: int, exempt: list[str], capped: list[str], cap: int, deal_days: int = 5) -> DataFrame:
    """The newest n events with copies taken out afterwards, so that fewer than n may come: event_id, position.

    Of the n rows, newest first, goes one whose headline key a kept row of its ticker has
    (sources in ``exempt`` aside); a deal (``kind`` m_and_a) that shares two tokens with a
    kept deal of its ticker within ``deal_days`` days, or if either has no time; and of sources in ``capped`` what is
    over ``cap`` of one ticker and kind. Events without time come last. Only these n rows, a
    bound, meet in one task.
    """
    few = df.select("event_id", "ticker", "source", "kind", "tokens", headline_key(F.col("headline")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s")).orderBy(F.desc_nulls_last("s"), "event_id").limit(n)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["s"] is None, -(r["s"] or 0), r["event_id"]))
        seen, deals, counts, kept = set(), {}, {}, []
        for r in rows:
            if r["source"] not in exempt:
                if (r["ticker"], r["key"]) in seen:
                    continue
                seen.add((r["ticker"], r["key"]))
            if r["kind"] == "m_and_a":
                own, before = set(r["tokens"] or []), deals.setdefault(r["ticker"], [])
                if any(len(own & t) >= 2 and (r["s"] is None or s is None or abs(r["s"] - s) <= deal_days * 86_400_000_000) for t, s in before):
                    continue
                before.append((own, r["s"]))
            if r["source"] in capped:
                k = r["ticker"], r["kind"]
                counts[k] = counts.get(k, 0) + 1
                if counts[k] > cap:
                    continue
            kept.append(r["event_id"])
        yield pa.RecordBatch.from_pydict({"event_id": pa.array(kept, pa.int64()), "position": pa.array(range(1, len(kept) + 1), pa.int32())})

    return few.coalesce(1).mapInArrow(keep, "event_id long, position int")

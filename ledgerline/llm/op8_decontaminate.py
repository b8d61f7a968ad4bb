"""Benchmark passages in documents, by Wu-Manber search over words.

The patterns are all windows of 13 consecutive words of an item (an item of fewer words,
but not none, is one window), grouped by length. For each length a table of shifts,
indexed by a hash of a block of two words, tells how far the search may move on; where it
is zero, the bucket of windows with that last block is looked up, and those of them with
the same hash of the whole window are compared word by word, byte by byte.

All patterns are arrays over the bytes of the items. They are broadcast in blocks of at
most ``PATTERN_BYTES`` of item text, for which the driver and each worker hold about ten
times as much. A larger benchmark takes further passes over the documents; each writes
only what it hit, by digest of the text. The search itself needs no shuffle, and a
document of any length is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import free, written
from .words import LOWER, PUNCTUATION, U, Words, flat, mix, slices

NAME = "op8_decontaminate"
WINDOW = 13
PATTERN_BYTES = 8 << 20
TABLE_BITS = 18, 26
_K = U(0x9FB21C651E98DF25)


def _blocks(h: np.ndarray, size: int) -> np.ndarray:
    """For each word, a hash of the block of ``size`` words that ends there; meaningless at the first size - 1."""
    out = h.copy()
    if size == 2 and len(h) > 1:
        out[1:] = mix(h[:-1] * _K + h[1:])
    return out


def _whole(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place."""
    out = np.zeros(len(at), U)
    for k in range(length):
        out = out * _K + h[at + k]
    return mix(out)


class _Windows:
    """All windows of one length, sorted by the hash of their last block."""

    def __init__(self, words: Words, items: np.ndarray, length: int):
        self.length, self.size = length, min(2, length)
        n = words.count[items] - length + 1
        at = np.repeat(words.first[items], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h, last = _blocks(words.hash, self.size), length - self.size
        self.bits = int(np.clip(int(8 * len(at)).bit_length(), *TABLE_BITS))
        self.shift = np.full(1 << self.bits, last + 1, np.uint8)
        for k in range(last + 1):
            np.minimum.at(self.shift, h[at + self.size - 1 + k] >> U(64 - self.bits), np.uint8(last - k))
        end = h[at + length - 1]
        whole = _whole(words.hash, at, length)
        order = np.lexsort((whole, end))
        self.end, self.at, self.owner = end[order], at[order].astype(np.int32), np.repeat(items, n)[order].astype(np.int32)
        self.whole, self.known = whole[order], np.sort(whole)

    def steps(self, h: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """For each word, how far the search may move on from a window that ends there, 0 where a bucket holds its hash; and hashes of those ends and windows, in order."""
        ends = _blocks(h, self.size)
        shift = self.shift[ends >> U(64 - self.bits)]
        stops = np.flatnonzero(shift == 0)
        whole = _whole(h, np.maximum(stops - self.length + 1, 0), self.length)
        for held, wanted in ((self.end, ends[stops]), (self.known, whole)):
            shift[stops[held[np.minimum(held.searchsorted(wanted), len(held) - 1)] != wanted]] = 1  # no such bucket, or none of it alike
        real = shift[stops] == 0
        return shift.tobytes(), ends, whole[real]


class Patterns:
    """Windows of the items (name, text), with shift table and buckets for each length. An item without name marks words only."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        words = Words(*flat(pa.array([x or "" for _, x in items], pa.large_string())), PUNCTUATION)
        self.names, self.data = [n for n, _ in items], LOWER[words.data].tobytes()
        self.start, self.stop = words.start.astype(np.int32), words.end.astype(np.int32)
        lengths = np.minimum(window, words.count)
        self.windows = [_Windows(words, np.flatnonzero(lengths == n), int(n)) for n in np.unique(lengths[lengths > 0])]

    def _text(self, at: int, length: int) -> list[bytes]:
        return [self.data[self.start[k] : self.stop[k]] for k in range(at, at + length)]

    def search(self, words: Words) -> dict[int, tuple[np.ndarray, set[str]]]:
        """By document with occurrences: which of its words they hold, the names of the items."""
        out: dict[int, tuple[np.ndarray, set[str]]] = {}
        for w in self.windows:
            length = w.length
            if len(words.hash) < length:
                continue
            shift, ends, whole = w.steps(words.hash)
            at_stop = dict(zip(np.flatnonzero(np.frombuffer(shift, np.uint8) == 0).tolist(), whole.tolist())) if len(whole) else {}
            for d in np.flatnonzero(words.count >= length):
                start, stop = int(words.first[d]), int(words.first[d + 1])
                e = start + length - 1
                while e < stop:
                    if step := shift[e]:
                        e += step
                        continue
                    a, b = w.end.searchsorted(ends[e]), w.end.searchsorted(ends[e], "right")
                    at, wanted = e - length + 1, U(at_stop[e])
                    text = words.text(at, e + 1).split(b" ")
                    for k in range(a + w.whole[a:b].searchsorted(wanted), a + w.whole[a:b].searchsorted(wanted, "right")):
                        if self._text(int(w.at[k]), length) == text:
                            hit, of = out.setdefault(int(d), (np.zeros(stop - start, bool), set()))
                            hit[at - start : e + 1 - start] = True
                            if (name := self.names[w.owner[k]]) is not None:
                                of.add(name)
                    e += 1
        return out


def _scan(batches: Iterator[pa.RecordBatch], patterns, make) -> Iterator[pa.RecordBatch]:
    """``make`` of each run of rows, its count of words, and the hit words and items by row."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(*flat(part.column("text")), PUNCTUATION)
            yield make(part, words.count, patterns.value.search(words))


def _contaminated(counts, found) -> np.ndarray:
    hits = np.zeros(len(counts), np.int64)
    for k, (hit, _) in found.items():
        hits[k] = hit.sum()
    return (hits > 0) & (20 * hits >= counts)


def _digests(part, counts, found):
    rows = range(part.num_rows)
    names = [",".join(sorted(found[k][1])) if k in found else "" for k in rows]
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(counts, pa.int64()),
            pa.array([int(found[k][0].sum()) if k in found else 0 for k in rows], pa.int64()),
            pa.array([len(found[k][1]) if k in found else 0 for k in rows], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]),
            pa.array(_contaminated(counts, found)),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _hits(part, counts, found):
    """Only the rows with hits: digest of the text, count of words, hit words, names."""
    own = sorted(found)
    return pa.RecordBatch.from_arrays(
        [
            part.column("digest").take(pa.array(own, pa.int64())),
            pa.array(counts[own] if own else [], pa.int64()),
            pa.array([np.flatnonzero(found[k][0]) for k in own], pa.list_(pa.int64())),
            pa.array([sorted(found[k][1]) for k in own], pa.list_(pa.string())),
        ],
        ["digest", "n_words", "hit", "names"],
    )


def _passes(spark: SparkSession, benchmark: DataFrame, window: int, pattern_bytes: int) -> Iterator:
    """The benchmark's patterns, broadcast block by block."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // pattern_bytes))
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        yield passes, spark.sparkContext.broadcast(Patterns([(r.item, r.text) for r in own], window))


def _hit_texts(docs: DataFrame, patterns: Iterator) -> DataFrame:
    """What many passes hit, a row per text: digest, n_hit, names, contaminated."""
    found = None
    for _, p in patterns:
        rows = docs.select(F.sha1("text").alias("digest"), "text").mapInArrow(lambda it, p=p: _scan(it, p, _hits), "digest string, n_words long, hit array<long>, names array<string>")
        rows = written(rows.distinct(), "hits")
        found = rows if found is None else found.unionByName(rows)
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    one = found.groupBy("digest", "n_words").agg(F.size(every("hit")).cast("long").alias("n_hit"), F.array_sort(every("names")).alias("names"))
    return one.select("digest", "n_hit", "names", (20 * F.col("n_hit") >= F.col("n_words")).alias("contaminated"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n = pa.array(Words(*flat(part.column("text")), PUNCTUATION).count, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), n], ["doc_id", "digest", "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window of ``benchmark`` (item_id, text) is hit;
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. A null text has no words and is
    not contaminated. Items without text or words have no windows; items without id mark
    words as hit but count and are named nowhere; repeated items count once. Without items
    nothing is hit, and items_sha256 is that of an empty string. Repeated documents are
    judged each. Further columns are ignored.
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    plain, patterns = docs.select("doc_id", "text"), _passes(docs.sparkSession, benchmark, window, pattern_bytes)
    passes, first = next(patterns)
    if passes == 1:
        return plain.mapInArrow(lambda it: _scan(it, first, _digests), schema)
    found = _hit_texts(plain, _chained((passes, first), patterns))
    counted = plain.select("doc_id", F.sha1("text").alias("digest"), "text").mapInArrow(_counts, "doc_id long, digest string, n_words long")
    none = F.lit(0).cast("long")
    return counted.join(found, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce(F.size("names").cast("long"), none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def _chained(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns; null texts and those without words stay, repeated rows are judged each."""

    def make(part, counts, found):
        return part.filter(pa.array(~_contaminated(counts, found)))

    patterns = _passes(docs.sparkSession, benchmark, window, pattern_bytes)
    passes, first = next(patterns)
    if passes == 1:
        return docs.mapInArrow(lambda it: _scan(it, first, make), docs.schema)
    (name,) = free(docs.columns, "_digest")
    bad = _hit_texts(docs.select("text"), _chained((passes, first), patterns)).where("contaminated").select(F.col("digest").alias(name))
    return docs.withColumn(name, F.sha1("text")).join(bad, name, "left_anti").select(docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go; null texts and those without words stay, repeated rows are judged each."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_SPLIT}, []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT} AS ws FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item, ws, least(13, len(ws)) AS m FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT item, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM bl)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, lens WHERE len(ws) >= m)),
hit AS (SELECT dw.doc_id, dw.m, dw.i, win.item FROM dw JOIN win ON dw.m = win.m AND dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
  sha256(coalesce(its.names, '')) AS items_sha256,
  coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

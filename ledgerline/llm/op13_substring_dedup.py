"""Passages that repeat across documents, by suffix trees that are partitioned by prefixes.

A window of n words that occurs in two documents is a node of depth n or more in the
suffix tree of all texts. The tree is never in one place: its suffixes are split by
prefixes into groups that fit a task, and each task builds the subtrees of its groups.

Which suffixes: of the places of a window's first words, the one whose prefix (half a
window) has the least hash is the window's anchor. Equal windows have their anchor at the
same place, so only suffixes at anchors are needed, about one in a quarter of a window; a
suffix carries the words from its first window to its last. Suffixes whose prefix no other
document has are leaves that hang alone; they are found by counting and never sent.

Prefixes of two lengths: a prefix of half a window with at most GROUP suffixes is a group.
One with more is split by prefixes of a whole window's length; each of those is a node
deep enough by itself, of which only the smallest document matters, a keyed minimum; a
text that has it again and again is one row of it.

Subtrees: breadth first, word by word, all groups of a task at once: the suffixes of a
node go to its children by their next word. The same is done to the left of the anchor. A
deep node and a node of the words to its left are together a repeat that is maximal on
both sides as far as a window reaches; all its windows but those in its smallest document
are repeats.

Documents with equal words are one class, of which the smallest is looked at; the others
repeat it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op10_minhash import _groups
from .scratch import free, looked_up, written
from .words import SPACES, U, Words, flat, mix, slices

NAME = "op13_substring_dedup"
WINDOW = 50
#: Suffixes of a group that one task gets whole: about 2 MB of words.
GROUP = 4096
_FACTORS = U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F)


def _words(column) -> Words:
    return Words(*flat(column), SPACES, lower=False)


def _hashes(h: np.ndarray, n: int, factor: U) -> np.ndarray:
    """For each place, a hash of the n words from there."""
    out = np.zeros(max(0, len(h) - n + 1), U)
    for k in range(n):
        out = out * factor + h[k : k + len(out)]
    return mix(out)


def _least(v: np.ndarray, span: int) -> np.ndarray:
    """For each place, the first place of the least value among the ``span`` from there."""
    at, size = np.arange(len(v)), 1
    while size < span:
        step = min(size, span - size)
        a, b = at[: max(0, len(at) - step)], at[step:]
        at = np.where(v[b] < v[a], b, a)
        size += step
    return at


class _Anchors:
    """Anchors of all windows of some texts, in order: place, hash of the prefix there, first and last of the windows that have it."""

    def __init__(self, words: Words, window: int):
        half = -(-window // 2)
        prefix = _hashes(words.hash, half, _FACTORS[0])
        at = _least(prefix, window - half + 1)
        n = max(0, len(words.hash) - window + 1)
        place = np.flatnonzero(words.doc[:n] == words.doc[len(words.doc) - n :])
        at = at[place]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.at, self.first, self.last = at[first], place[first], place[np.append(first[1:], len(at))[: len(first)] - 1]
        self.prefix, self.doc = prefix[self.at].view(np.int64), words.doc[self.at]


def _listed(values: np.ndarray, of: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """A list of each row's values; ``of``: the row of each value, in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32()), pa.array(values, kind))


def _signed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per row: count and digest of the words, and the distinct prefixes at anchors with how often each occurs."""
    for batch in batches:
        for part in slices(batch, "text"):
            column = part.column("text")
            words = _words(column)
            anchors = _Anchors(words, window)
            order = np.lexsort((anchors.prefix, anchors.doc))
            prefix, doc = anchors.prefix[order], anchors.doc[order]
            first = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(doc)))
            data, offsets = words.data.tobytes(), words.offsets
            digests = [hashlib.sha256(b" ".join(data[a:b].split())).digest() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("text_hash"), pa.array(words.count, pa.int64()), pa.array(digests, pa.binary()),
                    _listed(prefix[first], doc[first], part.num_rows, pa.int64()), _listed(times, doc[first], part.num_rows, pa.int64()),
                ],
                ["doc_id", "text_hash", "n_words", "digest", "prefixes", "times"],
            )


def _suffixes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Suffixes at the anchors whose prefix is among the row's ``common``; those among its ``hot`` are marked."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = _words(part.column("text"))
            anchors = _Anchors(words, window)
            common, hot = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("common", "hot"))
            kept = np.flatnonzero(np.isin(anchors.prefix, common))
            at, first, last, doc = anchors.at[kept], anchors.first[kept], anchors.last[kept], anchors.doc[kept]
            data, rows = words.data.tobytes(), pa.array(doc, pa.int64())
            texts = [data[a:b] for a, b in zip(words.start[first], words.end[last + window - 1])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors.prefix[kept]), part.column("doc_id").take(rows), part.column("text_hash").take(rows), pa.array(np.isin(anchors.prefix[kept], hot)),
                    pa.array(first - words.first[doc], pa.int32()), pa.array(at - last, pa.int32()), pa.array(at - first, pa.int32()), pa.array(texts, pa.binary()),
                ],
                ["prefix", "doc_id", "text_hash", "hot", "place", "low", "high", "words"],
            )


def _children(nodes: np.ndarray, names: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The node of each suffix one word further: the child of its node by the word at ``at``; past its words each is a node alone."""
    count = int(names.max()) + 1
    word = np.where(inside, names[np.where(inside, at, 0)], count + np.arange(len(nodes)))
    return np.unique(nodes * (count + len(nodes)) + word, return_inverse=True)[1]


def _repeated(table: pa.Table, cuts: np.ndarray, window: int) -> pa.RecordBatch:
    """The windows of the suffixes of some groups that also start in a smaller document, by the groups' subtrees."""
    words, m = _words(table.column("words")), table.num_rows
    low, high, place, doc = (table.column(c).to_numpy() for c in ("low", "high", "place", "doc_id"))
    names = np.unique(words.hash, return_inverse=True)[1]
    begin, end = words.first[:-1], words.first[1:]
    at = begin + high
    root = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    right, nodes = {}, root
    for depth in range(1, window - int(low.min()) + 1):
        nodes = _children(nodes, names, at + depth - 1, at + depth <= end)
        if depth >= window - int(high.max()):
            right[depth] = nodes
    rows, starts, left = [], [], root
    for a in range(int(high.max()) + 1):
        if a:
            left = _children(left, names, at - a, at - a >= begin)
        own = np.flatnonzero((low <= a) & (a <= high))
        if len(own):
            _, node = np.unique(right[window - a][own] * m + left[own], return_inverse=True)
            smallest = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(smallest, node, doc[own])
            own = own[doc[own] > smallest[node]]
            rows.append(own)
            starts.append(place[own] + high[own] - a)
    rows, starts = np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((starts, rows))
    found = np.unique(rows)
    lists = _listed(starts[order], np.searchsorted(found, rows[order]), len(found), pa.int32())
    taken = pa.array(found, pa.int64())
    return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(taken), table.column("text_hash").combine_chunks().take(taken), lists], ["doc_id", "text_hash", "starts"])


def _subtrees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for table, cuts in _groups(batches, 1, 4 << 20):
        yield _repeated(table, cuts, window)


def _whole(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of suffixes by 128 bits of a hash of their words, those of a text together: where they start."""
    for batch in batches:
        for part in slices(batch, "words"):
            words = _words(part.column("words"))
            n = words.count - window + 1
            of = np.repeat(np.arange(part.num_rows), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            doc, text, starts = part.column("doc_id").to_numpy()[of], part.column("text_hash").to_numpy()[of], part.column("place").to_numpy()[of] + nth
            by = [starts, text, doc, *(_hashes(words.hash, window, f)[words.first[of] + nth] for f in _FACTORS)]
            order = np.lexsort(by)
            starts, text, doc, low, high = (x[order] for x in by)
            new = np.zeros(len(of), bool)
            new[:1] = True
            for x in (text, doc, low, high):
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            keys = np.ascontiguousarray(np.stack([low[first], high[first]], 1)).tobytes()
            key = pa.Array.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(keys)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([key, pa.array(doc[first]), pa.array(text[first]), _listed(starts, np.cumsum(new) - 1, len(first), pa.int32())], ["key", "doc_id", "text_hash", "starts"])


def _kept(starts: np.ndarray, count: int, window: int) -> np.ndarray:
    """Which of ``count`` words no window from ``starts`` covers."""
    ends = np.bincount(starts, minlength=count + 1) - np.bincount(starts + window, minlength=count + 1)
    return np.cumsum(ends[:count]) == 0


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per row, how many words its repeated windows cover and the words that stay, one space between two."""
    for batch in batches:
        gone, kept = [], []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts")):
            words = text.encode().split()
            stays = _kept(starts.values.to_numpy(), len(words), window)
            gone.append(int(len(words) - stays.sum()))
            kept.append(b" ".join(compress(words, stays.tolist())))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "text_hash", "n_removed", "kept"])


def repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """What ``docs`` (doc_id, text) repeat: a row per row (doc_id, text_hash, n_words, digest of the words, whole), and a row per text that repeats a part (doc_id, text_hash, n_removed, kept).

    whole: the text has at least ``window`` words and all of them, in order, are those of a
    smaller doc_id; such texts aren't in the second table. n_removed, kept: words covered by
    a window whose words also start in a text with a smaller doc_id, and the other words
    joined by one space; windows are judged on ``docs``, not on what is left. text_hash is
    xxhash64 of the text, which with doc_id names a text.

    A null text has no words. Texts of fewer words than ``window`` repeat nothing. A null
    doc_id takes no part. Rows with equal doc_id don't repeat each other, so one document's
    own repetitions stay. Further columns are ignored; empty tables give empty results.
    """
    if window < 2:
        raise ValueError(f"window must be at least 2, not {window}")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = written(
        hashed.mapInArrow(lambda it: _signed(it, window), "doc_id long, text_hash long, n_words long, digest binary, prefixes array<long>, times array<long>"), "signed"
    )
    long = signed.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = long.groupBy("digest").agg(F.min("doc_id").alias("first"))
    classed = looked_up(signed.drop("prefixes", "times"), firsts, "digest", "doc_id")
    classed = classed.select("doc_id", "text_hash", "n_words", "digest", F.coalesce((F.col("n_words") >= window) & (F.col("first") < F.col("doc_id")), F.lit(False)).alias("whole"))
    # prefixes that more than one document has; the count of documents is above the 32 bits of that of suffixes
    own = long.join(firsts, [long.digest == firsts.digest, long.doc_id == F.col("first")], "left_semi")
    prefixes = own.select("doc_id", F.explode(F.arrays_zip("prefixes", "times")).alias("x")).select("doc_id", F.col("x.prefixes").alias("prefix"), F.col("x.times").alias("times"))
    one = F.lit(1 << 32)
    shared = prefixes.groupBy("prefix").agg(F.sum(F.least("times", one - 1) + one).alias("n")).where(F.col("n") >= 2 * one)
    shared = shared.select("prefix", (F.col("n") % one > group).alias("hot"))
    marked = prefixes.select("doc_id", "prefix").join(shared, "prefix").groupBy("doc_id").agg(F.collect_set("prefix").alias("common"), F.collect_set(F.when(F.col("hot"), F.col("prefix"))).alias("hot"))
    texts = written(hashed.join(marked, "doc_id"), "texts")
    suffixes = written(
        texts.mapInArrow(lambda it: _suffixes(it, window), "prefix long, doc_id long, text_hash long, hot boolean, place int, low int, high int, words binary"), "suffixes"
    )
    grouped = suffixes.where("not hot").repartition("prefix").sortWithinPartitions("prefix")
    found = grouped.mapInArrow(lambda it: _subtrees(it, window), "doc_id long, text_hash long, starts array<int>")
    nodes = written(suffixes.where("hot").mapInArrow(lambda it: _whole(it, window), "key binary, doc_id long, text_hash long, starts array<int>"), "nodes")
    smallest = nodes.groupBy("key").agg(F.min("doc_id").alias("smallest"))
    hot = looked_up(nodes, smallest, "key", "doc_id", "inner").where("doc_id > smallest").select("doc_id", "text_hash", "starts")
    spans = found.union(hot).groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    parts = texts.select("doc_id", "text_hash", "text").dropDuplicates(["doc_id", "text_hash"]).join(spans, ["doc_id", "text_hash"])
    cut = parts.select("doc_id", "text_hash", "text", "starts").mapInArrow(lambda it: _cut(it, window), "doc_id long, text_hash long, n_removed long, kept string")
    return classed, cut


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, any others) with the repeated words taken out of their texts (see :func:`repeats`), a row per row.

    Texts of which nothing is taken stay as they are, null included; others keep their
    words with one space between two, and texts that repeat another whole are empty.
    """
    classed, cut = repeats(docs, window)
    h, d, whole, kept = free(docs.columns, "_hash", "_id", "_whole", "_kept")
    changed = classed.where("whole").select("doc_id", "text_hash", F.lit("").alias(kept)).distinct()
    cut = cut.join(changed, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash", F.col("kept").alias(kept))
    changed = changed.union(cut).withColumnsRenamed({"doc_id": d, "text_hash": h})
    joined = docs.join(changed, [docs.doc_id == F.col(d), F.xxhash64(docs.text) == F.col(h)], "left")
    return joined.select(*(F.coalesce(F.col(kept), docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed, cut = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cut = cut.select("doc_id", "text_hash", F.col("n_removed").alias("gone"), F.sha2("kept", 256).alias("kept"))
    joined = classed.join(cut, ["doc_id", "text_hash"], "left")
    none = F.sha2(F.lit(""), 256)
    return joined.select(
        "doc_id", "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), none).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50 AND doc_id IS NOT NULL)),
least_of AS (SELECT g, min(doc_id) AS least_id FROM win GROUP BY g),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM (SELECT w.rid, w.i FROM win w JOIN least_of l ON w.g = l.g WHERE w.doc_id > l.least_id)),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""

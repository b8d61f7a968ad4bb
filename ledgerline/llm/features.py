"""Sparse features of texts, and models fitted to a bounded sample of labelled rows.

Features are hashed words (log counts, divided by the root of their length in each text), structure
statistics and the metadata column n_chars where there is one. A model is fitted in
rounds: shards of the sample, read where they were written, each take a pass of minibatch
descent from the same parameters, and the driver averages what they return. Parameters have a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.workspace import folder

from .scratch import fraction
from .words import SPACES, U, Words, flat, mix, slices

WORD_BITS = 15
STATISTICS = 16
SIZE = (1 << WORD_BITS) + STATISTICS + 1  # the last is always 1
SHARDS = 8

_CLASSES = {
    "letter": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)],
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "space": [0x20, *range(0x09, 0x0E)],
    "sentence": [ord(c) for c in ".,;:!?'\"()-"],
    "wide": range(0x80, 0x100),
}


def _member(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_MEMBERS = [_member(x) for x in _CLASSES.values()]


def _per_doc(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and the count of its most frequent one."""
    _, at, n = np.unique(mix(h + doc.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc[at], n)
    return np.bincount(doc[at], minlength=docs), most


class Rows:
    """Features of a run of rows: ``index`` and ``value`` between ``cut[k]`` and ``cut[k + 1]``."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = flat(part.column("text"))
        docs = part.num_rows
        words = Words(data, offsets, SPACES)
        self.tokens = words.count
        key = (words.doc.astype(np.uint32) << np.uint32(WORD_BITS)) | (words.hash >> U(64 - WORD_BITS)).astype(np.uint32)
        key, n = np.unique(key, return_counts=True)
        doc, value = (key >> np.uint32(WORD_BITS)).astype(np.int64), np.log1p(n).astype(np.float32)
        norm = np.bincount(doc, weights=value**2, minlength=docs) ** 0.25
        size = np.diff(offsets)
        shares = []
        for member in _MEMBERS:
            total = np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
            shares.append((total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1))
        lines = Words(data, offsets, b"\n")
        distinct_lines, most_line = _per_doc(lines.doc, lines.hash, docs)
        distinct = np.bincount(doc, minlength=docs)
        most_word = np.zeros(docs, np.int64)
        np.maximum.at(most_word, doc, n)
        per = np.maximum(words.count, 1)
        chars = part.column("n_chars").fill_null(0).to_numpy() if "n_chars" in part.schema.names else size
        dense = [
            *shares,
            1 - shares[0] - shares[2] - shares[3] - shares[4],
            np.log1p(size) / 8,
            np.log1p(np.maximum(chars, 0)) / 8,
            np.log1p(words.count) / 6,
            np.bincount(words.doc, weights=words.end - words.start, minlength=docs) / per / 8,
            distinct / per,
            most_word / per,
            np.log1p(lines.count) / 4,
            distinct_lines / np.maximum(lines.count, 1),
            most_line / np.maximum(lines.count, 1),
        ]
        assert len(dense) == STATISTICS
        dense = np.stack([*dense, np.ones(docs)], axis=1).astype(np.float32)
        width = dense.shape[1]
        self.cut = np.concatenate([[0], np.cumsum(distinct + width)])
        self.index = np.empty(self.cut[-1], np.int32)
        self.value = np.empty(self.cut[-1], np.float32)
        at = np.arange(len(key)) + doc * width
        self.index[at] = key & np.uint32((1 << WORD_BITS) - 1)
        self.value[at] = value / np.maximum(norm, 1e-9)[doc]
        at = (np.cumsum(distinct)[:, None] + np.arange(docs)[:, None] * width + np.arange(width)).ravel()
        self.index[at] = np.tile(np.arange(1 << WORD_BITS, SIZE), docs)
        self.value[at] = dense.ravel()


def sample(docs: DataFrame, labelled: DataFrame, most: int) -> DataFrame:
    """Features of about ``most`` labelled rows at the most, chosen by a hash of doc_id: (shard, label, index, value), written.

    ``labelled`` has (doc_id, label), one row per doc_id. Its chosen rows, of bounded
    number, are broadcast; only their texts are shuffled. Of rows of ``docs`` that repeat
    a doc_id one counts. Each shard is one folder with one file, which rounds read in place.
    """
    count = labelled.count()
    share = min(1.0, most / max(1, count))
    chosen = labelled.where(fraction(share, "sample", "doc_id"))
    named = [c for c in ("text", "n_chars") if c in docs.columns]
    rows = docs.select("doc_id", *named).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.col("label").cast("int").alias("label"), *named)).alias("_r"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), "_r.*")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f = Rows(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("shard"), part.column("label"), *(pa.array(np.split(x, f.cut[1:-1]), t) for x, t in ((f.index, pa.list_(pa.int32())), (f.value, pa.list_(pa.float32()))))],
                    ["shard", "label", "index", "value"],
                )

    made, path = rows.mapInArrow(make, "shard int, label int, index array<int>, value array<float>"), folder(docs.sparkSession, "sample")
    made.repartition(SHARDS, "shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema("label int, index array<int>, value array<float>, shard int").parquet(path)


def _pass(spread, step: Callable, turn: int, batch: int) -> Callable:
    """One pass over each shard of a task, from the round's parameters."""

    def shard(table):
        own = {k: {n: v.copy() for n, v in x.items()} for k, x in spread.value.items()}
        label = table.column("label").to_numpy()
        index, value = (pa.concat_arrays(table.column(c).chunks) for c in ("index", "value"))
        cut, index, value = index.offsets.to_numpy().astype(np.int64), index.values.to_numpy(), value.values.to_numpy()
        order = np.random.default_rng(turn).permutation(len(label))
        for a in range(0, len(order), batch):
            chosen = order[a : a + batch]
            sizes = cut[chosen + 1] - cut[chosen]
            inner = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(cut[chosen] - inner[:-1], sizes) + np.arange(inner[-1])
            step(own["parameters"], own["sums"], inner, index[at], value[at], label[chosen])
        names = [(k, n) for k in own for n in own[k]]
        return pa.RecordBatch.from_pydict({"part": [k for k, _ in names], "name": [n for _, n in names], "n": [len(label)] * len(names), "data": pa.array([own[k][n].tobytes() for k, n in names], pa.binary())})

    def shards(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:  # a batch may end one shard's file and begin the next
            number = b.column("shard").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]])
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    held.setdefault(int(number[a]), []).append(b.slice(a, z - a))
        for k in sorted(held):
            yield shard(pa.Table.from_batches(held[k]))

    return shards


def fit(rows: DataFrame, start: dict[str, np.ndarray], step: Callable, rounds: int, batch: int = 32) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` rounds. ``step(parameters, sums, cut, index, value, label)`` takes one minibatch, in place; ``sums``: of squared gradients."""
    spark, state = rows.sparkSession, {"parameters": start, "sums": {k: np.full_like(v, 1e-3) for k, v in start.items()}}
    for turn in range(rounds):
        spread = spark.sparkContext.broadcast(state)
        total, weight = {k: {n: np.zeros(v.shape) for n, v in x.items()} for k, x in state.items()}, 0
        for r in rows.mapInArrow(_pass(spread, step, turn, batch), "part string, name string, n long, data binary").collect():
            total[r.part][r.name] += r.n * np.frombuffer(r.data, np.float32).reshape(total[r.part][r.name].shape)
            weight += r.n if (r.part, r.name) == ("parameters", next(iter(start))) else 0
        if weight:
            state = {k: {n: (v / weight).astype(np.float32) for n, v in x.items()} for k, x in total.items()}
        spread.unpersist()
    return state["parameters"]


def descend(parameters: dict, sums: dict, name: str, index: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """An Adagrad step for the rows ``index`` of a parameter; equal rows' gradients are summed."""
    own, at = np.unique(index, return_inverse=True)
    total = np.zeros((len(own), *gradient.shape[1:]), np.float32)
    np.add.at(total, at, gradient)
    sums[name][own] += total**2
    parameters[name][own] -= rate * total / np.sqrt(sums[name][own])

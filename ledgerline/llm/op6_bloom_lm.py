"""Language-model scores from a log-frequency Bloom filter.

Training documents give counts of words and word pairs as 64-bit hashes, summed per task,
dealt by hash part and merged. A count c enters the filter as the levels 1 to
1 + floor(log2 c) of its key; a reader probes level after level until one is absent and
takes the middle of the last one's range. The filter is one segment per hash part, built
where that part's counts are, with ``BITS_PER_LEVEL`` bits a level. Up to ``FILTER_BYTES``
in all, the filter is broadcast and probed where documents are scored. Beyond, segments
stay where they are, and each block of documents sends the distinct words and pairs it
holds to be probed there; the filter, the probes and so the scores are the same.

A token's probability interpolates the pair's share of its first word with the add-one
share of the word, both from the filter; after a word that isn't known, the word alone. The base score needs exact counts instead: each
block of documents asks for the counts of its distinct words, part by part, and the
answers come back to the block. What is dealt are arrays of hashes, one row per block (or
task) and part, so a word with a third of all tokens costs one entry a row. Where there
are more than 2 ** FIRST_BITS parts, counts are dealt twice, by the first bits of the part
and then by all, so that rows hold many entries however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .words import SPACES, U, Words, flat, mix, slices

NAME = "op6_bloom_lm"
ORACLE_SQL = None
BITS_PER_LEVEL, PROBES = 8, 4
FILTER_BYTES = 128 << 20
PAIR_WEIGHT = 0.25
BLOCK_BYTES, PART_BLOCKS = 12 << 20, 4
FIRST_BITS, BUFFER = 10, 4 << 20
END = U(0x5851F42D4C957F2D)
_K = U(0xC2B2AE3D27D4EB4F)
_STEP = U(0x2545F4914F6CDD1D)


def _tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of every token, an end after each document's words, and the token before, an end at the start."""
    words = Words(*flat(column), SPACES)
    docs, n = len(words.count), len(words.hash)
    token, doc = np.empty(n + docs, U), np.empty(n + docs, np.int64)
    at = np.arange(n) + words.doc
    token[at], doc[at] = words.hash, words.doc
    ends = words.first[1:] + np.arange(docs)
    token[ends], doc[ends] = END, np.arange(docs)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[words.first[:-1] + np.arange(docs)] = END
    return token, doc, before


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _K + token)


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    """The hash part: the top bits."""
    return (h >> U(64 - bits)).astype(np.int64)


def _cuts(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each part of sorted hashes begins."""
    return np.searchsorted(_part(h, bits), np.arange((1 << bits) + 1))


_COUNTED = pa.schema([("p", pa.int32()), ("words", pa.binary()), ("word_counts", pa.binary()), ("once", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])


def _rows(w: np.ndarray, wn: np.ndarray, p: np.ndarray, pn: np.ndarray, bits: int, key) -> pa.RecordBatch:
    """Sorted words and pairs with their counts, a row for each hash part that has some; a pair is kept as ``key``, all of its hash or the low half."""
    wc, pc, low = _cuts(w, bits), _cuts(p, bits), p.astype(key)
    rows = []
    for k in np.flatnonzero(np.diff(wc) + np.diff(pc)):
        a, b = pc[k], pc[k + 1]
        many = pn[a:b] > 1
        rows.append((k, w[wc[k] : wc[k + 1]].tobytes(), wn[wc[k] : wc[k + 1]].tobytes(), low[a:b][~many].tobytes(), low[a:b][many].tobytes(), pn[a:b][many].tobytes()))
    columns = list(zip(*rows)) or [()] * len(_COUNTED)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _COUNTED.types)], schema=_COUNTED)


def _counted(batches: Iterator[pa.RecordBatch], bits: int, key, buffer: int = BUFFER) -> Iterator[pa.RecordBatch]:
    """Sums of what a task has read, a row per hash part with some each time its buffer is full."""

    def summed(tokens, pairs):
        w, wn = np.unique(np.concatenate(tokens), return_counts=True)
        p, pn = np.unique(np.concatenate(pairs), return_counts=True)
        return _rows(w, wn.astype(np.int64), p, pn.astype(np.int64), bits, key)

    tokens, pairs, held = [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            token, _, before = _tokens(part.column("text"))
            tokens.append(token)
            pairs.append(_pair(before, token))
            held += len(token)
            if held >= buffer:
                yield summed(tokens, pairs)
                tokens, pairs, held = [], [], 0
    if held:
        yield summed(tokens, pairs)


def _refined(batches: Iterator[pa.RecordBatch], bits: int, buffer: int = BUFFER) -> Iterator[pa.RecordBatch]:
    """Rows of first parts, sorted by them, summed up to the buffer's size and cut into full parts."""
    held: list[tuple] = []
    size, now = 0, None

    def summed():
        join = lambda k, kind: np.frombuffer(b"".join(r[k] for r in held), kind)
        w, wn = _sum(join(0, U), join(1, np.int64))
        once = join(2, U)
        p, pn = _sum(np.concatenate([once, join(3, U)]), np.concatenate([np.ones(len(once), np.int64), join(4, np.int64)]))
        return _rows(w, wn, p, pn, bits, np.uint32)

    for b in batches:
        for p, *row in zip(*(b.column(c).to_pylist() for c in _COUNTED.names)):
            if held and (p != now or size >= buffer):
                yield summed()
                held, size = [], 0
            now = p
            held.append(tuple(row))
            size += (len(row[0]) + len(row[2]) + len(row[3])) // 8
    if held:
        yield summed()


def _read(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(flat(table.column(name).cast(pa.large_binary()))[0].tobytes(), kind)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _places(keys: np.ndarray, kind: int, level: int, size) -> Iterator[np.ndarray]:
    """The bits of (key, level) in a segment of ``size`` bits, probe by probe."""
    h = mix(keys.astype(U) * _K + U((level * 2 + kind) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
    a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    for i in range(PROBES):
        yield (a + U(i) * b) % size


def _merged(table: pa.Table) -> pa.Table:
    """Exact word counts of a hash part, and its segment of the filter."""
    w, wn = _sum(_read(table, "words", U), _read(table, "word_counts", np.int64))
    once, pairs = _read(table, "once", np.uint32), _read(table, "pairs", np.uint32)
    p, pn = _sum(np.concatenate([once, pairs]), np.concatenate([np.ones(len(once), np.int64), _read(table, "pair_counts", np.int64)]))
    keyed = [(w.astype(np.uint32), np.frexp(wn.astype(float))[1]), (p, np.frexp(pn.astype(float))[1])]
    levels = sum(int(q.sum()) for _, q in keyed)
    size = max(64, BITS_PER_LEVEL * levels) // 64 * 64
    field = np.zeros(size, bool)
    for kind, (keys, top) in enumerate(keyed):
        for level in range(1, int(top.max(initial=0)) + 1):
            for at in _places(keys[top >= level], kind, level, U(size)):
                field[at] = True
    return pa.table(
        {
            "p": pa.array([table.column("p")[0].as_py()], pa.int32()),
            "words": pa.array([w.tobytes()], pa.binary()),
            "word_counts": pa.array([wn.tobytes()], pa.binary()),
            "distinct": pa.array([len(w)], pa.int64()),
            "total": pa.array([int(wn.sum())], pa.int64()),
            "filter": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary()),
        }
    )


class Filter:
    """The segments, by hash part."""

    def __init__(self, segments: dict[int, bytes], bits: int):
        sizes = np.zeros(1 << bits, np.int64)
        for p, x in segments.items():
            sizes[p] = 8 * len(x)
        self.bits, self.size = bits, sizes.astype(U)
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(U)
        self.field = np.frombuffer(b"".join(segments[p] for p in sorted(segments)), np.uint8)

    def levels(self, h: np.ndarray, kind: int) -> np.ndarray:
        """Levels of words (kind 0) or pairs (1) by their hashes: probes of rising levels until one is absent."""
        part = _part(h, self.bits)
        out, level = np.zeros(len(h), np.uint8), 1
        alive = np.flatnonzero(self.size[part] > 0)
        while len(alive) and level < 64:
            here = alive
            base, size, key = self.start[part[here]], self.size[part[here]], h[here] & U(0xFFFFFFFF)
            for i in range(PROBES):
                mixed = mix(key * _K + U((level * 2 + kind) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
                at = base + ((mixed & U(0xFFFFFFFF)) + U(i) * ((mixed >> U(32)) | U(1))) % size
                hit = (self.field[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
                here, base, size, key = here[hit], base[hit], size[hit], key[hit]
            out[here] = level
            alive, level = here, level + 1
        return out


#: The estimated count of each level: the middle of its range.
MIDDLE = np.concatenate([[0.0], (2.0 ** np.arange(63) + 2.0 ** np.arange(1, 64) - 1) / 2])


def _asked(table: pa.Table, bits: int, pairs: bool) -> pa.Table:
    """The distinct words, and pairs if wanted, of a block of documents, a row per hash part."""
    seen: tuple[list, list] = ([], [])
    for part in slices(table, "text"):
        token, _, before = _tokens(part.column("text"))
        seen[0].append(np.unique(token))
        if pairs:
            seen[1].append(np.unique(_pair(before, token)))
    h = [np.unique(np.concatenate(x)) if x else np.zeros(0, U) for x in seen]
    cuts = [_cuts(x, bits) for x in h]
    full = np.flatnonzero(np.diff(cuts[0]) + np.diff(cuts[1]))
    block = table.column("block")[0].as_py()
    columns = [pa.array([x[c[k] : c[k + 1]].tobytes() for k in full], pa.binary()) for x, c in zip(h, cuts)]
    return pa.table([pa.array([block] * len(full), pa.int32()), pa.array(full, pa.int32()), *columns], names=["block", "p", "words", "pairs"])


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of sorted keys; 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


_ANSWERED = "block int, p int, words binary, pairs binary, word_counts binary, word_levels binary, pair_levels binary"


def _answers(asked: pa.Table, counted: pa.Table, bits: int, probe: bool) -> pa.Table:
    """Exact counts of the words asked for and, to ``probe``, levels of words and pairs in this part's segment."""
    keys, counts = _read(counted, "words", U), _read(counted, "word_counts", np.int64)
    segment = Filter({r["p"]: r["filter"] for r in counted.select(["p", "filter"]).to_pylist()} if probe else {}, bits)
    words = [np.frombuffer(x.as_py(), U) for x in asked.column("words")]
    pairs = [np.frombuffer(x.as_py(), U) for x in asked.column("pairs")]
    found = [_find(keys, counts, x).tobytes() for x in words]
    levels = [[segment.levels(x, k).tobytes() for x in own] for k, own in enumerate((words, pairs))]
    for name, column in zip(("word_counts", "word_levels", "pair_levels"), (found, *levels)):
        asked = asked.append_column(name, pa.array(column, pa.binary()))
    return asked


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(docs: pa.Table, answers: pa.Table, model, total: int, distinct: int, weight: float) -> pa.Table:
    """Scores of a block of documents; ``model``: the broadcast filter, None if the answers hold levels."""
    keys, counts = _read(answers, "words", U), _read(answers, "word_counts", np.int64)
    order = np.argsort(keys)
    read = MIDDLE[model.value.levels(keys, 0) if model else _read(answers, "word_levels", np.uint8)][order]
    keys, counts = keys[order], counts[order]
    pair_keys, pair_levels = _read(answers, "pairs", U), _read(answers, "pair_levels", np.uint8)
    order = np.argsort(pair_keys)
    pair_keys, pair_levels = pair_keys[order], pair_levels[order]
    denominator, out = total + distinct + 1, []
    for part in slices(docs, "text"):
        token, doc, before = _tokens(part.column("text"))
        at = np.searchsorted(keys, token)
        exact, own = counts[at], read[at]
        pair, where = np.unique(_pair(before, token), return_inverse=True)
        first = read[np.minimum(np.searchsorted(keys, before), len(keys) - 1)]  # every word before is in the block, or an end
        both = MIDDLE[model.value.levels(pair, 1) if model else pair_levels[np.searchsorted(pair_keys, pair)]][where]
        share = np.minimum(1, both / np.maximum(first, 1))
        mixed = np.where(first > 0, weight, 0.0)  # after an unseen word the word alone counts
        rows, add = part.num_rows, lambda x: np.bincount(doc, weights=x, minlength=part.num_rows)  # noqa: B023
        out.append(
            pa.table(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(np.bincount(doc, minlength=rows), pa.int64()),
                    pa.array(np.bincount(doc[exact > 0], minlength=rows), pa.int64()),
                    pa.array(np.full(rows, total), pa.int64()),
                    pa.array(add(np.log10((exact + 1) / denominator))),
                    pa.array(add(np.log10(mixed * share + (1 - mixed) * (own + 1) / denominator))),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
        )
    return pa.concat_tables(out)


def scores(docs: DataFrame, held_out, weight: float = PAIR_WEIGHT, filter_bytes: int = FILTER_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column of ``docs``; rows where it is true aren't learnt
    from. A null text is empty: its only token is the end. Repeated rows count and are
    scored each. Without training rows every count is 0. Further columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", "text", held_out.alias("held_out"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // max(1, min(block_bytes, max(1 << 20, size // 64)))))
    bits = max(4, int(max(1, size // (PART_BLOCKS * block_bytes)) - 1).bit_length())  # a hash part for some blocks' worth of text, 16 at least
    first, counted_schema = min(bits, FIRST_BITS), "p int, words binary, word_counts binary, once binary, pairs binary, pair_counts binary"
    key = np.uint32 if first == bits else U
    counted = plain.where("not held_out").select("text").mapInArrow(lambda it: _counted(it, first, key), counted_schema)
    if first < bits:
        many = F.pmod(F.xxhash64("words", "once"), F.lit(1 << (bits - first)))
        counted = counted.repartition("p", many).sortWithinPartitions("p").mapInArrow(lambda it: _refined(it, bits), counted_schema)
    merged = written(
        counted.groupBy("p").applyInArrow(lambda t: _merged(t), "p int, words binary, word_counts binary, distinct long, total long, filter binary"), "counts"
    )
    none = F.lit(0)
    row = merged.agg(F.coalesce(F.sum("distinct"), none), F.coalesce(F.sum("total"), none), F.coalesce(F.sum(F.octet_length("filter")), none)).first()
    distinct, total, here = int(row[0]), int(row[1]), row[2] <= filter_bytes
    model = spark.sparkContext.broadcast(Filter({r.p: bytes(r["filter"]) for r in merged.select("p", "filter").toLocalIterator()}, bits)) if here else None
    blocked = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = blocked.groupBy("block").applyInArrow(lambda t: _asked(t, bits, not here), "block int, p int, words binary, pairs binary")
    stored = merged.select("p", "words", "word_counts", F.lit(None).cast("binary").alias("filter") if here else F.col("filter"))
    told = asked.groupBy("p").cogroup(stored.groupBy("p")).applyInArrow(lambda a, b: _answers(a, b, bits, not here), _ANSWERED)
    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: _scored(a, b, model, total, distinct, weight), _SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import op6_bloom_lm as op


def held():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def brute(rows):
    """(n_tokens, n_known, train_tokens, base_score) by doc_id; rows: (doc_id, held_out, text)."""
    count = Counter(t for _, held, text in rows if not held for t in tokens(text))
    n, v = sum(count.values()), len(count)
    out = {}
    for d, _, text in rows:
        own = tokens(text)
        out[d] = len(own), sum(t in count for t in own), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)
    return out


def check(found, wanted):
    assert {r.doc_id for r in found} == set(wanted)
    for r in found:
        n, known, train, base = wanted[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_counts_and_base_of_the_table(spark, small, documents):
    rows = documents.select("doc_id", held().alias("h"), "text").collect()
    found = op.query(spark, small).collect()
    check(found, brute([tuple(r) for r in rows]))
    was = {r.doc_id: r.h for r in rows}
    assert all(r.held_out == was[r.doc_id] for r in found)
    own = [(r.score / r.n_tokens, r.base_score / r.n_tokens) for r in found if r.held_out]
    assert np.mean([a for a, _ in own]) > np.mean([b for _, b in own])  # pairs help on text not learnt from


def test_odd_texts(docs):
    pairs = [(1, None), (2, ""), (3, "One one ONE é"), (4, " \t\n"), (5, "one é é " * 100_000), (6, "never seen"), (8, "Ä ä")]
    table = docs(pairs).withColumn("held_out", F.lit("clash"))
    six = F.col("doc_id") == 6
    check(op.scores(table, six).collect(), brute([(d, d == 6, t) for d, t in pairs]))


def test_filter_that_stays_where_it_is(documents):
    """Above the size bound, segments are probed in place: the same scores to the last bit."""
    near = {r.doc_id: r for r in op.scores(documents, held(), block_bytes=1 << 16).collect()}
    far = {r.doc_id: r for r in op.scores(documents, held(), filter_bytes=0, block_bytes=1 << 16).collect()}
    assert near == far


def test_counts_dealt_twice_give_the_same_filter(documents, monkeypatch):
    """More parts than the first dealing has: the same counts and scores."""
    once = {r.doc_id: r for r in op.scores(documents, held(), block_bytes=1 << 12).collect()}
    monkeypatch.setattr(op, "FIRST_BITS", 2)
    twice = {r.doc_id: r for r in op.scores(documents, held(), block_bytes=1 << 12).collect()}
    assert once == twice


def test_after_an_unseen_word_the_word_alone_counts(docs):
    train = [(1, "a b")] * 3
    table = docs([*train, (6, "zz a")])
    (r,) = op.scores(table, F.col("doc_id") == 6).where("held_out").collect()
    n, v = 9, 3
    alone = lambda c: (c + 1) / (n + v + 1)
    count = lambda c: op.MIDDLE[int(math.log2(c)) + 1] if c else 0
    w = op.PAIR_WEIGHT
    wanted = math.log10((1 - w) * alone(0)) + math.log10(alone(count(3))) + math.log10((1 - w) * alone(count(3)))
    assert abs(r.score - wanted) < 1e-9


def test_repeated_rows_count_and_are_scored_each(docs):
    found = op.scores(docs([(1, "a b"), (1, "a b"), (None, "a")]), F.lit(False)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in found) == [(0, 2, 8), (1, 3, 8), (1, 3, 8)]


def test_nothing_learnt_and_no_rows(docs):
    (r,) = op.scores(docs([(1, "a b")]), F.lit(True)).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0)
    assert op.scores(docs([]), F.lit(False)).collect() == []


def test_levels_never_fall_short_and_seldom_exceed():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 63, 20_000, np.uint64) << np.uint64(1)
    h[: 1 << 4] = np.arange(16, dtype=np.uint64) << np.uint64(60)
    n = np.minimum(rng.zipf(1.5, len(h)), 10**6)
    import pyarrow as pa

    segments = {}
    for p in range(16):
        own = op._part(h, 4) == p
        order = np.argsort(h[own])
        none = pa.array([b""], pa.binary())
        table = pa.table({"p": pa.array([p], pa.int32()), "words": pa.array([h[own][order].tobytes()]), "word_counts": pa.array([n[own][order].astype(np.int64).tobytes()]), "once": none, "pairs": none, "pair_counts": none})
        segments[p] = op._merged(table).column("filter")[0].as_py()
    level = op.Filter(segments, 4).levels(h, 0)
    true = np.floor(np.log2(n)).astype(int) + 1
    assert (level >= true).all() and (level == true).mean() > 0.95
    unseen = op.Filter(segments, 4).levels(rng.integers(0, 1 << 63, 20_000, np.uint64), 0)
    assert (unseen == 0).mean() > 0.95

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import op13_substring_dedup as op
from ledgerline.llm.words import SPACES, Words, flat

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(pairs, window):
    """doc_id, text, n_words, n_removed and the words kept of each row."""
    least = {}
    for d, text in pairs:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, d), d)
    out = []
    for d, text in pairs:
        w, gone = WORD.findall(text or ""), set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, text, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def found(df, window, group):
    classed, cut = op.repeats(df, window, group)
    rows = classed.join(cut, ["doc_id", "text_hash"], "left").collect()
    digest = lambda r: hashlib.sha256((r.kept or "").encode()).digest() if r.kept is not None or r.whole else bytes(r.digest)
    return sorted(((r.doc_id, r.n_words, r.n_words if r.whole else r.n_removed or 0, digest(r)) for r in rows), key=str)


def case(seed, window, count=70):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "A", "b", "é", "c-d", "9", "\xa0"])  # noqa: E731  few words: many chance repeats of short windows
    passages = [[word() for _ in range(rng.randrange(1, 4 * window))] for _ in range(8)]
    texts = []
    for _ in range(count):
        w = []
        for _ in range(rng.randrange(4)):
            w += rng.choice([[word() for _ in range(rng.randrange(3 * window))], rng.choice(passages), rng.choice(passages)[1:], ["a"] * rng.randrange(3 * window)])
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    pairs = [(rng.randrange(-5, 200), t) for t in texts]  # ids repeat
    return pairs + [(300 + k, texts[3]) for k in range(30)] + [(None, texts[0]), (None, texts[3]), (1, None), (2, ""), (2, " \n"), pairs[5], pairs[5]]


@pytest.mark.parametrize(("seed", "window", "group"), [(1, 6, 4096), (2, 6, 3), (3, 9, 0), (4, 2, 4096), (5, 50, 10)])
def test_against_all_windows(spark, docs, seed, window, group):
    pairs = case(seed, window)
    wanted = [(d, n, g, hashlib.sha256(k.encode()).digest()) for d, _, n, g, k in brute(pairs, window)]
    assert found(docs(pairs), window, group) == sorted(wanted, key=str)


def test_texts_without_repeats(spark, docs):
    pairs = case(6, 5, 30)
    out = op.without_repeats(docs(pairs).withColumn("_kept", F.lit(1)), 5)
    assert out.columns == [*docs([]).columns, "_kept"]
    wanted = [(d, kept if gone else text) for d, text, _, gone, kept in brute(pairs, 5)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(wanted, key=str)


def test_no_rows(spark, docs):
    assert op.without_repeats(docs([])).collect() == []
    with pytest.raises(ValueError):
        op.repeats(docs([]), 1)


def test_equal_windows_have_their_anchor_at_the_same_place():
    rng = random.Random(7)
    shared = [f"s{rng.randrange(40)}" for _ in range(80)]
    texts = [" ".join([f"x{k}{rng.random()}" for _ in range(rng.randrange(30))] + shared + ["end"] * k) for k in range(6)]
    words = Words(*flat(pa.array(texts)), SPACES, lower=False)
    anchors = op._Anchors(words, 20)
    at = {}
    for a, first, last, doc in zip(anchors.at, anchors.first, anchors.last, anchors.doc):
        assert 0 <= a - last <= a - first <= 10
        for p in range(first, last + 1):
            at[doc, p - words.first[doc]] = a - p
    assert len(at) == sum(max(0, len(t.split()) - 19) for t in texts)
    begins = [next(i for i in range(len(t.split())) if t.split()[i : i + 80] == shared) for t in texts]
    for i in range(61):
        assert len({at[d, b + i] for d, b in enumerate(begins)}) == 1


def test_the_least_of_each_run():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 6, 100).astype(np.uint64)
    for span in (1, 2, 3, 7, 26, 100):
        assert op._least(v, span).tolist() == [i + int(np.argmin(v[i : i + span])) for i in range(100 - span + 1)]
    assert op._least(v[:3], 9).tolist() == []

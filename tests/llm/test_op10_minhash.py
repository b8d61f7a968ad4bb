import math
import random
import re

import numpy as np
import pytest

from ledgerline.llm import op10_minhash as op


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def family(seed, copies, words=60):
    """A text and copies of it with one word changed, so that neighbours are alike at various degrees."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = [" ".join(text)]
    for _ in range(copies):
        other = list(text)
        other[rng.randrange(words)] = f"x{rng.randrange(9)}"
        out.append(" ".join(other))
        if rng.random() < 0.3:
            text = other
    return out


def test_against_all_pairs(docs):
    texts = [t for s in range(6) for t in family(s, 12)] + ["A b C", "a B c", "a b c d", "a b", "A  B", "a", "", None, "  \t\n", "é É ü", "é É ü"]
    pairs = list(enumerate(texts, 100))
    random.Random(1).shuffle(pairs)
    assert rows(op.near_duplicates(docs(pairs))) == brute(pairs)


def test_small_blocks_lose_no_link(docs, monkeypatch):
    pairs = list(enumerate([t for s in range(3) for t in family(s + 50, 40)]))
    monkeypatch.setattr(op, "BAND_BLOCK", 5)
    monkeypatch.setattr(op, "CLUSTER_BLOCK", 4)
    assert rows(op.near_duplicates(docs(pairs))) == brute(pairs)


def test_exact_threshold(docs):
    words = [f"v{k}" for k in range(200)]
    for changed in range(5, 12):
        other = words[: 200 - changed] + [f"z{k}" for k in range(changed)]
        pairs = [(1, " ".join(words)), (2, " ".join(other))]
        assert rows(op.near_duplicates(docs(pairs))) == brute(pairs)


def test_repeated_and_null_ids(docs):
    found = {(r.doc_id, r.component_id, r.kept) for r in op.near_duplicates(docs([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "a b c d")])).collect()}
    assert found == {(5, 5, True), (None, None, True), (7, 5, False)}


def test_empty_table(docs):
    assert op.near_duplicates(docs([])).collect() == []


def test_very_long_text(docs):
    long = " ".join(f"t{k % 7001}" for k in range(400_000))
    pairs = [(1, long), (2, long + " end"), (3, "short one here")]
    assert rows(op.near_duplicates(docs(pairs))) == brute(pairs)


def test_stage_keeps_one_of_each_group_with_all_columns(spark, docs):
    table = docs([(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "other words stay here"), (3, "other words stay here"), (None, "a b c d"), (4, None)])
    kept = op.stage(spark, table, "")
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d"), (1, "a b c d"), (3, "other words stay here"), (4, "")]


@pytest.mark.parametrize("equal", [0.0, 0.5, 0.85, 1.0])
def test_corrected_estimate(equal):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 16, (4000, op.MINIMA), np.uint8)
    b = np.where(rng.random(a.shape) < equal, a, rng.integers(0, 16, a.shape, np.uint8))
    pack = lambda x: (x[:, 0::2] | (x[:, 1::2] << 4)).copy().view(np.uint64)
    assert (op.unlike(pack(a), pack(b)) == (a != b).sum(axis=1)).all()
    assert abs(op.similarity(op.unlike(pack(a), pack(b))).mean() - equal) < 0.01


@pytest.mark.parametrize("percent", [30, 50, 65, 80, 100])
def test_lower_percents_lose_no_link(docs, percent):
    pairs, of = [], 0
    for k in range(30):  # a text and one with a block added, alike by a little over the percent
        text = [f"a{k}_{w}" for w in range(202)]
        pairs += [(of, " ".join(text)), (of + 1, " ".join(text + [f"b{k}_{w}" for w in range(200 * (100 - percent) // percent - k % 3 if percent < 100 else 0)]))]
        of += 2
    got = rows(op.near_duplicates(docs(pairs), percent=percent))
    assert got == brute(pairs, percent) and sum(not kept for *_, kept in got) == 30


@pytest.mark.parametrize("percent", range(1, 101))
def test_chance_of_loss_holds_for_every_percent(percent):
    r, bands, most = op.plan(percent)
    minima, differs = r * bands, (1 - percent / 100) * (1 - 2.0**-op.BITS)
    assert minima * op.BITS % 64 == 0 and (1 - (percent / 100) ** r) ** bands <= op.LOSS
    assert sum(math.comb(minima, k) * differs**k * (1 - differs) ** (minima - k) for k in range(most + 1, minima + 1)) <= op.LOSS * 1.001


@pytest.mark.parametrize("percent", [-1, 0, 101])
def test_percent_out_of_range(docs, percent):
    with pytest.raises(ValueError):
        op.near_duplicates(docs([]), percent=percent)


def test_a_third_copies_and_a_third_near_copies(docs, monkeypatch):
    """Groups far over the blocks, one of exact and one of near copies, beside clean texts."""
    monkeypatch.setattr(op, "BAND_BLOCK", 7)
    monkeypatch.setattr(op, "CLUSTER_BLOCK", 5)
    base = family(7, 0, 80)[0].split()
    near = [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(60)]  # each linked with the base, few with each other
    pairs = list(enumerate([" ".join(base)] + near + ["the same text for all of these rows here"] * 60 + [" ".join(f"c{k}_{w}" for w in range(30)) for k in range(60)]))
    random.Random(3).shuffle(pairs)
    assert rows(op.near_duplicates(docs(pairs))) == brute(pairs)
    moved = [(d + 1000 if d == 0 else d, t) for d, t in pairs]  # the base is no longer the smallest
    assert rows(op.near_duplicates(docs(moved))) == brute(moved)


def test_no_join_of_the_stage_is_a_broadcast(spark):
    """Texts with copies make small files; as broadcast tables they filled the driver."""
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(30 + k % 2))) for k in range(8)], "doc_id long, text string")
    out = op.stage(spark, docs, "")
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1

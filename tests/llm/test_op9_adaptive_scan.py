import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import op9_adaptive_scan as op


def asks():
    return F.col("vec_id") % 20 == 0


def brute(ids, x, k=20, asks=lambda v: v % 20 == 0):
    ids, x = np.asarray(ids), np.asarray(x, np.float64)
    out = {}
    for i in np.flatnonzero([asks(v) for v in ids]):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v], 0, 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int, list int").repartition(3)


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_and_scores_on_the_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got, want, at = found(op.query(spark, small)), brute(ids, x), {v: k for k, v in enumerate(ids)}
    assert set(got) == set(want)
    assert recall(got, want) >= 0.95
    for q, near in got.items():
        assert len(near) == 20 and q not in [v for v, _ in near]
        assert [(-s, v) for v, s in near] == sorted((-s, v) for v, s in near)
        np.testing.assert_allclose([s for _, s in near], [x[at[q]] @ x[at[v]] for v, _ in near], rtol=1e-12, atol=1e-12)


def test_many_lists(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 32))).astype(np.float32)
    got, want = found(op.searched(table(spark, range(3000), x), asks())), brute(range(3000), x)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    x = np.tile(np.array([1, 0, 0], np.float32), (60, 1))
    got = found(op.searched(table(spark, range(60), x), asks(), 5))
    assert {q: [v for v, _ in n] for q, n in got.items()} == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4]}


def test_rows_that_take_no_part(spark):
    ids = [0, 1, 2, 3, 4, 5, 6, 20, 7, 7]
    x = [[1, 2], [3, 4], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 2, 3], [-1, 1], [-1, 1]]
    assert found(op.searched(table(spark, ids, x), asks())) == {0: [(1, 11.0), (7, 1.0)]}


def test_no_rows(spark):
    assert op.searched(table(spark, [], []), asks()).collect() == []
    assert op.searched(table(spark, [0], [[1, 1]]), asks()).collect() == []


def test_scan_drops_no_entry_within_the_bound():
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(2000, 64)).astype(np.float32), rng.normal(size=(30, 64)).astype(np.float32)
    turn = op._rotation(64)
    hits = op.scan(q, x, q @ turn, x @ turn, np.full(30, -np.inf), 10)
    exact = x.astype(np.float64) @ q.T.astype(np.float64)
    kept = [len(set(at) & set(np.argsort(-exact[:, i])[:10])) for i, (at, _) in enumerate(hits)]
    assert np.mean(kept) >= 9.7


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(40, 32))[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 32))).astype(np.float32)


def test_every_answer_comes_from_the_scan(spark, monkeypatch):
    x = clustered(600, 3)
    monkeypatch.setattr(op, "scan", lambda q, *rest: [(np.zeros(0, np.int64), np.zeros(0)) for _ in q])
    assert op.searched(table(spark, range(600), x), asks()).collect() == []


def test_recall_with_a_sample_far_below_the_table(spark, monkeypatch):
    monkeypatch.setattr(op, "SAMPLE", 256)
    x = clustered(6000, 4)
    got, want = found(op.searched(table(spark, range(6000), x), asks())), brute(range(6000), x)
    assert set(got) == set(want) and {len(n) for n in got.values()} == {20}
    assert recall(got, want) >= 0.9


def test_scan_gives_enough_entries_where_it_must():
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(50, 32)).astype(np.float32), rng.normal(size=(4, 32)).astype(np.float32)
    turn = op._rotation(32)
    hits = op.scan(q, x, q @ turn, x @ turn, np.full(4, 1e6), 10, np.array([True, False, True, False]))
    assert [len(at) for at, _ in hits] == [10, 0, 10, 0]


def test_lists_of_the_sample_itself(spark, monkeypatch):
    monkeypatch.setattr(op, "MEANS", 4)
    monkeypatch.setattr(op, "SAMPLE", 64)
    monkeypatch.setattr(op, "LIST_SIZE", 40)
    x = clustered(4000, 5)
    got, want = found(op.searched(table(spark, range(4000), x), asks())), brute(range(4000), x)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_vectors_of_doubles_are_scored_as_they_are(spark):
    x = [[1.0 + k * 1e-12, 0.5] for k in range(40)]  # distinct as doubles, equal as floats
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(op.searched(df, asks(), 5)), brute(range(40), x, 5)
    assert got == {q: [(v, s) for v, s in near] for q, near in want.items()}

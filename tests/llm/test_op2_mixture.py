import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import op2_mixture as op


def reached(rows, names=tuple(op.TARGETS)):
    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r[f"p_{x}"] for x in names] for r in rows])
    w = np.array([r.rate for r in rows])
    assert (w >= 0).all() and np.allclose(p.sum(axis=1), 1)
    return (w * n) @ p / n.sum()


def test_totals_match_the_targets(spark):
    rows = op.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert np.abs(reached(rows) - list(op.TARGETS.values())).max() < 1e-3


@pytest.fixture
def judged(spark):
    def make(n, p):
        return spark.createDataFrame([(k, int(a), [float(x) for x in b]) for k, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, posterior array<double>").repartition(3)

    return make


@pytest.mark.parametrize("most", [None, 1.0])
def test_against_plain_least_squares(judged, most):
    rng = np.random.default_rng(2)
    n, p = rng.integers(0, 400, 200), rng.dirichlet([0.4, 0.4, 0.4], 200)
    target = np.array([0.45, 0.3, 0.1])
    w = np.ones(200)
    a = p * (n / n.sum())[:, None]
    for _ in range(20_000):  # plain projected gradient, to convergence
        w = np.clip(w - p @ (w @ a - target), 0, most)
    moves = op.solve(judged(n, p), target, most, passes=200)
    own = op.rates(p, moves, most)
    assert np.abs(own @ a - target).sum() <= np.abs(w @ a - target).sum() + 2e-3


def test_other_domains_are_fitted_where_one_is_out_of_reach(judged):
    """The first domain falls short at rates of 1 at the most; the others' totals are still brought to theirs."""
    rng = np.random.default_rng(5)
    sure = np.eye(3)[rng.choice(3, 400, p=[0.76, 0.14, 0.10])]
    n, p = rng.integers(1, 400, 400), 0.97 * sure + 0.01
    target = np.array([0.90, 0.08, 0.02])
    w = np.ones(400)
    a = p * (n / n.sum())[:, None]
    for _ in range(50_000):
        w = np.clip(w - p @ (w @ a - target), 0, 1)
    moves = op.solve(judged(n, p), target, 1.0)
    assert np.abs(op.rates(p, moves, 1.0) @ a - w @ a).max() < 4e-3


def test_out_of_reach_ends(judged):
    moves = op.solve(judged([10, 10], [[1, 0], [1, 0]]), np.array([0.5, 0.5]))
    own = op.rates(np.array([[1.0, 0], [1, 0]]), moves, None)
    assert np.allclose(own, 0.5, atol=0.01)


def test_odd_rows(spark, docs):
    pairs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "w " * 300_000), (None, "x")]
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (1, 2), (None, 1), (5, None)], "doc_id long, label int")
    found = op.mixture(docs(pairs), labels).collect()
    assert sorted(r.n_tokens for r in found) == [0, 0, 1, 2, 2, 300_000]
    assert all(np.isfinite(r.rate) and r.rate >= 0 for r in found)
    assert op.mixture(docs([]), labels).collect() == []
    assert len(op.mixture(docs(pairs), labels.where(F.lit(False))).collect()) == 6


def test_stage_keeps_rows_as_they_are(spark, small, documents):
    kept = op.stage(spark, documents, small)
    assert kept.columns == documents.columns
    assert kept.exceptAll(documents).count() == 0 and 0 < kept.count() <= documents.count()


def test_domains(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 1), (None, None), (0, 1)], "quality int, toxic int")
    assert [r.d for r in df.select(op.domain().alias("d")).collect()] == [0, 1, 2, None, 2]

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import op3_quality_fm as op


def auc(score, label):
    order = np.argsort(np.argsort(score))
    good = order[label == 1]
    return (good.mean() - (len(good) - 1) / 2) / (label == 0).sum()


def test_held_out_order(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality is not None}
    found = op.query(spark, folder).collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    own = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert auc(*map(np.array, zip(*own))) > 0.8


def test_pairs_by_the_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    cut = np.array([0, 4, 5, 11])
    index, value = rng.integers(0, 20, 11).astype(np.int32), rng.normal(size=11).astype(np.float32)
    parameters = {"w": rng.normal(size=20).astype(np.float32), "v": rng.normal(size=(20, 3)).astype(np.float32)}
    z, _ = op.margins(parameters, cut, index, value)
    for k in range(3):
        i, x = index[cut[k] : cut[k + 1]], value[cut[k] : cut[k + 1]]
        pairs = sum(x[a] * x[b] * parameters["v"][i[a]] @ parameters["v"][i[b]] for a in range(len(i)) for b in range(a))
        assert abs(z[k] - (x @ parameters["w"][i] + pairs)) < 1e-4


def test_learns_a_pair_that_no_single_word_tells(spark, docs):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for d in range(1200):
        a, b = rng.integers(0, 2, 2)
        rows.append((d, f"{'red' if a else 'blue'} {'ball' if b else 'cube'}"))
        labels.append((d, int(a == b)))
    table = docs(rows)
    parameters = op.learn(table, spark.createDataFrame(labels, "doc_id long, label int"), rounds=40)
    right = dict(labels)
    assert np.mean([r.predicted == right[r.doc_id] for r in op.scores(table, parameters).collect()]) > 0.95


def test_odd_texts_and_labels(spark, docs):
    pairs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "w " * 500_000), (None, "x")]
    labels = spark.createDataFrame([(3, 1), (3, 1), (3, 0), (4, None), (None, 1), (99, 0)], "doc_id long, label int")
    parameters = op.learn(docs(pairs), labels, rounds=2)
    found = op.scores(docs(pairs), parameters).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    none = op.learn(docs(pairs), labels.where(F.lit(False)))
    assert all(abs(r.score - 0.5) < 0.1 for r in op.scores(docs(pairs), none).collect())
    assert op.scores(docs([]), parameters).collect() == []


def test_other_columns_are_no_input(docs):
    parameters = {"w": np.random.default_rng(1).normal(size=op.SIZE).astype(np.float32), "v": np.zeros((op.SIZE, 2), np.float32)}
    a = docs([(1, "some text")])
    b = a.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("other")).withColumn("doc_id", F.lit(77).cast("long"))
    assert [r.score for r in op.scores(a, parameters).collect()] == [r.score for r in op.scores(b, parameters).collect()]

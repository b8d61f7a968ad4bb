import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import op1_language_mixture as op


def has_letter(text):
    return any(c.isalpha() for c in text or "")


def test_held_out_accuracy_and_rules(spark, small, documents):
    found = {r.doc_id: r for r in op.query(spark, small).collect()}
    rows = documents.select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("h")).collect()
    assert set(found) == {r.doc_id for r in rows}
    langs = {r.lang for r in rows if r.lang and not r.h}
    right = []
    for r in rows:
        f = found[r.doc_id]
        assert f.held_out == r.h and 0 <= f.score <= 1
        assert (f.lang_pred == "und") == (not has_letter(r.text)) and f.lang_pred in langs | {"und"}
        assert abs(sum((f.shares or {}).values()) - 1) < 1e-3 or f.lang_pred == "und"
        if r.h and r.lang and has_letter(r.text):
            right.append(f.lang_pred == r.lang)
    assert len(right) > 20 and np.mean(right) > 0.9


def test_labels_of_held_out_rows_change_nothing(documents):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = documents.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in op.languages(x, op.learn(x, ~held)).collect()) for x in (documents, other))
    assert a == b


def test_mixture_is_found(documents):
    """Half of one language and half of another gives both, about evenly."""
    model = op.learn(documents, F.lit(True))
    by_lang = {}
    for r in documents.where("lang is not null and length(text) > 400").select("lang", "text").collect():
        by_lang.setdefault(r.lang, r.text[:400])
    a, b = sorted(by_lang)[:2]
    text = by_lang[a] + "\n" + by_lang[b]
    (row,) = op.languages(documents.limit(1).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")), model).collect()
    assert set(row.shares) == {a, b} and min(row.shares.values()) > 0.3


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(1)
    p, n = rng.random((200, 4)).astype(np.float32), rng.integers(1, 9, 200).astype(np.float32)
    best = max((float(n @ np.log(p @ w)) for w in rng.dirichlet(np.ones(4), 3000)), default=0)
    share, like = op._fit(p, n, np.full(4, 0.25, np.float32), 500)
    assert like >= best - 0.05 and abs(share.sum() - 1) < 1e-3


def test_odd_texts(docs, documents):
    model = op.learn(documents, F.lit(True))
    pairs = [(1, None), (2, ""), (3, "123 !?"), (4, "é"), (5, "word " * 400_000), (6, "\U0001d400"), (5, "again"), (None, "some words")]
    found = op.languages(docs(pairs), model).collect()
    assert len(found) == len(pairs)
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {1, 2, 3}
    assert all(r.score == 0 for r in found if r.lang_pred == "und")


def test_no_model_and_no_rows(docs):
    model = op.learn(docs([(1, "text")]), F.lit(True))  # lang is null throughout
    assert [r.lang_pred for r in op.languages(docs([(1, "text")]), model).collect()] == ["und"]
    assert op.languages(docs([]), model).collect() == []


def test_stage_keeps_rows_as_they_are(spark, documents):
    kept = op.stage(spark, documents, "")
    assert kept.columns == documents.columns
    wanted = sorted(r.doc_id for r in documents.collect() if has_letter(r.text))
    assert sorted(r.doc_id for r in kept.collect()) == wanted


def test_text_of_no_learnt_language_goes(documents, docs):
    model = op.learn(documents, F.lit(True))
    known = documents.where("lang is not null and length(text) > 200").first().text
    table = docs([(1, known), (2, "\u0e01\u0e02\u0e03\u0e04 \u0e05\u0e06\u0e07\u0e08 " * 30), (3, None), (4, "77"), (1, known)])
    assert sorted(r.doc_id for r in op.accepted(table, model).collect()) == [1, 1]


def test_against_em_over_every_set_of_languages():
    """The penalised likelihood of the set that is found is that of the best of all sets, by long EM in double precision."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    for case in range(12):
        p, n = rng.dirichlet(np.full(300, 0.05), 4).T + 1e-6, np.zeros(300)
        share = np.zeros(4)
        share[rng.choice(4, case % 3 + 1, replace=False)] = 1 / (case % 3 + 1)
        np.add.at(n, rng.choice(300, 400, p=(p @ share) / (p @ share).sum()), 1)
        p, n = p[n > 0], n[n > 0]
        cost = op.PENALTY * np.log(n.sum() + 1)
        best = max(op._fit(p[:, own], n, np.full(len(own), 1 / len(own)), 3000)[1] - cost * (len(own) - 1) for k in range(1, 5) for own in map(list, combinations(range(4), k)))
        found, like = op.mixture(p, n, rounds=(500, 500), least=0.0)
        assert like - cost * (len(found) - 1) > best - 0.1

"""Words, components, the registry and the pipeline."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from ledgerline.llm import registry, words
from ledgerline.llm.graph import components
from ledgerline.llm.scratch import free
from tests.oracle import compare


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabAB.é9 ", max_size=12)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for delimiters, pattern in ((words.SPACES, r"[^\x20\x09-\x0D]+"), (words.PUNCTUATION, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = words.Words(*words.flat(pa.array(texts, pa.string())), delimiters)
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for t in texts]
        wanted = [re.findall(pattern, t) for t in low]
        assert found.count.tolist() == [len(w) for w in wanted]
        assert [found.text(i, i + 1).decode() for i in range(len(found.start))] == sum(wanted, [])
        known = {}
        for h, w in zip(found.hash.tolist(), sum(wanted, [])):
            assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)


def test_word_across_slices():
    long = "x" * (words._SLICE + 77)
    found = words.Words(*words.flat(pa.array(["a " + long, long, long[:-1]], pa.large_string())), words.SPACES)
    assert found.hash[1] == found.hash[2] != found.hash[3]


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + k, 501 + k) for k in range(60)] + [(600, k) for k in range(700, 800)] + [(1, 1), (None, 3)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            top[max(p, q)] = min(p, q)
    found = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(found) == sorted((x, find(x)) for x in list(top))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_free_names():
    assert free(["_Row", "__row", "a"], "_row", "_b") == ["___row", "_b"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, small, name):
    compare(registry.QUERIES[name](spark, small), registry.ORACLES[name], small)


def test_registry_has_all_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline(spark, small, documents):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, small).collect()
    seen = [d for r in rows for d, p in zip(r.doc_ids, r.pieces) if p == 0]
    assert len(seen) == len(set(seen)) and set(seen) <= {r.doc_id for r in documents.select("doc_id").collect()}
    kept = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, small)
        assert out.columns == documents.columns and out.exceptAll(kept).count() == 0
        kept = out
    assert sorted(seen) == sorted(r.doc_id for r in kept.select("doc_id").collect())


def test_pipeline_over_no_documents(spark, small, tmp_path, docs):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{small}/{t}.parquet", tmp_path)
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_components_without_a_small_finish(spark, monkeypatch):
    """The distributed steps, with a star that holds a third of all edges."""
    from ledgerline.llm import graph

    monkeypatch.setattr(graph, "SMALL", 0)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + k, 501 + k) for k in range(20)] + [(900, 1000 + k) for k in range(80)]
    found = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    monkeypatch.setattr(graph, "SMALL", 1 << 20)
    assert found == sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert dict(found)[1079] == 900 and dict(found)[520] == 500


def test_lookup_of_a_key_with_a_third_of_all_rows(spark):
    from ledgerline.llm.scratch import looked_up

    rows = [(k, "hot" if k % 3 == 0 else f"k{k % 50}" if k % 7 else None) for k in range(900)]
    df, table = spark.createDataFrame(rows, "id long, key string"), spark.createDataFrame([("hot", 1), ("k1", 2), ("absent", 3)], "key string, v int")
    known = {"hot": 1, "k1": 2}
    left = {r.id: r.v for r in looked_up(df, table, "key", "id").collect()}
    assert left == {i: known.get(k) for i, k in rows}
    assert {r.id for r in looked_up(df, table, "key", "id", "inner").collect()} == {i for i, k in rows if k in known}


def test_sample_fractions_do_not_vanish(spark):
    from ledgerline.llm.scratch import fraction

    df = spark.range(200_000)
    n = df.where(fraction(1e-3, "s", "id")).count()
    assert 120 < n < 290 and df.where(fraction(2.0, "s", "id")).count() == 200_000

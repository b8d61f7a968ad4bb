import hashlib
import random
import re

import pytest

from ledgerline.llm import op8_decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items, window=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d, text in documents:
        w, hit, of = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    of |= found - {"None"}
        sha = hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(of), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "d", "é", "9", "long-er"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 13, 14, 30])))) for k in range(25)] + [(3, "only here twice"), (90, None), (None, "beta beta")]
    documents = []
    for k in range(80):
        text = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            text += ["x"] * rng.randrange(200) + [rng.choice(items)[1] or ""]
        documents.append((k, rng.choice([" ", ", ", "\n"]).join(text)))
    return documents + [(200, None), (201, ""), (202, "..."), (0, "beta")], items


def test_against_all_windows(spark, docs, case):
    documents, items = case
    wanted = brute(documents, items)  # the item without id marks words and is named nowhere
    table = spark.createDataFrame(items, "item_id long, text string")
    assert rows(op.contamination(docs(documents), table)) == wanted
    assert rows(op.contamination(docs(documents), table, pattern_bytes=100)) == wanted  # many passes


def test_long_windows_in_long_text(spark, docs):
    passage = " ".join(f"p{k}" for k in range(40))
    text = "filler " * 300_000 + passage + " filler" * 9
    documents, items = [(1, text), (2, passage), (3, "clean words only")], [(7, passage)]
    assert rows(op.contamination(docs(documents), spark.createDataFrame(items, "item_id long, text string"))) == brute(documents, items)


def test_stage_rule_and_columns(spark, docs, tmp_path):
    passage = " ".join(f"p{k}" for k in range(13))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs([(1, passage + " x" * 247), (2, passage + " x" * 248), (3, "clean"), (4, None)])
    kept = op.stage(spark, table, str(tmp_path))
    many = op.clean(table, spark.createDataFrame([(k, f"{passage} z{k}") for k in range(9)], "item_id long, text string"), pattern_bytes=100)
    assert sorted(r.doc_id for r in many.collect()) == [2, 3, 4] and many.columns == table.columns
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]  # 20 * 13 against 260 and 261 words


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(op.contamination(docs([(1, "a b")]), none)) == brute([(1, "a b")], [])
    assert op.contamination(docs([]), none).collect() == []


def test_patterns_stay_near_their_text():
    import pickle

    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50_000)}" for _ in range(200_000))
    held = len(pickle.dumps(op.Patterns([("a", text)], 13)))
    assert held < 12 * len(text)


def test_passage_of_a_third_of_all_items(spark, docs):
    shared = " ".join(f"s{k}" for k in range(20))
    items = [(k, f"{shared} own{k}" if k % 3 == 0 else f"other words of item number {k}") for k in range(90)]
    documents = [(1, f"before {shared} after"), (2, "other words of item number 5"), (3, "clean")]
    assert rows(op.contamination(docs(documents), spark.createDataFrame(items, "item_id long, text string"))) == brute(documents, items)

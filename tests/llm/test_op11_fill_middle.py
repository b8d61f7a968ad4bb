import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import op11_fill_middle as op

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, salt="42:"):
    text = text or ""
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (n, "plain", None, None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, " ", "\t\n a", "one", "a b  c ", "<P> inside", "x<S>", "<M", "<<P", "ends <S", "é ü\x0b\x0cß 漢字 \U0001f600 end", "a\x00b c", "\xa0 not white space", "w " * 30000, " " * 5000]


def made(spark, docs, pairs, settings=op.Settings()):
    out = op.rearranged(docs(pairs), settings)
    assert {"doc_id", "lang", "digest", "_row"} <= set(out.columns)
    return [tuple(r) for r in out.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output", op.restored("output", "form", settings).alias("back")).collect()]


def test_against_plain_python(spark, docs):
    pairs = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "no id here"), (5, "twice"), (5, "twice"), (-3, "a negative id")]
    for d, text, *rest, back in made(spark, docs, pairs):
        assert tuple(rest) == brute(d, text) and back == (text or "")


def test_all_forms_occur_and_sentinels_may_be_others(spark, docs):
    pairs = [(k, f"some (words) of {k} | here [x") for k in range(200)]
    own = op.Settings(rate=100, suffix_first=40, salt="s", prefix="|p|", suffix=".*", middle="[m")
    rows = made(spark, docs, pairs, own)
    assert {r[3] for r in rows} == {"psm", "spm"} and all(r[-1] == r[1] for r in rows)
    assert 20 < sum(r[3] == "spm" for r in rows) < 140
    assert all(r[3] == "plain" for r in made(spark, docs, pairs, own._replace(rate=0)))


def test_names_that_clash_and_no_rows(spark, docs):
    df = docs([(1, "a b c")]).withColumn("n", F.lit("old")).withColumn("_body", F.lit("kept"))
    row = op.rearranged(df).first()
    assert row.n == 3 and row["_body"] == "kept"
    assert op.rearranged(docs([])).collect() == []


def test_no_python_and_no_shuffle(spark, small):
    plan = op.query(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n<>PSMaé\U0001f600", max_size=30), min_size=1, max_size=20))
def test_round_trip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = op.rearranged(df, op.Settings(rate=100)).select("text", op.restored("output", "form").alias("back"), "n")
    assert all(r.text == r.back and r.n == len(UNIT.findall(r.text)) for r in out.collect())

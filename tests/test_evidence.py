"""Quotes found in texts as written, and the order of the guards."""

from pyspark.sql import functions as F

from ledgerline.operators import evidence as E

BOUNDS = {"nim": (0.5, 8.0, "margin"), "roa": (0.05, 4.0, "return on assets")}


def test_where_a_quote_stands(spark):
    cases = [
        ("The  net,\n interest (margin) was 3.42%.", "NET interest margin was 3.42 %", (6, 34)), ("premargins and margin of 3", "margin of 3", (16, 11)), ("margin of 34", "margin of 3", None), ("é margin \U0001f600 ist ü", "Margin ist Ü", (3, 14)),
        ("a.b c", "a b", (1, 3)), ("text", "", None), ("text", "...", None), (None, "a", None), ("text", None, None), ("a+b (c", "b (c", (3, 4)), ("x\\Ey z", "y z", None),
    ]
    df = spark.createDataFrame([(k, t, q) for k, (t, q, _) in enumerate(cases)], "k int, t string, q string").select("k", E.located(F.col("t"), F.col("q")).alias("x"))
    got = {r.k: None if r.x is None else (r.x.start, r.x.length) for r in df.collect()}
    for k, (text, _, at) in enumerate(cases):
        if at and k == 0:
            at = (text.index("net") + 1, text.index("42") + 2 - text.index("net"))
        if at and k == 3:
            at = (3, len("margin \U0001f600 ist ü"))
        assert got[k] == at, cases[k]


def judged(spark, text, *claims):
    sources = spark.createDataFrame([("s", text), ("s", text), ("t", "other")], "source string, text string")
    rows = [("s", k, *c) for k, c in enumerate(claims)] + [("gone", 99, "nim", "cur", 1.0, "margin was 1.0")]
    return E.judged(sources, spark.createDataFrame(rows, "source string, claim long, key string, period string, value double, quote string"), "source", "text", BOUNDS)


def test_guards_in_order_and_conflicts(spark):
    text = "The margin was 3.42% and the margin was 3.50% while adjusted margin was 3.60%. Return on assets was 1.10% for the card segment. Return on assets was 1.20%."
    out = judged(
        spark, text, ("nim", "cur", 3.42, "margin was 3.42%"), ("nim", "cur", 3.5, "margin was 3.50%"), ("nim", "prior", 3.42, "the margin was 3.42%"), ("nim", "prior", 3.42, "margin was 3.42%"), ("nim", "yoy", 3.6, "adjusted margin was 3.60%"),
        ("roa", "cur", 1.1, "Return on assets was 1.10% for the card segment"), ("roa", "cur", 1.2, "return on assets was 1.20%"), ("nim", "cur", None, "margin was 3.42%"), ("nim", "cur", 3.42, None), ("x", "cur", 1.0, "margin was 3.42%"),
    )
    rows = {r.claim: r.status for r in out.collect()}
    assert rows == {0: "conflict", 1: "conflict", 2: "kept", 3: "kept", 4: "variant", 5: "variant", 6: "kept", 7: "range", 8: "quote", 9: "unknown", 99: "absent"}
    assert {(r.key, r.period): (r.value, r.claims) for r in E.settled(out, "source").collect()} == {("nim", "prior"): (3.42, 2), ("roa", "cur"): (1.2, 1)}


def test_a_text_is_searched_once_a_quote(spark):
    df = spark.createDataFrame([("a b", "b")], "t string, q string").select(E.located(F.col("t"), F.col("q")).alias("x"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?iu)") == 1, plan
    sources = spark.createDataFrame([("s", "a margin \U0001f600 was 3.42%")], "source string, text string")
    claims = spark.createDataFrame([("s", k, "nim", p, 3.42, q) for k, (p, q) in enumerate([("cur", "margin was 3.42"), ("prior", "margin was 3.42"), ("yoy", None)])], "source string, claim long, key string, period string, value double, quote string")
    out = E.judged(sources, claims, "source", "text", BOUNDS)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.claim, r.start, r.length, r.status) for r in out.collect()) == [(0, 3, 17, "kept"), (1, 3, 17, "kept"), (2, None, None, "quote")]

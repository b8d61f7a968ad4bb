"""Grids of two axes, deals by first-in first-out, names against all pairs."""

import math
import random
import time
from collections import deque
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import episodes as E
from ledgerline.operators import knowledge as K
from ledgerline.operators import registry as R


def quarter_ends(first, last):
    out, d = [], first
    while d <= last:
        for m, day in ((3, 31), (6, 30), (9, 30), (12, 31)):
            q = date(d.year, m, day)
            if first <= q <= last:
                out.append(q)
        d = date(d.year + 1, 1, 1)
    return out


@pytest.mark.parametrize("max_age", [None, 120])
def test_grid_against_every_pair(spark, max_age):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        period = date(2020, 1, 1) + timedelta(days=rng.randrange(1400))
        rows.append((rng.choice("abc"), period, period + timedelta(days=rng.randrange(500)), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([None, 5.0])))
    rows += [(None, date(2021, 1, 1), date(2021, 1, 1), 1.0, 1.0), ("d", None, date(2021, 1, 1), 1.0, 1.0), ("e", date(2020, 3, 31), date(2020, 3, 31), 4.0, None)]
    days, first, last = ["2021-03-31", "2022-07-15", "2025-01-01"], date(2020, 6, 30), date(2022, 12, 31)
    wanted = set()
    for key in "abcde":
        for known in map(date.fromisoformat, days):
            newest = {}
            for k, p, f, v, w in rows:
                if k == key and p and f <= known:
                    newest[p] = max(newest.get(p, (date.min,)), (f, v is not None, v or 0, w is not None, w or 0))
            live = {p: x for p, x in newest.items() if x[1] or x[3]}
            for q in quarter_ends(first, last):
                if (p := max((p for p in live if p <= q), default=None)) and (max_age is None or (q - p).days <= max_age):
                    x = live[p]
                    wanted.add((key, known, q, p, x[0], x[2] if x[1] else None, x[4] if x[3] else None))
    df = spark.createDataFrame(rows, "k string, period date, filed date, v double, w double")
    got = K.known_grid(df.repartition(3), "k", "period", "filed", ["v", "w"], days, str(first), str(last), max_age)
    assert {tuple(r) for r in got.collect()} == wanted and got.count() == len(wanted)


def test_grid_shuffles_once(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), date(2020, 1, 1), 1.0)], "k string, period date, filed date, v double")
    plan = K.known_grid(df, "k", "period", "filed", ["v"], ["2021-01-01"], "2020-03-31", "2021-03-31")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_revisions_and_per_share(spark):
    rows = [("a", d, date(2020, 3, 31), v) for d, v in ((1, 1.0), (2, 1.0), (3, 2.0))]
    grid = spark.createDataFrame(rows, "k string, known_on int, quarter date, v double")
    assert [(r.known_on, r.revised) for r in K.revisions(grid, "k", "v").orderBy("known_on").collect()] == [(1, False), (2, False), (3, True)]
    shares = spark.createDataFrame([("a", 1, date(2020, 3, 31), 4.0), ("a", 2, date(2020, 3, 31), 0.0), ("b", 1, date(2020, 3, 31), 4.0)], "k string, known_on int, quarter date, n double")
    got = {(r.k, r.known_on): r.value for r in K.per_share(grid, shares, "k", "v", "n").collect()}
    assert got == {("a", 1): 0.25, ("a", 2): None, ("a", 3): None, ("b", 1): None}


@pytest.mark.parametrize("again", [0, 2])
def test_deals_against_a_queue(spark, again):
    rng = random.Random(again)
    rows = [(k, rng.choice("AB"), rng.choice("xy"), rng.randrange(60), rng.choice(["opening", "opening", "completion", "termination", "news", None])) for k in range(300)]
    wanted = []
    for pair in {(a, b) for _, a, b, _, _ in rows}:
        queue, before = deque(), None
        for k, _, _, day, kind in sorted((r for r in rows if (r[1], r[2]) == pair and r[4] in ("opening", "completion", "termination")), key=lambda r: (r[3], r[0])):
            if kind == "opening":
                if again and before and before[0] == "opening" and day - before[1] <= again:
                    last[2] += 1
                else:
                    last = [k, day, 0]
                    queue.append(last)
            elif queue:
                o, opened, repeats = queue.popleft()
                wanted.append((*pair, o, opened, repeats, k, day, "completed" if kind == "completion" else "terminated"))
            before = (kind, day)
        wanted += [(*pair, *x, None, None, "open") for x in map(tuple, queue)]
    df = spark.createDataFrame(rows + [(900, None, "x", 1, "opening"), (901, "A", "x", None, "opening")], "event int, a string, b string, day int, kind string")
    start = F.to_date(F.lit("2020-01-01"))
    got = E.episodes(df.withColumn("at", F.date_add(start, F.col("day"))), ["a", "b"], "at", "kind", "event", again)
    days = lambda c: F.datediff(c, start)
    rows = got.withColumns({"opened": days("opened"), "resolved": days("resolved")}).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))


def names(rng, count):
    words = ["FIRST", "NATIONAL", "FARMERS", "MERCHANTS", "BANCORP", "LOUISIANA", "OF", "INC", "VALLEY", "BANCSHARES", "RIVER", "TRUST"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))[: rng.randrange(3, 40)] for _ in range(count)]


def linked(a, b):
    short = min(len(a), len(b))
    if short >= 8 and (a in b or b in a):
        return True
    n = math.ceil(short * 0.8)
    return short >= 12 and a[:n] == b[:n]


def test_links_against_all_pairs(spark):
    rng = random.Random(4)
    left, right = names(rng, 500), names(rng, 500)
    of = lambda xs, k: spark.createDataFrame([*enumerate(xs), (None, "FIRST NATIONAL"), (9999, None)], f"{k} int, name string")
    l, r = of(left, "a").repartition(3), of(right, "b")
    spelt = lambda xs: [x[0] for x in spark.createDataFrame([(x,) for x in xs], "n string").select(R.collapsed(F.col("n"))).collect()]
    x, y = spelt(left), spelt(right)
    wanted = {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if linked(a, b)}
    got = [tuple(r) for r in R.name_links(l, r, "a", "name", "b", "name").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 100


def test_corroboration(spark):
    cases = [
        ("U.S. Bancorp", "U S BCORP", "x", True), ("First Bancorp (NC)", "FIRST BCORP", "x", True), ("Example Bancorp Inc of Louisiana", "EXAMPLE BCORP INC OF LA", "x", True),
        ("First Financial Bankshares", "OTHER HOLDING", "First Financial Bank", False), ("Exchange Bank", "DOYLE TRUST", "Exchange Bank", True), ("Alpha Trust", None, "Alpha Bank", True), ("First National", "", "First Trust", False), (None, "A", "B", False), ("", "", "", False),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "name string, holder string, bank string")
    assert [r[0] for r in df.select(R.corroborated(F.col("name"), F.col("holder"), F.col("bank"))).collect()] == [c[3] for c in cases]


def test_matches_need_their_state(spark):
    right = spark.createDataFrame([(1, "ALPHA BANCORP", ["MO"], 9.0), (2, "ALPHA BANCORP", ["LA", None], 5.0), (3, "BETA HOLDINGS", ["TX"], 1.0), (4, "GAMMA BANK", ["TX"], 2.0), (5, "GAMMA BANK", ["TX"], 2.0), (6, "DELTA NATIONAL HOLDING", ["TX"], None)], "cert int, holder string, states array<string>, size double")
    left = spark.createDataFrame([("a", "Alpha Bancorporation", ["LA"]), ("b", "Alpha Bancorp", ["NY"]), ("c", "Alpha Bancorp", []), ("d", "Beta Holding", None), ("e", "Gamma Bank", ["TX"]), ("f", "Delta National", ["TX"]), ("g", "Nobody", ["TX"])], "ticker string, name string, states array<string>")
    got = {r.ticker: (r.cert, r.phase, r.status) for r in R.matched(left, right, "ticker", "cert").collect()}
    assert got == {"a": (2, 1, "matched"), "b": (None, 1, "state"), "c": (None, 1, "ambiguous"), "d": (3, 1, "matched"), "e": (None, 1, "tied"), "f": (6, 2, "matched"), "g": (None, None, "none")}


def test_equal_names_are_linked_once(spark, monkeypatch):
    seen, within = [], R._within
    monkeypatch.setattr(R, "_within", lambda s, l, a, b: seen.append((s.count(), l.count())) or within(s, l, a, b))
    left = spark.range(40).select(F.col("id").alias("a"), F.element_at(F.array(F.lit("Alpha Beta Gamma"), F.lit("Delta Epsilon")), (F.col("id") % 2 + 1).cast("int")).alias("name"))
    left = left.union(left.where("a = 1").withColumn("name", F.lit("Alpha Beta Gamma")))  # two names of one key
    right = spark.range(30).select(F.col("id").alias("b"), F.lit("Alpha Beta Gamma Inc").alias("name")).union(spark.createDataFrame([(3, "Alpha Beta Gamma")], "b long, name string"))
    got = [tuple(r) for r in R.name_links(left, right, "a", "name", "b", "name").collect()]
    assert seen == [(2, 2), (2, 2)] and len(got) == len(set(got))
    assert set(got) == {(a, b) for a in range(40) for b in range(30) if a % 2 == 0 or a == 1}


def test_rows_of_equal_names_and_states_are_matched_once(spark):
    left = spark.range(60_000).select(F.when(F.col("id") > 0, F.col("id")).alias("ticker"), F.lit("Alpha Bancorp").alias("name"), F.array(F.lit("MO")).alias("states"))
    right = spark.range(5_000).select(F.col("id").alias("cert"), F.lit("ALPHA BANCORP").alias("holder"), F.array(F.lit("MO")).alias("states"), F.col("id").cast("double").alias("size"))
    before = time.monotonic()  # 3e8 pairs of rows, but one of names
    got = {(r.cert, r.phase, r.status): r["count"] for r in R.matched(left, right, "ticker", "cert").groupBy("cert", "phase", "status").count().collect()}
    assert time.monotonic() - before < 60
    assert got == {(4_999, 1, "matched"): 59_999, (None, None, "none"): 1}


def test_linked_rows_are_expanded_from_lists(spark, monkeypatch):
    """Rows of linked names are made by two explodes of lists, above every join and shuffle, whatever the lists' lengths."""
    monkeypatch.setattr(R, "LIST", 7)
    monkeypatch.setattr(R, "CHUNK", 3)
    left = spark.range(40).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, "Alpha Bancorp").otherwise("Gamma Trust").alias("name"))
    right = spark.range(30).select(F.col("id").alias("b"), F.when(F.col("id") < 22, "ALPHA BANCORP INC").otherwise("Other").alias("name"))
    links = R.name_links(left, right, "a", "name", "b", "name")
    above = links._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert above.count("Generate explode") == 4 and above.count("Repartition") == 2
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) == 440 and set(got) == {(a, b) for a in range(0, 40, 2) for b in range(22)}

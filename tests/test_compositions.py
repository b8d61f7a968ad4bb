"""Value searches against every subset, stages, hierarchies with circles, walks that tie or don't."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import capitalwalk as W
from ledgerline.operators import compositions as C


def brute(values, total, tolerance, floor):
    place = [k for k, v in enumerate(values) if v > 0]
    subsets = [s for n in range(2, len(place) + 1) for s in itertools.combinations(place, n)]
    fits = [s for s in subsets if abs(sum(values[k] for k in s) - total) <= tolerance]
    if not fits:
        return "none", [], "none", []
    sole = ("sole", list(fits[0])) if len(fits) == 1 else ("several", [])
    most = max(map(len, fits))
    best = [s for s in fits if len(s) == most]
    if len(best) > 1:
        return "several", [], *sole
    inside = [sum(values[k] for k in s) for n in range(2, most + 1) for s in itertools.combinations(best[0], n)]
    for k in set(place) - set(best[0]):
        if not any(abs(x - values[k]) <= max(values[k] * 1e-4, floor) for x in inside):
            return "inconsistent", [], *sole
    return "finest", list(best[0]), *sole


def test_search_against_every_subset():
    rng, seen = random.Random(2), set()
    for _ in range(400):
        parts = [rng.randrange(1, 60) for _ in range(rng.randrange(2, 6))]
        values = parts + [sum(rng.sample(parts, rng.randrange(1, len(parts) + 1))) for _ in range(rng.randrange(4))] + [rng.choice([0, -3, 59])] * rng.randrange(2)
        rng.shuffle(values)
        total = sum(parts) + rng.choice([0, 0, 0, 1])
        got = C.searched([float(v) for v in values], total, 0.25, 0.25)
        assert got == brute(values, total, 0.25, 0.25)
        seen |= {got[0], got[2]}
    assert seen == {"finest", "several", "inconsistent", "none", "sole"}


def test_forty_members_within_the_budget():
    rng = random.Random(5)
    parts = [float(rng.randrange(10**9, 10**11)) for _ in range(26)]
    sums = [sum(parts[k : k + 2]) for k in range(14)]
    began = time.perf_counter()
    status, chosen, _, _ = C.searched(parts + sums, sum(parts), 0.5, 0.5)
    assert status == "finest" and chosen == list(range(26))
    assert C.searched([7.0] * 40, 140.0, 0.5)[0] == "exhausted"  # too many ways to fit
    assert C.searched([float(k) for k in range(1, 42)], 5.0, 0.1)[0] == "exhausted"  # too many members
    assert time.perf_counter() - began < 60


def test_a_group_too_large_to_search_is_refused(spark):
    rows = [(1, k, 10.0) for k in range(60)] + [(2, 0, 1.0), (2, 1, 2.0), (2, 2, 3.0), (3, 0, 0.0), (4, 0, 5.0)]
    df, totals = spark.createDataFrame(rows, "g int, m int, v double"), spark.createDataFrame([(1, 600.0), (2, 3.0), (3, 1.0), (5, 1.0)], "g int, total double")
    got = sorted(tuple(r) for r in C.finest_partition(df, totals, "g", "m", "v", 0.1).where("status != 'finest'").collect())
    assert got == [(1, "exhausted", None, None)]
    assert {(r.m, r.v) for r in C.finest_partition(df, totals, "g", "m", "v", 0.1).where("g = 2").collect()} == {(0, 1.0), (1, 2.0)}
    assert C.finest_partition(df.limit(0), totals, "g", "m", "v").collect() == []


def test_parents_go_also_over_absent_steps_and_circles(spark):
    members = spark.createDataFrame([("a", x) for x in "rpqz"] + [("b", "r"), ("b", "q")], "g string, m string")
    links = spark.createDataFrame([("a", "r", "x"), ("a", "x", "y"), ("a", "y", "p"), ("a", "y", "p"), ("a", "p", "p"), ("a", "q", "w"), ("a", "w", "q"), ("b", "q", None)], "g string, parent string, child string")
    got = sorted(tuple(r) for r in C.without_parents(members, links, "g", "m").collect())
    assert got == [("a", "p"), ("a", "z"), ("b", "q"), ("b", "r")]  # q is below itself


def test_stages(spark):
    def stage(rows, total, links=()):
        df = spark.createDataFrame([(1, m, label, float(v)) for m, label, v in rows], "g int, m string, label string, v double")
        out = C.resolved(df, spark.createDataFrame([(1, float(total))], "g int, total double"), spark.createDataFrame([(1, *x) for x in links], "g int, parent string, child string"), "g", "m", "label", "v", 0.01, 0.5, 1.0)
        rows = out.collect()
        assert len({r.stage for r in rows}) == 1
        return rows[0].stage, sorted(r.m for r in rows if r.m)

    assert stage([("a", "A", 700), ("b", "B", 300), ("c", "C", 300)], 1000) == ("equal", ["a", "b"])
    assert stage([("a", "A", 700), ("a2", "A", 699), ("b", "B", 300)], 1000) == ("equal", ["a", "b"])
    assert stage([("a", "A", 600), ("b", "B", 400), ("p", "P", 1000)], 1000, [("p", "x"), ("x", "a")]) == ("linked", ["a", "b"])
    assert stage([("a", "A", 611), ("b", "B", 389), ("c", "C", 500), ("p", "P", 1000)], 1500) == ("finest", ["a", "b", "c"])
    assert stage([("t", "T", 917), ("u", "U", 322), ("x", "X", 410), ("y", "Y", 133)], 1239) == ("sole", ["t", "u"])
    assert stage([("a", "A", 5), ("b", "B", 6)], 1000) == ("unresolved", [])


def test_only_totals_that_cover_the_book(spark):
    rows = [("f", 2025, "loans", 900.0, 5), ("f", 2025, "leases", 900.0, 6), ("f", 2024, "modified", 40.0, 3), ("g", 2024, "small", 4.0, 2)]
    df = spark.createDataFrame(rows, "filing string, period int, candidate string, total double, rows int")
    got = {(r.filing, r.period): (r.candidate, r.covers) for r in C.covering(df, "filing", "period", F.col("total")).collect()}
    assert got == {("f", 2025): ("leases", True), ("f", 2024): ("modified", False), ("g", 2024): ("small", True)}


@pytest.fixture
def walked(spark):
    def of(target, **given):
        names = {k: W.CONCEPTS[k][0] for k in W.CONCEPTS}
        rows = [("f", 1, f"us-gaap:{names[k]}", {}, float(v), i) for i, (k, v) in enumerate(given.items())]
        rows += [("f", 1, "us-gaap:StockholdersEquity", {"axis": "member"}, 1.0, -1), ("f", 1, "us-gaap:Goodwill", {}, 77.0, 99)]
        steps = W.steps(spark.createDataFrame(rows, "filing string, period int, concept string, dims map<string,string>, value double, place int"), "filing")
        facts = [("f", 1, "holdco", "default", v) for v in target] + [("f", 1, "bank", None, 5.0), ("f", 1, "holdco", "fuzzy", 6.0)]
        targets = W.targets(spark.createDataFrame(facts, "filing string, period int, basis string, confidence string, value double"), "filing")
        return W.walk(steps, targets, "filing", 0.01, 1.0).first()

    return of


def test_walks(walked):
    given = {"total_equity": 1000, "preferred": 100, "goodwill": 200, "other_intangibles": 50, "aoci": -80}
    r = walked([650.0], **given)
    assert (r.status, r.built, r.residual, r.basis) == ("included", 650, 0, "default")
    assert walked([730.0], **given).status == "excluded"
    r = walked([700.0], **given)
    assert (r.status, r.built, r.residual) == ("unreconciled", 730, -30)  # the nearer treatment; nothing is plugged
    assert walked([650.0, 651.0], **given).basis == "ambiguous" and walked([650.0, 651.0], **given).status == "incomplete"
    assert walked([650.0, 650.0], **given).status == "included"
    assert walked([650.0], goodwill=200).status == "incomplete"


def test_the_newest_filing_that_ties_speaks_for_a_period(spark):
    rows = [(1, 10, "2024", "included"), (1, 10, "2025", "unreconciled"), (1, 11, "2025", "incomplete"), (1, 11, "2024", "incomplete")]
    df = spark.createDataFrame(rows, "company int, period int, filed string, status string")
    assert {(r.period, r.filed) for r in W.stitched(df, "company", "filed").collect()} == {(10, "2024"), (11, "2025")}

"""Hand-computed cases and properties of the operators."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import numbers
from ledgerline.operators import asof, estimates, filings, geo, markets, ownership, peers, timeseries, valuation
from ledgerline.operators.screen import Spec, screen
from ledgerline.plans import catalogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


DEPOSITS = [(11111, 1, 400.0), (11111, 2, 300.0), (11111, 3, 200.0), (11111, 4, 100.0)] + [(22222, b, v) for b, v in zip(range(1, 7), (200.0, 100.0, 150.0, 150.0, 200.0, 200.0))]
DEPOSITS += [(33333, 1, 100.0), (33333, 2, 50.0), (33333, 3, 450.0), (33333, 4, 400.0), (44444, 1, 500.0), (44444, 3, 500.0), (66666, 1, 300.0), (66666, 2, 0.0), (66666, 3, 700.0)]


def test_merger_screen(spark):
    df = spark.createDataFrame(DEPOSITS, "market long, bank long, deposits double")
    found = {r.market: (round(r.pre), round(r.post), round(r.delta), r.flagged) for r in markets.pro_forma(df, 1, 2).collect()}
    assert found == {11111: (3000, 5400, 2400, True), 22222: (1750, 2150, 400, True), 33333: (3750, 3850, 100, False)}


def test_concentration(spark):
    df = spark.createDataFrame([(1, 1, 400.0), (1, 2, 300.0), (1, 3, 200.0), (1, 4, 100.0), (2, 1, 5.0), (3, 1, None), (3, 2, 1.0), (4, 1, 0.0)], "market long, bank long, deposits double")
    assert {r.market: r.hhi and round(r.hhi, 6) for r in markets.hhi(df).collect()} == {1: 3000, 2: 10000, 3: None, 4: None}
    bands = [one(spark, numbers.hhi_band(F.lit(x))) for x in (1499.99, 1500.0, 2500.0, 2500.01)]
    assert bands == ["unconcentrated", "moderate", "moderate", "high"]
    assert [one(spark, numbers.merger_flag(F.lit(a), F.lit(b))) for a, b in ((1800, 500), (3850, 200), (1801, 201))] == [False, False, True]


def test_hazen_percentiles(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 1.2), ("C", 1.4), ("D", 1.6), ("E", 2.0), ("F", None)], "ticker string, roaa double").withColumn("scope", F.lit(1))
    got = {r.ticker: r.p for r in df.select("ticker", peers.hazen(["scope"], "roaa").alias("p")).collect()}
    assert got == {"A": 10, "B": 30, "C": 50, "D": 70, "E": 90, "F": None}


def test_screen_counts_missing_apart(spark):
    df = spark.createDataFrame([("JPM", 12.0), ("BAC", 9.0), ("WFC", None)], "ticker string, cet1 double").withColumn("scope", F.lit(1))
    got = {r.ticker: r.outcome for r in screen(df, [Spec("absolute", "cet1", "<", 10.0)], ["scope"]).collect()}
    assert got == {"JPM": "fail", "BAC": "keep", "WFC": "nodata"}
    assert set(r.outcome for r in screen(df, [], ["scope"]).collect()) == {"keep"}


@pytest.mark.parametrize("points, wanted", [((0, 0, 1, 0), 69.0934), ((60, 0, 60, 1), 34.5464), ((40, -75, 40.1, -75), 6.9093), ((40, -75, 40, -75.1), 5.2929), ((41.5, -75, 41.5, -75.05), 2.5874)])
def test_miles(spark, points, wanted):
    assert one(spark, geo.miles(*(F.lit(float(x)) for x in points))) == pytest.approx(wanted, abs=1e-3)


def test_points_within_a_radius(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(150)] + [(200, 40.0, -75.0), (201, 40.13, -75.18), (202, 10.0, 179.99), (203, 10.0, -179.99), (204, 89.95, 10.0), (205, 89.93, -170.0), (206, -89.99, 5.0), (207, -90.0, 99.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")

    def miles(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_MILES * math.asin(min(1, math.sqrt(h)))

    for radius in (10.0, 400.0):
        found = sorted((r.id, r.other) for r in geo.within(df, df, radius).collect())
        assert found == sorted((a[0], b[0]) for a in rows for b in rows if miles(a, b) <= radius)


def test_nearest_of_many_points_at_one_place(spark):
    many = spark.range(30_000).select("id", F.lit(40.0).alias("lat"), F.lit(-75.0).alias("lng"))
    df = many.union(spark.createDataFrame([(40_000, 40.1, -75.0), (40_001, 40.1, -75.0), (40_002, 50.0, 0.0)], "id long, lat double, lng double"))
    before = time.monotonic()  # 9e8 pairs of points, but two places
    got = geo.nearest(df, df, 3, 30.0).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("x"))
    found = {r.id: [tuple(y) for y in r.x] for r in got.collect()}
    assert time.monotonic() - before < 60
    assert len(found) == 30_002 and found[0] == [(1, 1), (2, 2), (3, 3)] and found[2] == [(1, 0), (2, 1), (3, 3)] and found[29_999] == [(1, 0), (2, 1), (3, 2)]
    assert found[40_000] == [(1, 40_001), (2, 0), (3, 1)] and 40_002 not in found


def test_nearest_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(k, 40 + rng.randrange(6) / 10, -75 + rng.randrange(6) / 10) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    pairs = df.toDF("id", "lat", "lng").crossJoin(df.toDF("other", "lat2", "lng2")).where("id != other").withColumn("m", F.round(geo.miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 9))
    near = {}
    for r in pairs.where("m <= 12").collect():
        near.setdefault(r.id, []).append((r.m, r.other))
    wanted = {(k, n + 1, o) for k, x in near.items() for n, (_, o) in enumerate(sorted(x)[:4])}
    assert {(r.id, r.rank, r.other) for r in geo.nearest(df, df, 4, 12.0).collect()} == wanted


def test_places_within_are_judged_once(spark, monkeypatch):
    seen, places = [], geo._places
    monkeypatch.setattr(geo, "_places", lambda l, r, radius: seen.append((l.count(), r.count())) or places(l, r, radius))
    monkeypatch.setattr(geo, "LIST", 4)
    df = spark.range(30).select("id", (40 + F.col("id") % 2 * 0.1).alias("lat"), F.lit(-75.0).alias("lng"))
    got = [(r.id, r.other, r.miles) for r in geo.within(df, df, 10.0, 3).collect()]
    assert seen == [(2, 2)] and sorted(got) == [(a, b, 6.909 if (a + b) % 2 else 0.0) for a in range(30) for b in range(30)]


def test_consensus(spark):
    df = spark.createDataFrame([("T", "2024", "a", "eps", 1.20, "$"), ("T", "2024", "b", "eps", 1.36, "$"), ("T", "2024", "a", "ni", 14500.0, "$M"), ("T", "2024", "b", "ni", 14.6, "$B"), ("T", "2024", "c", "ni", 1.0, "?")], "ticker string, period string, firm string, metric string, value double, unit string")
    got = {r.metric: (r.mean, r.n) for r in estimates.consensus(df).collect()}
    assert got["ni"] == (pytest.approx(14550), 2) and got["eps"][1] == 2


def test_holders(spark):
    df = spark.createDataFrame([("I", k, 8096, v, 1.0) for k, v in enumerate((500.0, 300.0, 200.0))] + [("I", 9, 8095, 9e9, 1.0)], "issuer string, holder long, qi long, shares double, value_usd double")
    r = ownership.concentration(df).first()
    assert (r.top5, r.top10, round(r.hhi)) == (100, 100, 3800)
    weights = spark.createDataFrame([("E", 60.0, 10.0), ("E", 40.0, 20.0)], "fund string, w double, pe double")
    assert ownership.harmonic(weights, "fund", "w", "pe", 0.0, 1000.0).first().blend == pytest.approx(12.5)


def test_valuation(spark):
    assert one(spark, valuation.terminal(F.lit(1.04), F.lit(10.0), F.lit(4.0))) == pytest.approx(17.3333, abs=1e-4)
    assert one(spark, valuation.terminal(F.lit(1.04), F.lit(4.0), F.lit(4.0))) is None
    assert one(spark, valuation.present_value(F.array(F.lit(1.0), F.lit(1.0)), F.lit(10.0))) == pytest.approx(1.7355372)
    assert one(spark, valuation.warranted(F.lit(12.0), F.lit(10.0), F.lit(4.0))) == pytest.approx(1.3333, abs=1e-4)


def test_windows_never_sum_a_gap(spark):
    df = spark.createDataFrame([(1, 10 + k, v) for k, v in enumerate((8.469, 7.510, 8.584, 9.074))] + [(2, q, 1.0) for q in (10, 11, 13, 14)] + [(3, 10 + k, v) for k, v in enumerate((1.0, None, 1.0, 1.0))], "bank long, qi long, v double")
    got = {(r.bank, r.qi): r.ttm for r in timeseries.full_window_sum(df, "bank", "qi", "v").collect() if r.ttm is not None}
    assert got == {(1, 13): pytest.approx(33.637)}


def test_quarters_sum_to_the_year(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(b, q, float(rng.randrange(100))) for b in range(5) for q in range(8000, 8012)], "bank long, qi long, v double")
    out = timeseries.decumulated(timeseries.year_to_date(df, "bank", "qi", "v"), "bank", "qi", "ytd").collect()
    assert all(r.flow == pytest.approx(r.v) for r in out)


def test_as_of_never_looks_ahead(spark):
    rng = random.Random(2)
    facts = sorted({(rng.randrange(6), rng.randrange(100)) for _ in range(120)})
    probes = [(rng.randrange(7), rng.randrange(100), k) for k in range(200)]
    f = spark.createDataFrame([(k, t, f"{k}-{t}") for k, t in facts], "key long, at long, v string")
    got = {r.p: r.v for r in asof.backward(spark.createDataFrame(probes, "key long, at long, p long"), f, "key", "at").collect()}
    for key, at, p in probes:
        known = [t for k, t in facts if k == key and t <= at]
        assert got[p] == (f"{key}-{max(known)}" if known else None)


def test_subset_that_reconciles():
    assert filings.reconciling_subset([500.0, 300.0, 200.0, 70.0], 1000.0, 0.5) == [0, 1, 2]
    assert filings.reconciling_subset([5.0, 5.0, 1.0], 6.0, 0.1) is None  # two ways
    assert filings.reconciling_subset([1.0, 2.0], 9.0, 0.1) is None
    assert filings.merged_order([["a", "c"], ["a", "b", "c", "d"]]) == ["a", "b", "c", "d"]


def test_row_order_takes_every_label(spark, tmp_path):
    rng = random.Random(6)
    parts = [(p, f"name {p % 35}") for p in range(60)]
    lines = [(o, n, rng.randrange(60), rng.randrange(3), f"{rng.randrange(1996, 2000)}-03-01") for o in range(300) for n in range(3)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, day string")
    df.withColumn("l_shipdate", F.col("day").cast("timestamp_ntz")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    wanted, longest = [], 0
    for company in range(3):
        out = []
        for year in range(1999, 1995, -1):
            labels = []
            for name in (dict(parts)[p] for _, _, p, s, day in sorted(lines) if s == company and int(day[:4]) == year):
                if name not in labels:
                    labels.append(name)
            longest, before = max(longest, len(labels)), -1
            for label in labels:
                if label in out:
                    before = out.index(label)
                else:
                    before += 1
                    out.insert(before, label)
        wanted += [(company, k, label) for k, label in enumerate(out)]
    assert longest > 12
    found = catalogue.QUERIES["statement_row_order"](spark, str(tmp_path)).collect()
    assert sorted((r.company, r.position, r.label) for r in found) == wanted


def test_turnover_and_its_quartiles(spark):
    held = {"a": (100.0, 100.0), "b": (100.0, 110.0), "c": (100.0, 150.0), "d": (100.0, 300.0)}
    rows = [("I", k, q, v, 1.0) for k, vs in held.items() for q, v in enumerate(vs)] + [("J", "z", q, v, 1.0) for q, v in enumerate((100.0, 150.0, 100.0))] + [("J", "y", 1, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "issuer string, holder string, qi long, shares double, value_usd double")
    got = {(r.issuer, r.holder): (r.turnover and round(r.turnover, 4), r.category) for r in ownership.turnover(df).collect()}
    assert got == {("I", "a"): (0, "Very Low"), ("I", "b"): (9.5238, "Low"), ("I", "c"): (40, "Moderate"), ("I", "d"): (100, "High"), ("J", "z"): (42.8571, None), ("J", "y"): (None, None)}


def test_cycle_beta_runs_from_the_last_move_the_other_way(spark):
    def cycle(rates, values):
        df = spark.createDataFrame([("s", k, r, v) for k, (r, v) in enumerate(zip(rates, values))], "s string, t long, r double, v double")
        return timeseries.cycle_beta(df, "s", "t", "v", "r").first()

    c = cycle([5.00, 5.25, 5.50, 5.51, 5.25, 5.00, 5.00], [1.0, 1.1, 1.3, 1.5, 1.7, 1.6, 1.2])
    assert (c.cycle_start, c.cycle_end, c.direction) == (2, 6, "down") and c.beta == pytest.approx(0.2)
    assert cycle([5.0, 5.1, 5.0], [1.0, 2.0, 3.0]) is None  # moved by less than 0.15
    assert cycle([1.0, 1.25, 1.5], [1.0, 1.1, 1.2]).cycle_start == 0


def test_nearest_with_many_ties(spark):
    df = spark.createDataFrame([(1, k, 7.0) for k in range(1, 101)] + [(2, 1, 1.0), (2, 2, 2.0), (2, 3, 3.0), (2, 4, 3.0)], "scope long, bank long, size double")
    got = {}
    for r in peers.nearest(df, ["scope"], "bank", "size", 5).collect():
        got.setdefault((r.scope, r.bank), {})[r["rank"]] = r.peer
    assert [got[1, 90][k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [got[1, 3][k] for k in range(1, 6)] == [1, 2, 4, 5, 6]
    assert [got[2, 2][k] for k in range(1, 4)] == [1, 3, 4]


def test_growth_looks_past_gaps(spark):
    df = spark.createDataFrame([("b", q, v) for q, v in zip((1, 2, 3, 9, 10, 11, 12, 20), (1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0))], "bank string, qi long, v double")
    assert [r.growth_pct for r in timeseries.year_on_year(df, "bank", "qi", "v").orderBy("qi").collect()] == [None] * 7 + [100.0]


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    from ledgerline.sources import sinks

    a, b = (sinks.Table(spark, f"file://{tmp_path}/t") for _ in range(2))
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    a.publish(one)
    seen = b.version()
    a.publish(one.union(one), after=seen)
    with pytest.raises(sinks.VersionTaken):
        b.publish(one, after=seen)
    assert b.version() == 2 and b.read().count() == 2 and b.read(1).count() == 1


def test_a_story_ends_days_after_its_stored_row(spark):
    from ledgerline.operators import events

    def kept(rows):
        df = spark.createDataFrame([(k, "T", s, d) for k, (s, d) in enumerate(rows)], "event_id long, ticker string, source string, day int")
        df = df.withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
        return sorted((r.event_id, r.copies) for r in events.deduplicated(df, ["ticker"], ["wire", "site"]).collect())

    assert kept([("site", d) for d in range(30)]) == [(0, 6), (6, 6), (12, 6), (18, 6), (24, 6)]
    assert kept([("site", 0), ("wire", 3), ("site", 8), ("site", 9)]) == [(1, 3), (3, 1)]  # the better copy takes the row and its time


def test_stories_of_some_sources_only(spark):
    """Filings with one generic headline stay apart, as do events without time; keys alone and in runs give what a plain walk gives."""
    from ledgerline.operators import events

    rng = random.Random(6)
    rows = [(k, rng.choice("ABCDEFGH") * rng.choice([1, 1, 2, 3]), rng.choice(["wire", "site", "sec_8k", None]), rng.choice([None, *range(40)])) for k in range(400)]
    rows += [(900, "Z", "sec_8k", 1), (901, "Z", "sec_8k", 1), (901, "Z", "sec_8k", 1), (902, None, "wire", 1), (903, None, "wire", 2)]
    df = spark.createDataFrame(rows, "event_id long, ticker string, source string, day int").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
    got = sorted((r.event_id, r.copies) for r in events.deduplicated(df.repartition(3), ["ticker"], ["wire", "site"], eligible=["wire", "site"]).collect())
    stories, wanted = {}, [(e, 1) for e, _, s, d in rows if (s not in ("wire", "site") or d is None) and e != 901] + [(901, 2)]
    for e, t, s, d in sorted((r for r in rows if r[2] in ("wire", "site") and r[3] is not None), key=lambda r: (str(r[1]), r[3], r[0])):
        last = stories.setdefault(t, [])
        if not last or d > last[-1][0] + 5:
            last.append([d, s, e, 1])
        else:
            last[-1][3] += 1
            if s == "wire" and last[-1][1] == "site":
                last[-1][:3] = d, s, e
    assert got == sorted(wanted + [(e, n) for x in stories.values() for _, _, e, n in x])


def test_repeated_probes_are_answered_each(spark):
    from ledgerline.operators import asof

    left = spark.createDataFrame([("k", "2024-01-05", "one"), ("k", "2024-01-05", "two"), ("k", "2024-01-05", "two"), ("k", "2024-02-01", "none")], "key string, at string, name string")
    right = spark.createDataFrame([("k", "2024-01-05", 1), ("k", "2024-01-08", 2), ("k", "2024-01-09", 3)], "key string, ts string, v int")
    got = asof.newest_within(left.withColumn("at", F.to_date("at")), right.withColumn("ts", F.to_date("ts")), "key", "at", 3, "ts", ["v"]).collect()
    assert sorted((r.name, r.v) for r in got) == [("one", 2), ("two", 2), ("two", 2)]


def test_places_over_a_whole_table(spark):
    from ledgerline.operators.order import placed

    rng = random.Random(3)
    rows = [(k, rng.choice([None, *range(9)])) for k in range(500)]
    got = {r.k: r.p for r in placed(spark.createDataFrame(rows, "k long, v int"), [F.desc_nulls_first("v"), F.asc("k")], "p").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert got == {k: n for n, (k, _) in enumerate(order, 1)}


def test_feed_takes_copies_out_after_the_limit(spark):
    from ledgerline.operators import events

    rows = [
        (1, "T", "wire", "news", "Same headline", 10, []), (2, "T", "agg", "news", "same HEADLINE!", 9, []), (3, "T", "wire", "m_and_a", "Deal one", 8, ["alpha", "beta"]), (4, "T", "sec", "m_and_a", "Filing", 7, ["alpha", "beta", "x"]),
        (5, "T", "wire", "m_and_a", "Deal two", 6, ["alpha", "gamma"]), (6, "T", "wire", "m_and_a", "Deal one again", 1, ["alpha", "beta"]), (7, "T", "agg", "news", "a", 5, []), (8, "T", "agg", "news", "b", 4, []), (9, "T", "sec", "news", "Filing", 3, []), (10, "T", "sec", "news", "Filing", 2, []), (11, "T", "wire", "news", "old", 0, []),
    ]
    df = spark.createDataFrame(rows, "event_id long, ticker string, source string, kind string, headline string, day int, tokens array<string>").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
    got = [r.event_id for r in events.universe_feed(df, 10, ["sec"], ["agg"], 1).orderBy("position").collect()]
    assert got == [1, 3, 5, 7, 9, 10, 6]
    timeless = df.withColumn("ts", F.when(F.col("event_id") != 4, F.col("ts")))
    timeless = timeless.withColumn("ts", F.when(F.col("event_id") != 6, F.col("ts")))
    got = [r.event_id for r in events.universe_feed(timeless, 20, ["sec"], ["agg"], 1).orderBy("position").collect()]
    assert got == [1, 3, 5, 7, 9, 10, 11]  # deals without time, last, are copies of deal one


def test_facts_hand_cases(spark):
    from ledgerline.operators import facts

    def rows(*given):
        df = spark.createDataFrame([(1, "C", "USD", *r) for r in given], "cik long, concept string, unit string, start string, end string, val double, form string, filed string")
        return df.withColumns({c: F.col(c).cast("date") for c in ("start", "end", "filed")})

    day = F.lit("2024-03-01").cast("date")
    ytd = [("2023-01-01", "2023-03-31", 10.0, "10-Q", "2023-05-01"), ("2023-01-01", "2023-06-30", 25.0, "10-Q", "2023-08-01"), ("2023-01-01", "2023-09-30", 45.0, "10-Q", "2023-11-01")]
    year = ("2023-01-01", "2023-12-31", 70.0, "10-K", "2024-02-20")
    q = {str(r.end): r.val for r in facts.quarters(facts.spans(rows(*ytd, year))).collect()}
    assert q == {"2023-03-31": 10, "2023-06-30": 15, "2023-09-30": 20, "2023-12-31": 25}
    assert facts.trailing_year(rows(*ytd, year), day).first()[2:] == (70, "quarters")
    assert facts.trailing_year(rows(ytd[0], year), day).first()[2:] == (70, "annual")
    assert facts.trailing_year(rows(*ytd), day).first().value is None
    restated = ("2023-01-01", "2023-03-31", 11.0, "10-Q", "2024-01-01")
    assert facts.trailing_year(rows(*ytd, year, restated), day).first().value == 70 and facts.quarters(facts.spans(rows(ytd[0], restated))).first().val == 11
    skipped = [("2023-07-01", "2023-09-30", 0.08, "10-Q", "2023-11-01"), ("2022-10-01", "2022-12-31", 0.08, "10-K", "2023-02-01"), ("2022-04-01", "2022-06-30", 0.08, "10-Q", "2022-08-01")]
    assert facts.trailing_dividend(rows(*skipped), day).first().value == pytest.approx(0.16)  # the window ends at 2023-09-30
    assert facts.latest(rows(("2019-01-01", "2019-12-31", 5.0, "10-K", "2020-02-01")), day).first().value is None


def test_timeline_hand_cases(spark):
    from ledgerline.operators import timelines

    assert one(spark, timelines.reserve_coverage(F.lit(2.0), F.lit(1.0), F.lit(9.0))) == 200 and one(spark, timelines.reserve_coverage(F.lit(2.0), F.lit(0.0), F.lit(9.0))) == 9
    assert one(spark, timelines.organic_need(F.lit(-5.0))) == 0 and one(spark, timelines.organic_need(F.lit(50.0))) == 5
    assert one(spark, timelines.share(F.lit(0.0), F.lit(10.0))) == 0 and one(spark, timelines.share(F.lit(1.0), F.lit(0.0))) is None
    df = spark.createDataFrame([("b", 8000 + k, None, 1e8, 2e9, 100.0) for k in range(4)] + [("c", 8000 + 3 * k, 1.0, 1.0, 1.0, 100.0) for k in range(4)], "bank string, qi long, dividends double, buybacks double, income double, shares double")
    ttm = {(r.bank, r.qi): r for r in timelines.capital_return_ttm(timelines.capital_return(df)).collect()}
    b, c = ttm["b", 8003], ttm["c", 8009]
    assert (b.dividends_ttm, b.buybacks_ttm, b.returned_ttm, b.income_ttm) == (None, 4e8, 4e8, 8e9) and c.returned_ttm is None  # quarters apart


def test_rule_hand_cases(spark):
    from ledgerline.functions import rules

    text = lambda f, *xs: [one(spark, f(F.lit(x))) for x in xs]
    assert text(rules.release_kind, "Acme to acquire Beta", "Q3 results", "Acme joins X", "hello", None) == ["m_and_a", "earnings", "executive_change", "press_release", "press_release"]
    assert text(rules.material_regulatory, "OCC fined Acme", "Consent order", "Acme opens branch", None) == [True, True, False, False]
    assert text(rules.own_release, "Acme Announces Results", "Analyst: Acme announces", None) == [True, False, False]
    assert text(rules.safe_url, "https://chat.whatsapp.com/x", "https://example.com", "https://notx.com") == [False, True, True]
    assert text(lambda x: rules.report_quarter(x.cast("date")), "2025-11-10", "2026-02-10", "2026-05-10") == ["2025Q3", "2025Q4", "2026Q1"]
    assert one(spark, rules.credit_regime(F.lit(float("nan")))) == "n/a" and one(spark, rules.quote_move(F.lit(10.0), F.lit(10.5), F.lit(9.0))) is None
    assert one(spark, rules.units_scale(F.lit("x - shares in Thousands, $ in Millions"))) == 1e6


def test_deposit_cost_of_a_quarter(spark):
    from ledgerline.operators import rowkinds

    df = spark.createDataFrame([("b", 8000, 14000.0, 1_500_000.0), ("b", 8001, 30000.0, 1_520_000.0), ("b", 8003, 60000.0, 1_520_000.0)], "bank string, qi long, cost double, balance double")
    got = {r.qi: r.rate for r in rowkinds.statement(df, [("rate", "dep_rate", "cost", "balance")]).collect()}
    assert got[8001] == pytest.approx(4.2105, abs=1e-4) and got[8003] is None
    assert rowkinds.terms("A+B-C") == [(1, "A"), (1, "B"), (-1, "C")]


def test_implied_rate_by_closed_form(spark):
    # a flow that only grows: price = flow / (k - g), so k = flow / price + g
    value = lambda k: valuation.terminal(F.lit(2.0), k, F.lit(3.0))
    assert one(spark, valuation.implied_rate(F.lit(25.0), value)) == pytest.approx(11.0, abs=1e-6)
    assert one(spark, valuation.implied_rate(F.lit(1e9), value)) is None


def test_registry_is_whole():
    from ledgerline.functions import metrics

    assert len(metrics.directions()) == 159 and len(metrics.filed()) == 91


def test_search_says_how_it_ended():
    assert filings.searched_subset([5.0, 5.0, 1.0], 6.0, 0.1) == ("several", []) and filings.searched_subset([1.0, 2.0], 9.0, 0.1) == ("none", [])
    many = [float(k) for k in range(1, 40)]
    assert filings.searched_subset(many, 390.5, 0.1, budget=1000) == ("exhausted", [])
    assert filings.searched_subset([500.0, 300.0, 200.0, 70.0], 1000.0, 0.5, None) == ("unique", [0, 1, 2])


def test_names_that_share_only_common_words(spark):
    from ledgerline.operators import entity

    rng = random.Random(9)
    vocabulary = [f"W{k}" for k in range(12)]
    names = sorted({" ".join(["COMMON"] + rng.sample(vocabulary, rng.randrange(1, 5))) for _ in range(60)})
    l = spark.createDataFrame(list(enumerate(names[:30])), "id long, name string")
    r = spark.createDataFrame([(k, n, float(k % 5)) for k, n in enumerate(names[20:])], "other long, name string, weight double")
    for least in (0.34, 0.5, 0.8):
        wanted = set()
        for i, a in enumerate(names[:30]):
            x = set(a.split())
            met = [(-len(x & set(b.split())) / len(x | set(b.split())), -float(k % 5), k) for k, b in enumerate(names[20:])]
            wanted |= {(i, k) for s, _, k in sorted(m for m in met if -m[0] >= least)[:2]}
        assert {(g.id, g.other) for g in entity.fuzzy_join(l, r, least, 2).collect()} == wanted


def test_other_currencies_do_not_displace_dollars(spark):
    from ledgerline.operators import facts

    ends = [("2023-01-01", "2023-03-31"), ("2023-04-01", "2023-06-30"), ("2023-07-01", "2023-09-30"), ("2023-10-01", "2023-12-31")]
    rows = [(1, "C", u, a, b, v, "10-Q", f) for a, b in ends for u, v, f in (("USD", 100.0, "2024-01-10"), ("EUR", 90.0, "2024-02-10"))]
    rows += [(2, "D", u, a, b, v, "10-Q", "2024-01-10") for a, b in ends for u, v in (("USD", 8.0), ("USD/shares", 0.25))]
    df = spark.createDataFrame(rows, "cik long, concept string, unit string, start string, end string, val double, form string, filed string")
    df = df.withColumns({c: F.col(c).cast("date") for c in ("start", "end", "filed")})
    day = F.lit("2024-03-01").cast("date")
    assert {r.cik: r.value for r in facts.trailing_year(df, day).collect()} == {1: 400, 2: 32}
    assert {r.cik: r.value for r in facts.trailing_dividend(df, day).collect()} == {1: 400, 2: 1}
    assert {(r.cik, r.val) for r in facts.series(df).collect()} == {(1, 100), (2, 0.25)}
    assert {(r.cik, r.direct) for r in facts.fiscal(df, ["C", "D"]).collect()} == {(1, 100), (2, 8)}


def test_implied_rate_mentions_its_value_once_a_step(spark):
    df = spark.range(1).select(F.lit(2.0).alias("marked")).select(valuation.implied_rate(F.lit(0.2), lambda k: F.col("marked") / k).alias("r"))
    plan = df._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert plan.count("marked#") == 3  # one in the search, one at each end of the bracket
    assert df.first().r == pytest.approx(10.0, abs=1e-6)

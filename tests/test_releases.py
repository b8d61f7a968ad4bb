"""Companies in headlines and printed figures: nulls, ties, repeated rows and empty tables."""

from pyspark.sql import functions as F

from ledgerline.functions import releases
from ledgerline.operators import tagging

NAMES = [("ALPHA", "A"), ("BETA BANK", "B"), ("ALPHA BETA", "AB")]


def found(spark, heads, names=NAMES, shared=()):
    h = spark.createDataFrame(heads, "k int, t string, c string")
    n = spark.createDataFrame(names, "name string, ticker string")
    s = spark.createDataFrame(list(shared), "name string, ticker string, cues array<string>")
    return sorted((r.k, r.ticker) for r in tagging.subjects(h, "k", "t", "c", n, s).collect())


def test_headlines(spark):
    heads = [(1, "Alpha Beta Bank", None), (2, None, None), (3, "", "(NYSE: A)"), (4, "alpha, alpha and Beta Bank", None), (4, "alpha, alpha and Beta Bank", None), (5, "Inc. Co.", None)]
    assert found(spark, heads) == [(1, "AB"), (4, "A"), (4, "B")]  # in 1, Beta Bank overlaps the longer name; 4 is there twice
    assert found(spark, heads, []) == [] and found(spark, []) == []


def test_shared_names_take_the_single_best(spark):
    shared = [("GAMMA", "GA", ["OHIO"]), ("GAMMA", "GB", ["MAINE"]), ("GAMMA", "GC", None)]
    heads = [(1, "Gamma results", "of Ohio"), (2, "Gamma results", "of Ohio and Maine"), (3, "Gamma results", "GC of Ohio"), (4, "Results", "GA Ohio Gamma"), (5, "Gamma results", None)]
    assert found(spark, heads, NAMES, shared) == [(1, "GA"), (3, "GC")]


def test_normalised_names(spark):
    df = spark.createDataFrame([("Alpha Bank, Inc. /MD/",), ("M & T Holdings Co.",), ("Inc",), ("",), (None,)], "n string")
    assert [r.x for r in df.select(tagging.normalised(F.col("n")).alias("x")).collect()] == ["ALPHA BANK", "M & T", "", "", None]


def test_printed_figures_without_text(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    for f in (releases.period_end, releases.table_rows, lambda t: releases.number_in_quote(t, F.lit(1.0))):
        assert not any(r.x for r in df.select(f(F.col("t")).alias("x")).collect())
    assert [r.x for r in spark.range(1).select(releases.row_values(F.array().cast("array<string>")).alias("x")).collect()] == [[]]
    none = spark.range(1).select(releases.entity_basis(F.create_map().cast("map<string,string>")).alias("x")).first().x
    assert (none.basis, none.confidence) == ("holdco", "default")


def test_no_name_is_one_task_and_no_runs_are_broadcast(spark):
    h = spark.range(640).selectExpr("CAST(id AS int) AS k", "'Alpha news' AS t", "CAST(NULL AS string) AS c")
    runs = tagging._runs(h, "k", "t", "c", 6).where("name = 'ALPHA'")
    names = spark.createDataFrame([("ALPHA", "A", False)], "name string, ticker string, shared boolean")
    met = tagging._met(runs, names, ["name"], "k")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "salt" in plan
    assert met.count() == 640 and "salt" not in met.columns
    assert found(spark, [(1, "First United Kingdom deal", None), (2, "First United deal", None)], [("FIRST UNITED", "F")]) == [(2, "F")]

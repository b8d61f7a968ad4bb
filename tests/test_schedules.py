"""Codes of schedules: prefixes, missing against zero, totals that don't hold, written-in lines."""

from ledgerline.operators import schedules as S
from ledgerline.plans.catalogue import QUERIES

SCHEMA = "bank int, period int, mdrm string, data_type string, int_data long, float_data double, str_data string"


def reports(spark, rows):
    return spark.createDataFrame([(b, 1, m, k, v if k == "int" else None, v if k == "float" else None, v if k in ("str", None) else None) for b, m, k, v in rows], SCHEMA)


def test_prefixes(spark):
    rows = [(1, "RCFD3493", "int", 5), (1, "rcon3493", "int", 9), (1, "RCON3494", "float", float("nan")), (1, "RCON3495", "str", "7"), (2, "RCOA3493", "int", -4), (2, "RCFA3493", "int", -9), (2, "RCON3493", "int", 100), (2, None, "int", 3)]
    df = reports(spark, rows)
    assert {(r.bank, r.code): r.value for r in S.concepts(df, S.BALANCE, largest=True).collect()} == {(1, "3493"): 9, (2, "3493"): 100}
    assert {(r.bank, r.code): r.value for r in S.concepts(df, S.CAPITAL).collect()} == {(1, "3493"): 5, (2, "3493"): -9}


def test_matrix_of_past_due_loans(spark):
    rows = [(1, "RCFDF172", "int", 3), (1, "RCFD3493", "int", 0), (1, "RCFD1594", "int", 50), (1, "RCFD1406", "int", 10), (2, "RCON1606", "int", 8), (2, "RCON1406", "int", 7), (3, "RCON1607", "int", 1), (4, "RIAD4141", "int", 1)]
    got = {(r.bank, r.category, r.status): (r.value, r.tied) for r in S.past_due(reports(spark, rows)).collect()}
    assert len(got) == 3 * 12 * 3
    assert got[1, "construction", "pd30_89"] == (3000, None) and got[1, "farmland", "pd30_89"] == (0, None) and got[1, "heloc", "pd30_89"] == (None, None)
    assert got[1, "other", "pd30_89"] == (7000, True)  # agricultural loans are within it
    assert got[2, "other", "pd30_89"] == (None, False) and got[2, "total", "pd30_89"] == (7000, False)
    assert got[3, "other", "pd90_plus"] == (None, None)


def test_capital_lines(spark):
    rows = [(1, "RCFAP859", "int", 100), (1, "RCFAP742", "int", 90), (1, "RCFAP841", "int", 5), (2, "RCFAP742", "int", 1)]
    got = {r.bank: r for r in S.capital_lines(reports(spark, rows), {"cet1": "P859", "common": "P742", "goodwill": "P841"}, {"intangibles": [(-1, "goodwill")]}, {"rest": ("cet1", ["common", "intangibles"])}).collect()}
    assert (got[1].intangibles, got[1].rest) == (-5000, 15000) and (got[2].intangibles, got[2].rest) == (None, None)


def test_written_in_lines(spark):
    rows = [(1, "RIAD4141", "int", 0), (1, "RIAD4464", "int", 2), (1, "TEXT4464", None, " Armoured cars "), (1, "RIAD4467", "int", 3), (1, "TEXT4467", None, "  "), (1, "TEXT4468", None, "no amount")]
    got = [(r.line, r.label, r.value) for r in S.itemised(reports(spark, rows), {"legal": "4141"}, ["4464", "4467", "4468"]).orderBy("place").collect()]
    assert got == [("legal", "legal", 0), ("written_in", "Armoured cars", 2000), ("written_in", "Write-in 4467", 3000)]
    assert S.itemised(reports(spark, []), {"legal": "4141"}, []).collect() == []


def test_schedules_are_one_hash_grouping_dealt_over_all_tasks(spark):
    """A row ordered by a struct makes a sort of all rows; a small shuffle of reports makes one task of all their codes."""
    for name in ("capital_schedule", "past_due_matrix"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan, name


def test_reports_without_figures_and_codes_filed_twice(spark):
    rows = [(1, "RCFA3493", "str", "7"), (1, "RCFAP742", "float", float("nan")), (2, "RCONP742", "int", 8), (2, "RCOAP742", "int", 6), (2, "rcoap742", "int", 5), (2, "RCFAP742", "float", float("nan")), (3, "RCFD1594", "int", 2), (3, "RCFDF173", "int", 4)]
    df = reports(spark, rows)
    assert {(r.bank, r.code): r.value for r in S.concepts(df.where("bank = 2"), S.CAPITAL).collect()} == {(2, "P742"): 5}
    assert [(r.bank, r.common, r.also) for r in S.capital_lines(df, {"common": "P742", "also": "P742"}, {}, {}).collect()] == [(2, 5000, 5000)]
    got = {(r.bank, r.category, r.status): (r.value, r.tied) for r in S.past_due(df).collect()}
    assert len(got) == 36 and got[3, "construction", "pd30_89"] == (4000, None) and got[3, "other", "pd30_89"] == (None, None)

"""Rendered statements: lines of a page, owners of periods, folding of rewordings."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import rendered as S
from ledgerline.plans import catalogue
from ledgerline.sources import pages


def row(label, *values, ref=""):
    link = f" onclick=\"top.Show.showAR( this, 'defref_{ref}', window )\"" if ref else ""
    return f"<tr><td class='pl'><a{link}>{label}</a></td>" + "".join(f"<td class='num'>{v}</td>" for v in values) + "</tr>"


def page(*rows, dates=("Dec. 31, 2025", "Dec. 31, 2024"), title="Balance Sheets - USD ($) $ in Millions"):
    return f"<table><tr><th class='tl'>{title}</th>" + "".join(f"<th>{d}</th>" for d in dates) + "</tr>" + "".join(rows) + "</table>"


@pytest.fixture
def lines(spark):
    def of(**given):
        df = spark.createDataFrame([(k, v) for k, v in given.items()], "page string, html string")
        return S.lines(pages.table_cells(df, "page", "html"), "page")

    return of


def shown(df):
    return {r.label: (r.kind, r.header, [(str(f.period), f.value) for f in r.figures or []]) for r in df.collect()}


def test_lines_of_a_page(lines):
    html = page(
        row("Assets", "", ""), row("Loans", "$ 1,200", "(3)", ref="Loans"), row("Shares (in shares)", "5", "6"), row("Units", "7", "8", ref="Units"), row("EPS per share", "1.5", ""),
        row("[1]", "9", "9"), row("Total liabilities and equity", "1", "2"), row("Total assets of others", "3", "4"),
    ) + "<table id='defref_Units'><tr><td>Data Type:</td><td>xbrli:sharesItemType</td></tr></table>"
    got = shown(lines(a=html))
    assert got == {
        "Assets": ("monetary", True, []), "Loans": ("monetary", False, [("2025-12-31", 1.2e9), ("2024-12-31", -3e6)]), "Shares (in shares)": ("shares", False, [("2025-12-31", 5), ("2024-12-31", 6)]),
        "Units": ("shares", False, [("2025-12-31", 7), ("2024-12-31", 8)]), "EPS per share": ("pershare", False, [("2025-12-31", 1.5), ("2024-12-31", None)]), "Total liabilities and equity": ("monetary", False, [("2025-12-31", 1e6), ("2024-12-31", 2e6)]),
    }


def test_odd_pages(lines):
    spacer = "<table><tr><th class='tl'>T</th><th>Dec. 31, 2025</th></tr><tr><td>Cash</td><td class='th'></td><td>4</td></tr><tr><td>X</td><td class='th'></td><td></td></tr></table>"
    got = lines(none=None, empty="", undated="<table><tr><th>T</th></tr><tr><td>a</td><td>1</td></tr></table>", spacer=spacer)
    assert [(r.page, r.label, r.figures[0].value) for r in got.collect()] == [("spacer", "Cash", 4)]  # what follows the last figure goes


def test_owners_of_periods(lines):
    new = page(row("Cash", "10", ""), row("Loans", "20", "19"))
    old = page(row("Cash", "8", "7"), row("Gold", "1", "1"), dates=("Dec. 31, 2024", "Dec. 31, 2023"))
    rows = lines(**{"2025": new, "2024": old}).withColumn("company", F.lit(1))
    out = S.stitched(rows, "company", "page", 5).orderBy("position").collect()
    got = {r.label: [None if v.value is None else v.value / 1e6 for v in r["values"]] for r in out}
    assert got == {"Cash": [10, 8, 7], "Gold": [None, None, 1], "Loans": [20, 19, None]}  # the hole in Cash is filled, Gold isn't
    assert [r.label for r in out] == ["Cash", "Gold", "Loans"]
    assert len(S.stitched(rows, "company", "page", 2).first()["values"]) == 2


def fold(*rows):
    out = S.folded([{"label": lab, "header": vs is None, "section": sec, "ref": ref, "values": [] if vs is None else [{"period": k, "value": v} for k, v in enumerate(vs)]} for lab, vs, sec, ref in rows])
    return [(r["label"], [v["value"] for v in r["values"]]) for r in out]


def test_rewordings_fold_and_false_friends_do_not():
    assert fold(("Net income", [2, None], 0, ""), ("Net income (loss)", [None, 1], 0, "")) == [("Net income", [2, 1])]
    assert fold(("Net income", [2, 1], 0, ""), ("Net income of noncontrolling interests", [None, 1], 0, "")) == [("Net income", [2, 1]), ("Net income of noncontrolling interests", [None, 1])]
    assert fold(("Total Acme shareholders' equity", [None, 5], 0, ""), ("Total Acme Bancshares Inc shareholders' equity", [6, None], 0, "")) == [("Total Acme Bancshares Inc shareholders' equity", [6, 5])]
    assert fold(("Assets", [None, 5], 0, ""), ("Assets, Total", [6, None], 0, "")) == [("Assets, Total", [6, 5])]
    assert fold(("Basic", [1, None], 0, ""), ("Basic earnings", [None, 2], 0, "")) == [("Basic", [1, None]), ("Basic earnings", [None, 2])]  # one word links only figures per share
    assert fold(("Basic per share", [1, None], 0, ""), ("Basic earnings per share", [None, 2], 0, "")) == [("Basic per share", [1, 2])]
    assert fold(("Old name", [None, 2], 0, "us_X"), ("New words", [1, None], 0, "us_X")) == [("New words", [1, 2])]
    assert fold(("Old name", [3, 2], 0, "us_X"), ("New words", [1, None], 0, "us_X")) == [("Old name", [3, 2]), ("New words", [1, None])]
    blank = ("Interest and fees on loans", [None, None], 4, "")
    assert fold(("Loans, including fees", [1, 2], 4, ""), blank) == [("Loans, including fees", [1, 2])]
    assert len(fold(("Loans, including fees", [1, 2], 9, ""), blank)) == 2  # another section
    assert fold(("Section", None, 0, ""), ("Common stock, shares issued not disclosed", [1, 1], 0, ""), ("Section", None, 0, "")) == [("Section", []), ("Section", [])]


def test_folded_statement(lines):
    new = page(row("Revenues", "", ""), row("High orders", "10", "9"), row("High orders and returns", "1", "1"))
    old = page(row("Revenues", "", ""), row("High orders of the Company", "8", "7"), row("High orders and returns", "1", "1"), dates=("Dec. 31, 2023", "Dec. 31, 2022"))
    rows = lines(**{"2025": new, "2023": old}).withColumn("company", F.lit("c"))
    out = S.consolidated(S.stitched(rows, "company", "page", 5), "company").orderBy("position", F.desc("period")).collect()
    assert [(r.position, r.label, r.value and r.value / 1e6) for r in out] == [
        (0, "Revenues", None), (1, "High orders", 10), (1, "High orders", 9), (1, "High orders", 8), (1, "High orders", 7), (2, "High orders and returns", 1), (2, "High orders and returns", 1), (2, "High orders and returns", 1), (2, "High orders and returns", 1)
    ]


def test_joins_of_lines_are_no_broadcasts(spark, tmp_path):
    """Cells that repeat make small files, which Spark took for small tables and sent whole to the driver."""
    schema = "page string, tab int, row int, col int, width int, height int, head boolean, style string, ref string, name string, text string"
    spark.createDataFrame([("a", 0, 0, 0, 1, 1, True, "tl", "", "", "Sheet")], schema).write.parquet(str(tmp_path / "cells"))
    lines = S.lines(spark.read.parquet(str(tmp_path / "cells")), "page").withColumn("c", F.lit(1)).withColumn("filing", F.lit(2))
    lines.write.parquet(str(tmp_path / "lines"))
    for df in (lines, S.stitched(spark.read.parquet(str(tmp_path / "lines")), "c", "filing")):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_ruled_where_they_are_read(spark):
    """Pages give the lines that their cells give, without a shuffle; blanks before the end of a tag don't send a page to the parser."""
    given = [
        ("a", page(row("Assets", "", ""), row("Loans", "$ 1,200", "(3)", ref="Loans"), row("[1]", "9", "9"), row("Units", "7", "8", ref="Units"), row("Total liabilities and equity", "1", "2"), row("Others", "3", "4")) + "<table id='defref_Units'><tr><td>Data Type:</td><td>xbrli:sharesItemType</td></tr></table>"),
        ("b", None), ("c", "<table><tr><th>T</th></tr><tr><td>a</td><td>1</td></tr></table>"), ("d", page("<tr><td>only a label</td></tr>")), ("e", page("<tr><td>x</td><td class='th z'></td><td>4<td>5<td>6</tr>", row("Liabilities and equity, total"))),
    ]
    df = spark.createDataFrame(given, "page string, html string")
    one, cells = S.page_lines(df, "page", "html"), S.lines(pages.table_cells(df, "page", "html"), "page")
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    got = sorted(one.collect(), key=str)
    assert got == sorted(cells.collect(), key=str) and [(r.page, r.label) for r in sorted(got)] == [("a", "Assets"), ("a", "Loans"), ("a", "Units"), ("a", "Total liabilities and equity"), ("e", "x")]  # what follows the last figure goes


def test_rendered_queries_shuffle_once_and_twice(spark):
    """Orders by customer, and lines by company."""
    for name, most in (("rendered_lines", 1), ("rendered_statements", 2)):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == most


def test_statements_are_stitched_and_folded_in_one_pass(spark):
    figures = lambda y, *vs: [(datetime.date(y - k, 12, 31), v) for k, v in enumerate(vs)]
    given = [
        ("c", 2025, 1, "assets|", "Assets", True, "", None), ("c", 2025, 2, "cash", "Cash", False, "us_C", figures(2025, 10.0, None)), ("c", 2025, 3, "new loans", "New loans", False, "us_L", figures(2025, 20.0, 19.0)),
        ("c", 2024, 2, "cash", "Cash 1", False, "us_C", figures(2024, 8.0, 7.0)), ("c", 2024, 4, "old loans", "Old loans", False, "us_L", figures(2023, 5.0)), ("c", 2024, 5, "gold", "Gold", False, "", figures(2024, 1.0, 1.0)),
        ("none", 2024, 1, "assets|", "Assets", True, "", None), (None, 2024, 1, "cash", "Cash", False, "", figures(2024, 1.0)),
    ]
    df = spark.createDataFrame(given, "company string, filing int, row int, line string, label string, header boolean, ref string, figures array<struct<period:date,value:double>>")
    one = sorted(S.statements(df, "company", "filing", 3).collect(), key=str)
    assert one == sorted(S.consolidated(S.stitched(df, "company", "filing", 3), "company").collect(), key=str)
    assert {(r.label, r.period.year if r.period else None): r.value for r in one} == {
        ("Assets", None): None, ("Cash", 2025): 10, ("Cash", 2024): 8, ("Cash", 2023): 7, ("New loans", 2025): 20, ("New loans", 2024): 19, ("New loans", 2023): 5, ("Gold", 2025): None, ("Gold", 2024): None, ("Gold", 2023): 1
    }

"""Tables of releases: grids, headers and what is refused."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import reltables as T
from ledgerline.sources import pages

SPECS = {"nim": (r"net interest margin", "%", 0.5, 8.0), "eps": (r"diluted eps", "$", 0.01, 60.0), "revenue": (r"total revenue", "$K", 1e3, 1e12), "shares": (r"diluted shares", "#", 10.0, 1e12)}


@pytest.fixture
def read(spark):
    def of(*tables):
        df = spark.createDataFrame([(k, f"<p>text</p><table>{t}</table>" if t is not None else None) for k, t in enumerate(tables)], "k long, html string")
        return pages.table_cells(df, "k", "html")

    return of


def grid(cells):
    return sorted((r.row, r.col, r.width, r.height, r.text) for r in cells.collect())


def test_cells_stand_where_spans_leave_room(read):
    html = "<tr><th rowspan=2>a &amp; b</th><th colspan='2'>c<br>d</th><td>e</td></tr><tr><td>f</td><td>g<table><tr><td>inner</td></tr></table></td><td>​</td></tr><tr><td>h<script>x</script><td>i</tr>"
    cells = read(html, None, "", "<tr><td colspan=x>open")
    assert grid(cells.where("k = 0 and tab = 0")) == [(0, 0, 1, 2, "a & b"), (0, 1, 2, 1, "c d"), (0, 3, 1, 1, "e"), (1, 1, 1, 1, "f"), (1, 2, 1, 1, "g"), (1, 3, 1, 1, ""), (2, 0, 1, 1, "h"), (2, 1, 1, 1, "i")]
    assert grid(cells.where("k = 0 and tab = 1")) == [(0, 0, 1, 1, "inner")]
    assert grid(cells.where("k > 0")) == [(0, 0, 1, 1, "open")]


def periods(cells):
    return [(str(r.period) if r.period else None, r.span, r.status) for r in T.columns(cells, "k").where("not change").orderBy("first").collect()]


def test_headers_in_parts(read):
    figures = "<tr><td>x</td><td>1</td><td>2</td></tr>"
    split = "<tr><td></td><td>March</td><td>December</td><td></td></tr><tr><td></td><td>2026</td><td>2025</td><td>Seq</td></tr><tr><td>x</td><td>1</td><td>2</td><td>3</td></tr>"
    assert periods(read(split)) == [("2026-03-31", "", "found"), ("2025-12-31", "", "found")]
    over = "<tr><td></td><td colspan=2>Three months ended June 30,</td></tr><tr><td></td><td>2026</td><td>2025</td></tr>" + figures
    assert periods(read(over)) == [("2026-06-30", "quarter", "found"), ("2025-06-30", "quarter", "found")]
    twice = "<tr><td></td><td>June 30, 2026</td><td>June 30, 2026</td></tr>" + figures
    assert periods(read(twice)) == [(None, "", "repeated")] * 2
    banner = "<tr><td></td><td>Three months ended</td><td>Six months ended</td></tr><tr><td></td><td>June 30, 2026</td><td>June 30, 2026</td></tr>" + figures
    assert periods(read(banner)) == [("2026-06-30", "quarter", "found"), ("2026-06-30", "long", "found")]
    years = "<tr><td></td><td>2026</td><td>2025</td></tr><tr><td></td><td>1st Qtr</td><td>4th Qtr</td><td>3rd Qtr</td></tr><tr><td>x</td><td>1</td><td>2</td><td>3</td></tr>"
    assert periods(read(years)) == [("2026-03-31", "", "found"), ("2025-12-31", "", "found"), ("2025-09-30", "", "found")]
    falling = years.replace("4th", "0th").replace("1st", "4th").replace("0th", "2nd").replace("3rd", "1st")  # one run, two years
    assert periods(read(falling)) == [(None, "", "unknown")] * 3
    assert periods(read("<tr><td></td><td>2026</td><td>2025</td></tr>" + figures)) == [(None, "", "unknown")] * 2
    assert periods(read("<tr><td>x</td><td>1</td><td>2</td></tr>")) == []


def values(cells):
    return {(r.metric, str(r.period)): (r.value, r.status) for r in T.metrics(cells, "k", SPECS).collect()}


HEAD = "<tr><td></td><td>2Q26</td><td>1Q26</td></tr>"


def test_figures_need_their_unit_and_their_column(read):
    def rows(*given, head=HEAD):
        return head + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in given)

    cells = rows(["Net interest margin", "3.42%", "3.4 %"], ["Diluted EPS", "0.91", "0.85"], ["Diluted EPS", "$", "0.91", "$", "0.85"], ["Total revenue", "1,200", "1,100"], ["Adjusted diluted EPS", "$2.00", "$2.00"])
    got = values(read(cells))
    assert got == {("nim", "2026-06-30"): (3.42, "agreed"), ("nim", "2026-03-31"): (3.4, "agreed"), ("eps", "2026-06-30"): (0.91, "agreed"), ("eps", "2026-03-31"): (0.85, "agreed")}  # revenue has no unit
    stated = rows(["(in millions)", "", ""], ["Total revenue (1)", "1,200", "(1,100)"], ["Diluted shares", "900", "901"], ["Diluted shares", "$5", "$6"])
    assert values(read(stated)) == {("revenue", "2026-06-30"): (1.2e9, "agreed"), ("shares", "2026-06-30"): (900, "agreed"), ("shares", "2026-03-31"): (901, "agreed")}  # a loss is out of bounds
    drift = rows(["Net interest margin", "3.42%", "3.40%", "3.38%"])
    assert values(read(drift)) == {}  # more figures than columns
    with_change = rows(["Net interest margin", "3.42%", "3.40%", "0.02%"], head="<tr><td></td><td>2Q26</td><td>1Q26</td><td>QoQ</td></tr>")
    assert values(read(with_change))["nim", "2026-06-30"] == (3.42, "agreed")


def test_tables_agree_within_what_they_print(spark):
    one = "<table>" + HEAD + "<tr><td>Net interest margin</td><td>3.4%</td><td>3.10%</td></tr></table>"
    two = "<table>" + HEAD + "<tr><td>Net interest margin</td><td>3.42%</td><td>3.15%</td></tr></table>"
    cells = pages.table_cells(spark.createDataFrame([("a", one + two)], "k string, html string"), "k", "html")
    assert values(cells) == {("nim", "2026-06-30"): (3.42, "agreed"), ("nim", "2026-03-31"): (None, "disagree")}


def test_signs_of_figures(spark):
    given = {"$ 1,234.5": 1234.5, "(0.25)": -0.25, "(1)": None, "-3": -3, ".94": 0.94, "—": None, "n/m": None, "12%": 12, "": None, "($5)": -5}
    df = spark.createDataFrame([(k,) for k in given], "t string").select("t", T.number(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == given


def test_pages_cut_by_pattern_read_as_by_the_parser(monkeypatch):
    """Well-formed pages never reach the parser, any others wholly do."""
    odd = ["<table><tr><td>a < b<td>2</table>", "<table><tr><td>1<!-- <td> --></table>", "<table><tr><script>x<td></script><td>3", "<table><tr><td class=x>4</td class>"]
    plain = ["<table id='t'><TR><td COLSPAN=\"2\" rowspan='2'>a &amp;\n b<br/>c</td><th class=\"x y\">&mdash;</th></tr><tr><td>d<table><tr><td>in</td></tr></table></td><td>", "x<p/>", "<table><td>open &amp"]
    fed = []
    feed = pages.HTMLParser.feed
    monkeypatch.setattr(pages.HTMLParser, "feed", lambda self, page: (fed.append(page), feed(self, page)))
    for page in odd + plain:
        read, parsed = pages._Tables(), pages._Tables()
        read.read(page)
        seen, fed[:] = list(fed), []
        feed(parsed, page)
        parsed.close()
        while parsed.open:
            parsed._shut(parsed.open.pop())
        assert read.cells == parsed.cells and seen == ([page] if page in odd else [])


def test_blanks_in_tags_are_cut_by_pattern(monkeypatch):
    """Pages with blanks before the end of a tag, or line breaks between attributes, never reach the parser."""
    page = "<table><tr\n><td class='a'\n rowspan='2' ><a >x</a ></td><td >1</td\n></tr><tr><td>2 </td></tr></table >"
    want = pages._Tables()
    want.feed(page)
    want.close()
    monkeypatch.setattr(pages.HTMLParser, "feed", lambda self, page: pytest.fail("fed to the parser"))
    assert pages.parsed(page) == want.cells and [c[-1] for c in want.cells] == ["x", "1", "2"]

"""Statements on rendered pages; each customer files a page a year, composed of its orders by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import rendered as S

from .base import Tables, query, spread

#: Lines: order priority, label in even years, label in odd years, element.
LINES = [
    ("1-URGENT", "Urgent orders, net of allowance of $12", "Urgent orders, net of allowance of $7", "Urgent"), ("2-HIGH", "High priority orders", "High priority orders of the Company", None),
    ("3-MEDIUM", "Medium", "Middle class", "Medium"), ("4-NOT SPECIFIED", "Other", "Other", "Other"), ("5-LOW", "Low orders", "Low orders", None), ("5-LOW", "Low orders and returns", "Low orders and returns", None),
]
SQL_LINES = "(VALUES " + ", ".join(f"({k}, '{p}', '{a}', '{b}', {str(p[0] in '23').lower()})" for k, (p, a, b, _) in enumerate(LINES)) + ") l (k, priority, even, odd, varies)"
SQL_STATED = f"""amounts AS (SELECT o_custkey AS c, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority AS priority, CAST(floor(sum(o_totalprice) / 1000) AS BIGINT) AS v FROM orders GROUP BY 1, 2, 3),
filed AS (SELECT DISTINCT c, y FROM amounts),
every AS (SELECT f.c, f.y AS filing, f.y - b AS p, l.k, l.varies, CASE WHEN f.y % 2 = 0 THEN even ELSE odd END AS label, CASE WHEN b = 0 OR f.c % 5 > 0 THEN (a.v + b + (l.k = 5)::INT) * CASE WHEN a.v % 7 = 3 THEN -1000e0 ELSE 1000e0 END END AS value
  FROM filed f, (VALUES (0), (1)) d (b), {SQL_LINES} LEFT JOIN amounts a ON a.c = f.c AND a.y = f.y - b AND a.priority = l.priority),
stated AS (SELECT * FROM every QUALIFY bool_or(value IS NOT NULL) OVER (PARTITION BY c, filing, k))"""


def _pages(t: Tables) -> DataFrame:
    """(c, filing, html): a page per customer and year over this year and the last, which it states one thousand higher; some leave the last blank. One shuffle of orders; pages are dealt over all tasks."""
    o = t.orders.select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("filing"), "o_orderpriority", "o_totalprice").where("c is not null and filing is not null")
    kinds = sorted({p for p, *_ in LINES})
    sums = [F.floor(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))) / 1000).alias(f"{p}/0") for p in kinds]
    year = Window.partitionBy("c").orderBy("filing")
    before = [F.when(F.lag("filing").over(year) == F.col("filing") - 1, F.lag(f"{p}/0").over(year)).alias(f"{p}/1") for p in kinds]
    wide = spread(o, "c").groupBy("c", "filing").agg(*sums).select("*", *before)
    even = F.col("filing") % 2 == 0

    def cell(priority: str, b: int, k: int):
        raw = F.col(f"`{priority}/{b}`")
        shown = F.format_number(raw + b + int(k == 5), 0)
        text = F.when(raw % 7 == 3, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(F.concat(F.lit("$ "), shown))
        return F.coalesce(F.when(F.lit(b == 0) | (F.col("c") % 5 > 0), text), F.lit("&#160;"))

    row = lambda label, one, two, ref="": F.concat(F.lit("<tr><td class='pl'><a "), F.lit(f"onclick=\"top.Show.showAR(this, 'defref_us-gaap_{ref}', window)\"" if ref else ""), F.lit(">"), label, F.lit("</a></td><td class='th'></td><td class='num'>"), one, F.lit("</td><td class='num'>"), two, F.lit("</td></tr>\n"))
    year = lambda b: (F.col("filing") - b).cast("string")
    blank = F.lit("")
    rows = [row(F.when(even, a).otherwise(b), cell(p, 0, k), cell(p, 1, k), e or "") for k, (p, a, b, e) in enumerate(LINES)]
    html = F.concat(
        F.lit("<table class='report'><tr><th class='tl' rowspan='2'>Orders - USD ($) $ in Thousands, except share data</th><th class='th' colspan='2'>12 Months Ended</th></tr><tr><th class='th'>Dec. 31, "), year(0),
        F.lit("</th><th class='th'>Dec. 31, "), year(1), F.lit("</th></tr>"), row(F.lit("Revenues:"), blank, blank), *rows, row(F.lit("Earnings per share"), F.lit("$ 1.25"), F.lit("(0.50)")), row(F.lit("Owned"), F.lit("1,000"), F.lit("2,000"), "Owned"),
        row(F.lit("Common Stock Shares Issued Not Disclosed"), F.lit("5"), F.lit("5")), row(F.lit("Status [Extensible Enumeration]"), F.lit("9"), F.lit("9")), row(F.lit("Total liabilities and equity"), F.lit("7"), F.lit("8")),
        row(F.lit("Total assets of others"), F.lit("3"), F.lit("4")), F.lit("</table><table class='authRefData' id='defref_us-gaap_Owned'><tr><td>Data Type:</td><td>xbrli:sharesItemType</td></tr></table>"),
    )
    return wide.select("c", "filing", F.concat_ws("/", "c", "filing").alias("page"), html.alias("html"))


def _lines(t: Tables) -> DataFrame:
    part = lambda k: F.split_part("page", F.lit("/"), F.lit(k))
    return S.page_lines(_pages(t), "page", "html").withColumns({"c": part(1).cast("long"), "filing": part(2).cast("int")}).drop("page")


@query(
    "rendered_lines",
    f"""WITH {SQL_STATED}, fixed AS (SELECT c, y AS filing, unnest([['Earnings per share', 'pershare', '1.25', '-0.5'], ['Owned', 'shares', '1000', '2000'], ['Common Stock Shares Issued Not Disclosed', 'monetary', '5000', '5000'], ['Total liabilities and equity', 'monetary', '7000', '8000']]) AS r FROM filed)
SELECT c, filing, label, 'monetary' AS kind, make_date(p, 12, 31) AS period, value FROM stated UNION ALL SELECT c, filing, r[1], r[2], make_date(filing, 12, 31), CAST(r[3] AS DOUBLE) FROM fixed UNION ALL SELECT c, filing, r[1], r[2], make_date(filing - 1, 12, 31), CAST(r[4] AS DOUBLE) FROM fixed""",
    dates=["period"],
)
def rendered_lines(t: Tables) -> DataFrame:
    return _lines(t).where("not header").select("c", "filing", "label", "kind", F.explode("figures").alias("f")).select("c", "filing", "label", "kind", "f.*")


@query(
    "rendered_statements",
    f"""WITH {SQL_STATED}, owner AS (SELECT c, p, max(filing) AS owner FROM every GROUP BY c, p), latest AS (SELECT c, k, arg_max(label, filing) AS label FROM stated GROUP BY c, k),
cell AS (SELECT o.c, o.p, s.k, s.varies, s.label, coalesce(s.value, CASE WHEN NOT s.varies THEN e.value END) AS value
  FROM owner o JOIN stated s ON s.c = o.c AND s.p = o.p AND s.filing = o.owner LEFT JOIN stated e ON e.c = o.c AND e.p = o.p AND e.filing = o.owner - 1 AND e.k = s.k),
named AS (SELECT *, CASE WHEN varies THEN first_value(cell.label) OVER (PARTITION BY c, k ORDER BY value IS NULL, p DESC) ELSE latest.label END AS shown FROM cell JOIN latest USING (c, k))
SELECT c, shown AS label, make_date(p, 12, 31) AS period, value FROM named WHERE value IS NOT NULL""",
    dates=["period"],
)
def rendered_statements(t: Tables) -> DataFrame:
    out = S.statements(_lines(t), "c", "filing", 20)
    own = [x for _, a, b, _ in LINES for x in (a, b)]
    return out.where(F.col("value").isNotNull() & F.col("label").isin(own)).select("c", "label", "period", "value")

"""Tables of releases and what is read from them; pages are composed from the filings of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import reltables as T
from ledgerline.sources import pages
from ledgerline.sources.workspace import written

from .base import SQL_FILINGS, Tables, query

SPECS = {
    "revenue": (r"total revenues?\b", "$K", 1e3, 1e12),
    "eps": (r"diluted (?:eps|earnings per (?:common )?share)", "$", 0.01, 60.0),
    "eps_adjusted": (r"adjusted diluted (?:eps|earnings per (?:common )?share)", "$", 0.01, 60.0),
    "efficiency": (r"efficiency ratio", "%", 20.0, 110.0),
    "shares": (r"average diluted shares", "#", 10.0, 1e12),
}
MONTHS = ["March 31,", "June 30,", "September 30,", "December 31,"]


def _pages(t: Tables) -> DataFrame:
    """A release of each bank over its last four quarters with filings: (bank, layout, q, html). Headers are laid out in seven ways."""
    own = t.filings().withColumn("amount", F.floor(F.col("revenue") / 1000))
    own = own.withColumn("y", (F.floor(F.col("qi") / 4) + 28).cast("int")).withColumn("n", (F.col("qi") % 4 + 1).cast("int"))
    last = own.groupBy("bank").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("qi", "y", "n", "amount")))), 1, 4).alias("q")).where(F.size("q") == 4)
    d = last.withColumn("layout", (F.col("bank") % 7).cast("int"))
    q = lambda f, sep="": F.array_join(F.transform("q", f), sep)
    th = lambda x, more="": F.concat(F.lit(f"<th{more}>"), x, F.lit("</th>"))
    tr = lambda *x: F.concat(F.lit("<tr>"), *x, F.lit("</tr>\n"))
    text = lambda x: x.cast("string")
    month = lambda x: F.element_at(F.array(*map(F.lit, MONTHS)), x.n)
    date = lambda x: F.concat(month(x), F.lit(" "), text(x.y))
    ordinal = lambda x: F.concat(F.element_at(F.array(*map(F.lit, ["1st", "2nd", "3rd", "4th"])), x.n), F.lit(" Quarter"))
    short = lambda x: F.concat(text(x.n), F.lit("Q"), F.lpad(text(x.y % 100), 2, "0"))
    years = F.array_distinct(F.transform("q", lambda x: x.y))
    runs = lambda more: F.array_join(F.transform(years, lambda y: F.concat(F.lit("<th"), F.concat(F.lit(' colspan="'), text(F.size(F.filter("q", lambda x: x.y == y))), F.lit('"')) if more else F.lit(""), F.lit(">"), text(y), F.lit("</th>"))), "")
    blank = F.lit("<th></th>")
    twice = lambda f: F.concat(*(f(F.get("q", F.lit(i))) for i in (0, 1, 0, 1)))
    head = (
        F.when(F.col("layout") == 0, tr(blank, q(lambda x: th(short(x)))))
        .when(F.col("layout") == 1, F.concat(tr(F.lit('<th rowspan="2"></th><th colspan="4">Three Months Ended</th><th colspan="4">Six Months Ended</th>')), tr(twice(lambda x: th(date(x), ' colspan="2"')))))
        .when(F.col("layout") == 2, F.concat(tr(blank, q(lambda x: th(month(x))), F.lit("<th></th>")), tr(blank, q(lambda x: th(text(x.y))), F.lit("<th>% Change</th>"))))
        .when(F.col("layout") == 3, F.concat(tr(F.lit("<th rowspan='2'>(in thousands)</th>"), runs(True)), tr(q(lambda x: th(ordinal(x))))))
        .when(F.col("layout") == 4, F.concat(tr(blank, runs(False)), tr(blank, q(lambda x: th(ordinal(x))))))
        .when(F.col("layout") == 5, tr(blank, twice(lambda x: th(date(x)))))
        .otherwise(F.concat(tr(blank, F.lit("<th colspan='4'>Quarter ended</th>")), tr(blank, q(lambda x: th(date(x))))))
    )

    def row(label: str, show, more: Column | None = None) -> Column:
        """A row of figures: in the second layout each in two cells and twice, in the third with a change, in the last with drifting cells."""
        cell = lambda x: F.concat(F.lit("<td>"), show(x), F.lit("</td>"))
        pair = lambda x: F.concat(F.lit("<td>$</td><td>"), show(x), F.lit("</td>"))
        drift = lambda x: F.concat(F.lit("<td></td><td>"), show(x), F.lit("</td>"))
        values = (
            F.when(F.col("layout") == 1, twice(pair)).when(F.col("layout") == 2, F.concat(q(cell), F.lit("<td>1.5</td>"))).when(F.col("layout") == 5, twice(cell)).when(F.col("layout") == 6, q(drift)).otherwise(q(cell))
        )
        return tr(F.lit(f"<td>{label}</td>"), values)

    amount = lambda x: F.format_number(x.amount, 0)
    eps = lambda x: F.concat(F.lit("$"), F.format_number((x.amount % 5000 + 1) / 100, 2))
    ratio = lambda x: F.concat(F.format_number((x.amount % 300 + 400) / 10, 1), F.lit("%"))
    finer = lambda x: F.concat(F.format_number((x.amount % 300 + 400) / 10 + F.when(F.col("bank") % 11 == 0, 7).otherwise(0.04), 2), F.lit("%"))
    first = F.concat(
        F.lit("<h1>Results of June 30, 2020</h1><table>"), tr(F.lit("<td colspan='9'>(Dollars in thousands, except per share data; audited December 31, 2019)</td>")), head,
        row("Total revenue (1)", amount), row("<b>Diluted</b> EPS", eps), row("Adjusted diluted EPS", lambda x: F.lit("$ 9.99")), row("Efficiency ratio", ratio), row("Average diluted shares", lambda x: F.lit("12,345")), F.lit("<tr><td>Notes</td><td>&mdash;</td></tr></table>"),
    )
    second = F.concat(F.lit("<table><tr><th></th>"), q(lambda x: th(short(x))), F.lit("</tr><tr><td>Efficiency ratio</td>"), q(lambda x: F.concat(F.lit("<td>"), finer(x), F.lit("</td>"))), F.lit("</tr><tr><td>Total revenue</td>"), q(lambda x: F.lit("<td>5</td>")), F.lit("</tr></table>"))
    return d.withColumn("html", F.concat(first, second))


SQL_RELEASES = f"""{SQL_FILINGS}, o AS (SELECT bank, qi, CAST(floor(revenue / 1000) AS BIGINT) AS amount, qi // 4 + 28 AS y, qi % 4 + 1 AS n, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS k FROM filings),
four AS (SELECT *, bank % 7 AS layout, last_day(make_date(y, n * 3, 1)) AS period FROM o WHERE k <= 4 AND bank IN (SELECT bank FROM o WHERE k = 4)),
runs AS (SELECT bank, count(DISTINCT y) IN (4, count(*) FILTER (WHERE n >= before) + 1) AS fits FROM (SELECT *, lag(n) OVER (PARTITION BY bank ORDER BY k) AS before FROM four) GROUP BY 1),
first AS (SELECT f.*, s.span FROM four f JOIN runs r USING (bank) JOIN (VALUES ('', 4), ('quarter', 2), ('long', 2), ('quarter', 4)) s (span, upto) ON k <= upto
  AND CASE layout WHEN 1 THEN upto = 2 WHEN 6 THEN upto = 4 AND span = 'quarter' ELSE upto = 4 AND span = '' END WHERE layout <> 5 AND (layout <> 4 OR fits))"""


@query("release_columns", f"""WITH {SQL_RELEASES}, c AS (SELECT f.bank, f.period, f.span, 'found' AS status FROM first f UNION ALL
  SELECT f.bank, NULL, '', CASE layout WHEN 5 THEN 'repeated' ELSE 'unknown' END FROM four f JOIN runs r USING (bank) WHERE layout = 5 OR (layout = 4 AND NOT fits))
SELECT bank, period, span, status FROM c""", dates=["period"])
def release_columns(t: Tables) -> DataFrame:
    return T.columns(written(pages.table_cells(_pages(t), "bank", "html"), "cells").where("tab = 0"), "bank").where("not change").select("bank", "period", "span", "status")


@query(
    "release_metrics",
    f"""WITH {SQL_RELEASES}, ratio AS (SELECT bank, period, '' AS span, (amount % 300 + 400) / 10e0 + CASE WHEN bank % 11 = 0 THEN 7 ELSE 0.04 END AS v, 2 AS d FROM four UNION ALL SELECT bank, period, span, (amount % 300 + 400) / 10e0, 1 FROM first),
a AS (SELECT bank, 'revenue' AS metric, period, span, amount * 1e3 AS value, 1 AS tables, 'agreed' AS status FROM first WHERE amount > 0
  UNION ALL SELECT bank, 'eps', period, span, (amount % 5000 + 1) / 100e0, 1, 'agreed' FROM first
  UNION ALL SELECT bank, 'eps_adjusted', period, span, 9.99, 1, 'agreed' FROM first
  UNION ALL SELECT bank, 'shares', period, span, 12345, 1, 'agreed' FROM first WHERE layout <> 1
  UNION ALL SELECT bank, 'efficiency', period, span, CASE WHEN max(v) - min(v) <= 0.05 THEN arg_max(v, d) END, count(*), CASE WHEN max(v) - min(v) <= 0.0500001 THEN 'agreed' ELSE 'disagree' END
    FROM ratio WHERE v BETWEEN 20 AND 110 GROUP BY bank, period, span)
SELECT bank, metric, period, span, round(value, 6) AS value, tables, status FROM a""",
    dates=["period"],
)
def release_metrics(t: Tables) -> DataFrame:
    cells = written(pages.table_cells(_pages(t), "bank", "html"), "cells")
    return T.metrics(cells, "bank", SPECS).withColumn("value", F.round("value", 6))

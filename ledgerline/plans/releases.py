"""Companies named in headlines, and figures printed in releases; texts are chosen by the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import releases as R
from ledgerline.operators import tagging as G

from .base import Tables, query, spread
from .rules import _chosen, _pick

NAMES = [("FIRST UNITED", "FUNC"), ("CITIZENS", "CIZN"), ("FNB", "FNB"), ("COMMUNITY BANCORP", "CMTV"), ("VALLEY NATIONAL", "VLY"), ("BANNER", "BANR"), ("ALPHA TRUST BANK", "ATB"), ("ALPHA TRUST", "AT")]
SHARED = [("FIRST BANCORP", "FBP", ["PUERTO RICO", "SAN JUAN"]), ("FIRST BANCORP", "FNLC", ["MAINE"])]
#: Headline, context, tickers.
TEXTS = [
    ("First United Bank opens", "", "FUNC"), ("Opening of first United Arab Emirates office", "", ""), ("Citizens Holding Company declares a dividend", "", "CIZN"), ("Citizens of Rome vote", "", ""),
    ("FNB AGF announces", "", ""), ("FNB announces results", "PITTSBURGH (NYSE: FNB)", "FNB"), ("Valley Community Bancorp reports", "", ""), ("As Community Bancorp reports", "", "CMTV"),
    ("Banner Capital buys", "", ""), ("Banner Health and Banner Corporation meet", "", "BANR"), ("Alpha Trust Bank and Alpha Trust merge", "", "ATB"), ("First BanCorp. results", "SAN JUAN, Puerto Rico", "FBP"),
    ("First Bancorp results", "(NASDAQ: FNLC) of Maine and Puerto Rico", "FNLC"), ("First Bancorp results", "", ""), ("", "", ""), ("Valley National, First United: news", "", "VLY"),
]
CELLS = [("1Q26", "2026-03-31"), ("4Q '2025", "2025-12-31"), ("Third Quarter 2025", "2025-09-30"), ("2nd Qtr. 2024", "2024-06-30"), ("March 31, 2026", "2026-03-31"), ("Jun 2026", "2026-06-30"), ("May 2026", ""), ("February 30, 2025", ""), ("2026", ""), ("", "")]
QUOTES = [("a margin of 3.42%", 3.42, True), ("a ratio of .19%", 0.19, True), ("a ratio of 3.19%", 0.19, False), ("a loss of (1,234.5)", -1234.5, True), ("up 5%", 4.56, False), ("a loss of 7", -7.0, False), ("", 1.0, False)]
ROWS = ["<tr><td>Net <b>margin</b></td><td>3.42</td><td>%</td><td>(1)</td><td>(0.25)</td></tr>", "<tr><th>Assets</th><td>$ 1,234.5</td><td>.94</td></tr>", "<tr><td>Only</td></tr>", ""]
ROW_VALUES = ["3.42 -0.25", "1234.5 0.94", "", ""]
MEMBERS = [("us:LegalEntityAxis", "own:AlphaBankNA", "bank", ""), ("us:ConsolidatedEntitiesAxis", "own:BlueBanksharesInc", "holdco", "parent"), ("us:LegalEntityAxis", "own:Alpha", "holdco", "fuzzy"), ("us:SegmentAxis", "own:Bank", "holdco", "default")]


@query("headline_subjects", f"SELECT event_id, CASE WHEN x <> '' THEN x END AS ticker FROM (SELECT event_id, {_chosen([t[2] for t in TEXTS], 'event_id')} AS x FROM events) WHERE x <> ''")
def headline_subjects(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame(NAMES, "name string, ticker string")
    shared = t.spark.createDataFrame(SHARED, "name string, ticker string, cues array<string>")
    heads = spread(t.events.select("event_id"), "event_id").select("event_id", _pick([x[0] for x in TEXTS], "event_id").alias("headline"), _pick([x[1] for x in TEXTS], "event_id").alias("body"))
    return G.subjects(heads, "event_id", "headline", "body", names, shared)


@query("header_periods", f"SELECT c_custkey AS k, TRY_CAST(nullif({_chosen([c[1] for c in CELLS], 'c_custkey')}, '') AS DATE) AS period FROM customer", dates=["period"])
def header_periods(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), R.period_end(_pick([c[0] for c in CELLS], "c_custkey")).alias("period"))


@query("quoted_numbers", f"SELECT c_custkey AS k, ({[q[2] for q in QUOTES]})[CAST(c_custkey % {len(QUOTES)} + 1 AS INTEGER)] AS shown FROM customer")
def quoted_numbers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), R.number_in_quote(_pick([q[0] for q in QUOTES], "c_custkey"), _pick([q[1] for q in QUOTES], "c_custkey")).alias("shown"))


@query("table_cells", f"SELECT c_custkey AS k, {_chosen(ROW_VALUES, 'c_custkey')} AS shown FROM customer WHERE c_custkey % {len(ROWS)} < {len(ROWS) - 1}")
def table_cells(t: Tables) -> DataFrame:
    html = F.concat(F.lit("<table>"), _pick(ROWS, "c_custkey"), F.lit("</table>"))
    rows = t.customer.select(F.col("c_custkey").alias("k"), F.explode(R.table_rows(html)).alias("cells"))
    return rows.select("k", F.array_join(R.row_values(F.col("cells")).cast("array<string>"), " ").alias("shown"))


@query("capital_basis", f"SELECT c_custkey AS k, {_chosen([m[2] for m in MEMBERS], 'c_custkey')} AS basis, nullif({_chosen([m[3] for m in MEMBERS], 'c_custkey')}, '') AS confidence FROM customer")
def capital_basis(t: Tables) -> DataFrame:
    dims = F.create_map(_pick([m[0] for m in MEMBERS], "c_custkey"), _pick([m[1] for m in MEMBERS], "c_custkey"))
    return t.customer.select(F.col("c_custkey").alias("k"), R.entity_basis(dims).alias("b")).select("k", "b.*")

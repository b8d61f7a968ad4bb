"""Credit, deposit, capital and capital-return timelines of banks, with alerts and screening figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import timelines as L

from .base import SQL_FILINGS, Tables, query

#: Call-report figures of a filing, as SQL over bank, qi, revenue and k = bank * 31 + qi * 17; some are missing.
FIGURES = {
    "loans": "revenue",
    "nco": "CASE WHEN k % 13 <> 5 THEN (k % 23) / 20e0 END",
    "npl": "CASE WHEN k % 17 <> 4 THEN 0.1e0 + (k % 37) / 10e0 END",
    "past_due_30": "CASE WHEN k % 11 <> 3 THEN revenue * (k % 13) / 400e0 END",
    "past_due_90": "revenue * (k % 7) / 800e0",
    "reserves": "CASE WHEN k % 19 <> 6 THEN (k % 29) / 10e0 END",
    "filed_coverage": "50e0 + k % 97",
    "npl_cre": "(k % 31) / 6e0",
    "npl_resi": "CASE WHEN k % 5 <> 0 THEN (k % 41) / 9e0 END",
    "npl_ci": "(k % 43) / 11e0",
    "deposits": "revenue",
    "noninterest": "revenue * (10 + k % 41) / 100e0",
    "uninsured": "CASE WHEN k % 7 <> 1 THEN revenue * (20 + k % 50) / 100e0 END",
    "brokered": "revenue * (k % 5) / 100e0",
    "cost": "(k % 27) / 10e0",
    "rate": "(qi % 9) / 2e0",
    "cet1": "CASE WHEN k % 23 <> 2 THEN 6e0 + (k % 80) / 10e0 END",
    "equity": "revenue * (8 + k % 4) / 100e0",
    "intangibles": "CASE WHEN k % 3 <> 0 THEN revenue / 200e0 END",
    "income_ytd": "(qi % 4 + 1) * revenue * (1 + k % 3) / 100e0",
    "dividends": "CASE WHEN k % 6 <> 0 THEN revenue * (k % 4) / 1000e0 END",
    "buybacks": "CASE WHEN k % 9 <> 0 THEN revenue * (k % 5) / 1000e0 END",
    "income": "revenue * (k % 11 - 1) / 500e0",
    "shares": "CASE WHEN k % 4 <> 3 THEN 1000e0 + k % 50 END",
}
SEGMENTS = ["npl_cre", "npl_resi", "npl_ci"]
SQL_CALLS = f"{SQL_FILINGS}, calls AS (SELECT bank, qi, {', '.join(f'{e} AS {c}' for c, e in FIGURES.items())} FROM (SELECT *, bank * 31 + qi * 17 AS k FROM filings))"
W = "OVER (PARTITION BY bank ORDER BY qi)"


def _calls(t: Tables, *more: str) -> DataFrame:
    k = t.filings().withColumn("k", F.expr("bank * 31 + qi * 17"))
    return k.select("bank", "qi", *(F.expr(e).alias(c) for c, e in FIGURES.items() if not more or c in more))


def r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def sql_r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0e0 AS {n}" for n in names)  # no negative zero


SQL_CREDIT = f"""{SQL_CALLS}, c1 AS (SELECT *, CASE WHEN loans > 0 THEN past_due_30 / loans * 100 END AS past_due_30_pct, CASE WHEN loans > 0 THEN past_due_90 / loans * 100 END AS past_due_90_pct,
  CASE WHEN reserves IS NOT NULL AND npl > 0 THEN reserves / npl * 100 ELSE filed_coverage END AS coverage FROM calls),
credit AS (SELECT *, {", ".join(f"{c} - lag({c}) {W} AS {c}_qoq" for c in L.CREDIT_CHANGES)}, lag(nco, 4) {W} AS nco_back, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS age, count(*) OVER (PARTITION BY bank) AS rows FROM c1),
seg AS (SELECT bank, npl AS total, u.k, u.s, u.v FROM credit, LATERAL (VALUES (0, 'npl_cre', npl_cre), (1, 'npl_resi', npl_resi), (2, 'npl_ci', npl_ci)) u(k, s, v) WHERE age = 1),
hot AS (SELECT bank, s, v, v / total AS multiple, row_number() OVER (PARTITION BY bank ORDER BY v DESC, k) AS place FROM seg WHERE total > 0 AND v > 0 AND (v / total >= 3 OR v > 2))"""
CREDIT_OUT = ["past_due_30_pct", "past_due_90_pct", "coverage", *(f"{c}_qoq" for c in L.CREDIT_CHANGES)]


@query("credit_timeline", f"WITH {SQL_CREDIT} SELECT bank, qi, {sql_r(*CREDIT_OUT)} FROM credit")
def credit_timeline(t: Tables) -> DataFrame:
    return L.credit(_calls(t)).select("bank", "qi", *r(*CREDIT_OUT))


@query(
    "credit_alert_list",
    f"""WITH {SQL_CREDIT}, known AS (SELECT bank, nco, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS k FROM credit WHERE nco IS NOT NULL),
four AS (SELECT bank, {", ".join(f"max(CASE WHEN k = {i + 1} THEN nco END) AS n{i}" for i in range(4))} FROM known WHERE k <= 4 GROUP BY 1),
last AS (SELECT c.*, n0, n1, n2, n3, median(CASE WHEN coverage > 0 THEN coverage END) OVER () AS peer FROM credit c LEFT JOIN four USING (bank) WHERE age = 1 AND rows > 1),
a AS (SELECT bank, 'nco_accelerating' AS code, CASE WHEN n0 - n3 > 0.25 THEN 'high' ELSE 'medium' END AS severity, n0 - n3 AS value FROM last WHERE n0 > n1 AND n1 > n2 AND n2 > n3 AND n0 - n3 > 0.05
UNION ALL SELECT bank, 'pd_migration', 'medium', past_due_30_pct_qoq FROM last WHERE past_due_30_pct_qoq > 0.10
UNION ALL SELECT bank, 'under_reserved', 'high', coverage FROM last WHERE coverage < 100
UNION ALL SELECT bank, 'thin_reserves_vs_peers', 'medium', coverage FROM last WHERE coverage >= 100 AND coverage < peer * 0.75
UNION ALL SELECT bank, CASE WHEN multiple >= 3 THEN 'segment_hotspot' ELSE 'segment_elevated' END, CASE WHEN multiple >= 3 THEN 'high' ELSE 'medium' END, v FROM hot JOIN last USING (bank) WHERE place <= 2 AND (multiple >= 3 OR v > 3))
SELECT bank, code, severity, round(value, 6) AS value FROM a""",
)
def credit_alert_list(t: Tables) -> DataFrame:
    return L.credit_alerts(L.credit(_calls(t)), SEGMENTS).select("bank", "code", "severity", *r("value"))


@query(
    "credit_screening",
    f"""WITH {SQL_CREDIT} SELECT c.bank, round((nco - nco_back) * 100, 6) AS nco_4q_trend_bps, round(npl_qoq * 100, 6) AS npl_trend_bps, round(past_due_30_pct_qoq * 100, 6) AS pd_migration_bps,
  round(coverage, 6) AS reserve_coverage_pct, round(h.v, 6) AS worst_segment_npl FROM credit c LEFT JOIN hot h ON c.bank = h.bank AND h.place = 1 WHERE age = 1""",
)
def credit_screening(t: Tables) -> DataFrame:
    return L.credit_screening(L.credit(_calls(t)), SEGMENTS).select("bank", *r("nco_4q_trend_bps", "npl_trend_bps", "pd_migration_bps", "reserve_coverage_pct", "worst_segment_npl"))


@query("peer_reserve_median", f"WITH {SQL_CREDIT} SELECT round(median(CASE WHEN coverage > 0 THEN coverage END), 6) AS peer_coverage FROM credit WHERE age = 1")
def peer_reserve_median(t: Tables) -> DataFrame:
    return L.peer_coverage(L.newest(L.credit(_calls(t)), "bank", "qi")).select(*r("peer_coverage"))


DEPOSIT_OUT = ["noninterest_pct", "uninsured_pct", "brokered_pct", "growth_qoq", "cost_qoq", "rate_qoq"]
SQL_DEPOSITS = f"""{SQL_CALLS}, d1 AS (SELECT *, {", ".join(f"CASE WHEN deposits <> 0 THEN {c} / deposits * 100 END AS {c}_pct" for c in ("noninterest", "uninsured", "brokered"))},
  CASE WHEN lag(deposits) {W} <> 0 THEN (deposits / lag(deposits) {W} - 1) * 100 END AS growth_qoq, cost - lag(cost) {W} AS cost_qoq, rate - lag(rate) {W} AS rate_qoq FROM calls),
dep AS (SELECT *, row_number() {W} AS k, avg(cost_qoq) OVER (PARTITION BY bank ORDER BY qi ROWS 1 PRECEDING) AS two, avg(cost_qoq) OVER (PARTITION BY bank ORDER BY qi ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS four,
  noninterest_pct - lag(noninterest_pct, 4) {W} AS fall, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS age FROM d1)"""


@query("deposit_timeline", f"WITH {SQL_DEPOSITS} SELECT bank, qi, {sql_r(*DEPOSIT_OUT)} FROM dep")
def deposit_timeline(t: Tables) -> DataFrame:
    return L.deposits(_calls(t)).select("bank", "qi", *r(*DEPOSIT_OUT))


@query(
    "deposit_alert_list",
    f"""WITH {SQL_DEPOSITS}, a AS (SELECT bank, 'deposit_outflow' AS code, CASE WHEN growth_qoq < -5 THEN 'high' ELSE 'medium' END AS severity, growth_qoq AS value FROM dep WHERE age = 1 AND growth_qoq < -2
UNION ALL SELECT bank, 'cost_accelerating', 'medium', two FROM dep WHERE age = 1 AND k >= 6 AND two > 0.10 AND two > four * 1.5
UNION ALL SELECT bank, 'nii_declining', 'medium', fall FROM dep WHERE age = 1 AND fall < -3
UNION ALL SELECT bank, 'uninsured_high', CASE WHEN uninsured_pct > 55 THEN 'high' ELSE 'medium' END, uninsured_pct FROM dep WHERE age = 1 AND uninsured_pct > 40)
SELECT bank, code, severity, round(value, 6) AS value FROM a""",
)
def deposit_alert_list(t: Tables) -> DataFrame:
    return L.deposit_alerts(L.deposits(_calls(t))).select("bank", "code", "severity", *r("value"))


def _gap(c: str) -> str:
    return f"CASE WHEN qi - lag(qi) {W} = 1 THEN {c} - lag({c}) {W} END"


CAPITAL_OUT = ["tbv", "income", "equity_qoq", "tbv_qoq", "loans_qoq", "loans_qoq_pct", "cet1_qoq", "returned", "retention", "tbv_per_share"]
SQL_CAPITAL = f"""{SQL_CALLS}, k0 AS (SELECT * EXCLUDE (income), equity - coalesce(intangibles, 0) AS tbv FROM calls),
k1 AS (SELECT *, CASE WHEN qi % 4 = 0 THEN income_ytd WHEN lag(qi) {W} = qi - 1 THEN income_ytd - lag(income_ytd) {W} END AS income, {_gap("equity")} AS equity_qoq, {_gap("tbv")} AS tbv_qoq, {_gap("loans")} AS loans_qoq, {_gap("cet1")} AS cet1_qoq,
  CASE WHEN qi - lag(qi) {W} = 1 AND lag(loans) {W} <> 0 THEN (loans / lag(loans) {W} - 1) * 100 END AS loans_qoq_pct, CASE WHEN shares > 0 THEN tbv * 1000 / shares END AS tbv_per_share FROM k0),
k2 AS (SELECT *, income - equity_qoq AS returned, CASE WHEN income <> 0 THEN 1 - (income - equity_qoq) / income END AS retention FROM k1),
cap AS (SELECT *, avg(retention) OVER f AS kept, count(retention) OVER f AS known, row_number() {W} AS n, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS age, {", ".join(f"lag(cet1, {k}) {W} AS c{k}" for k in range(1, 5))} FROM k2
  WINDOW f AS (PARTITION BY bank ORDER BY qi ROWS 3 PRECEDING)),
tb AS (SELECT bank, max(CASE WHEN k = 1 THEN v END) AS t_now, max(CASE WHEN k = 5 THEN v END) AS t_then FROM (SELECT bank, tbv_per_share AS v, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS k FROM cap WHERE tbv_per_share IS NOT NULL) GROUP BY 1),
last AS (SELECT cap.*, t_now, t_then, median(cet1) OVER () AS peer FROM cap LEFT JOIN tb USING (bank) WHERE age = 1)"""


@query("capital_timeline", f"WITH {SQL_CAPITAL} SELECT bank, qi, {sql_r(*CAPITAL_OUT)} FROM cap")
def capital_timeline(t: Tables) -> DataFrame:
    return L.capital(_calls(t).drop("income"), shares="shares").select("bank", "qi", *r(*CAPITAL_OUT))


@query(
    "capital_alert_list",
    f"""WITH {SQL_CAPITAL}, a AS (SELECT bank, 'cet1_critical' AS code, 'high' AS severity, cet1 AS value FROM last WHERE cet1 < 7
UNION ALL SELECT bank, 'cet1_low', 'medium', cet1 FROM last WHERE cet1 >= 7 AND cet1 < 8
UNION ALL SELECT bank, 'cet1_eroding', 'high', cet1 - c4 FROM last WHERE cet1 < c1 AND c1 < c2 AND c2 < c3 AND c3 < c4 AND c4 - cet1 > 0.25
UNION ALL SELECT bank, 'tbv_eroding', 'medium', CASE WHEN t_then <> 0 THEN (t_now - t_then) / t_then * 100 END FROM last WHERE t_now < t_then
UNION ALL SELECT bank, 'high_payout', 'medium', (1 - kept) * 100 FROM last WHERE n >= 4 AND known >= 2 AND (1 - kept) * 100 > 80
UNION ALL SELECT bank, 'cet1_below_peers', 'medium', cet1 - peer FROM last WHERE cet1 < peer * 0.85)
SELECT bank, code, severity, round(value, 6) AS value FROM a""",
)
def capital_alert_list(t: Tables) -> DataFrame:
    return L.capital_alerts(L.capital(_calls(t).drop("income"), shares="shares")).select("bank", "code", "severity", *r("value"))


@query(
    "capital_screening",
    f"""WITH {SQL_CAPITAL} SELECT bank, round(cet1, 6) AS cet1_current, round(cet1_qoq, 6) AS cet1_qoq_pp, round(CASE WHEN t_then > 0 THEN (t_now / t_then - 1) * 100 END, 6) AS tbv_cagr_1y,
  round(CASE WHEN (1 - kept) * 100 < 0 THEN 0 WHEN (1 - kept) * 100 <= 200 THEN (1 - kept) * 100 END, 6) AS payout_ratio_4q,
  round((income - coalesce(returned, 0) - CASE WHEN loans_qoq > 0 THEN loans_qoq * 0.1e0 ELSE 0 END) * 1000, 4) AS buyback_capacity_usd FROM last""",
)
def capital_screening(t: Tables) -> DataFrame:
    s = L.capital_screening(L.capital(_calls(t).drop("income"), shares="shares"))
    return s.select("bank", *r("cet1_current", "cet1_qoq_pp", "tbv_cagr_1y", "payout_ratio_4q"), *r("buyback_capacity_usd", digits=4))


SQL_RETURN = f"""{SQL_CALLS}, r0 AS (SELECT bank, qi, dividends, buybacks, income, loans * 4 AS cap, last_value(shares IGNORE NULLS) OVER (PARTITION BY bank ORDER BY qi ROWS UNBOUNDED PRECEDING) AS shares FROM calls),
r1 AS (SELECT *, CASE WHEN dividends IS NOT NULL OR buybacks IS NOT NULL THEN coalesce(dividends, 0) + coalesce(buybacks, 0) END AS returned, lag(shares) {W} AS before, CASE WHEN income > 0 THEN income END AS safe,
  row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS age FROM r0),
ret AS (SELECT *, dividends / safe AS payout_ratio, buybacks / safe AS buyback_ratio, returned / safe AS return_ratio, shares - before AS share_change, CASE WHEN before <> 0 THEN (shares / before - 1) * 100 END AS share_change_pct FROM r1 WHERE age <= 20),
t0 AS (SELECT *, {", ".join(f"CASE WHEN qi - lag(qi, 3) {W} = 3 AND count({c}) OVER f = 4 THEN sum({c}) OVER f END AS {c}_ttm" for c in ("dividends", "buybacks", "income"))}, first_value(shares) OVER f AS first FROM ret WINDOW f AS (PARTITION BY bank ORDER BY qi ROWS 3 PRECEDING)),
ttm AS (SELECT *, CASE WHEN dividends_ttm IS NOT NULL OR buybacks_ttm IS NOT NULL THEN coalesce(dividends_ttm, 0) + coalesce(buybacks_ttm, 0) END AS returned_ttm, CASE WHEN income_ttm > 0 THEN income_ttm END AS safe_ttm FROM t0)"""
RETURN_OUT = ["returned", "payout_ratio", "buyback_ratio", "return_ratio", "share_change", "share_change_pct"]
TTM_OUT = ["dividends_ttm", "buybacks_ttm", "income_ttm", "returned_ttm", "payout_ttm", "total_return_ttm", "share_change_ttm"]


@query("capital_return_timeline", f"WITH {SQL_RETURN} SELECT bank, qi, {sql_r(*RETURN_OUT)} FROM ret")
def capital_return_timeline(t: Tables) -> DataFrame:
    return L.capital_return(_calls(t)).select("bank", "qi", *r(*RETURN_OUT))


@query(
    "capital_return_ttm",
    f"""WITH {SQL_RETURN} SELECT bank, qi, {sql_r("dividends_ttm", "buybacks_ttm", "income_ttm", "returned_ttm")}, round(nullif(dividends_ttm, 0) / safe_ttm, 6) AS payout_ttm, round(returned_ttm / safe_ttm, 6) AS total_return_ttm,
  round(CASE WHEN first > 0 AND shares <> 0 THEN (shares / first - 1) * 100 END, 6) AS share_change_ttm FROM ttm""",
)
def capital_return_ttm(t: Tables) -> DataFrame:
    return L.capital_return_ttm(L.capital_return(_calls(t))).select("bank", "qi", *r(*TTM_OUT))


@query(
    "shareholder_yield",
    f"""WITH {SQL_RETURN} SELECT bank, qi, round(dividends_ttm / cap * 100, 6) AS dividend_yield_pct, round(buybacks_ttm / cap * 100, 6) AS buyback_yield_pct, round(returned_ttm / cap * 100, 6) AS shareholder_yield_pct FROM ttm""",
)
def shareholder_yield(t: Tables) -> DataFrame:
    ttm = L.capital_return_ttm(L.capital_return(_calls(t).withColumn("cap", F.col("loans") * 4)))
    return L.shareholder_yield(ttm, "cap").select("bank", "qi", *r("dividend_yield_pct", "buyback_yield_pct", "shareholder_yield_pct"))

"""Statements by row kinds over call-report figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import rounded
from ledgerline.operators import rowkinds as K

from .base import SQL_FILINGS, Tables, query

#: Figures of a filing as SQL over bank, qi, revenue and k = bank * 31 + qi * 17; flows are year to date.
FIGURES = {
    "assets": "revenue * 10", "loans": "revenue * 6", "securities": "revenue * 2", "available": "CASE WHEN k % 8 <> 1 THEN revenue END", "held": "CASE WHEN k % 3 = 0 THEN revenue / 2 END", "trading": "CASE WHEN k % 5 = 0 THEN revenue / 10 END",
    "equity": "revenue * (8 + k % 5) / 10e0", "intangibles": "CASE WHEN k % 4 <> 0 THEN revenue / 20 END", "goodwill": "CASE WHEN k % 6 <> 0 THEN revenue * (k % 7) / 100e0 END", "servicing": "CASE WHEN k % 5 <> 0 THEN revenue / 200 END",
    "preferred": "CASE WHEN k % 9 = 0 THEN revenue / 30 ELSE 0e0 END", "deposits": "revenue * 7", "borrowings": "CASE WHEN k % 7 <> 0 THEN revenue / 3 END",
    "interest": "(qi % 4 + 1) * revenue * (3 + k % 4) / 50e0", "expense": "(qi % 4 + 1) * revenue * (1 + k % 3) / 60e0", "deposit_expense": "(qi % 4 + 1) * revenue * (1 + k % 3) / 90e0", "other": "(qi % 4 + 1) * revenue / 40", "fees": "CASE WHEN k % 4 <> 2 THEN (qi % 4 + 1) * revenue / 160 END",
    "cost": "(qi % 4 + 1) * revenue * (2 + k % 5) / 70e0", "pretax": "(qi % 4 + 1) * revenue * (k % 9 - 1) / 100e0", "taxes": "CASE WHEN k % 10 <> 3 THEN (qi % 4 + 1) * revenue * (k % 4) / 300e0 END", "net_income": "(qi % 4 + 1) * revenue * (k % 9 - 1) / 130e0",
    "net_income_q": "CASE WHEN k % 5 = 1 THEN revenue / 77 END", "security_gains": "CASE WHEN k % 3 <> 1 THEN (qi % 4 + 1) * revenue / 900 END", "extraordinary": "CASE WHEN k % 13 = 0 THEN revenue / 500 END", "margin": "2e0 + k % 30 / 10e0",
    "exempt_loans": "CASE WHEN k % 6 > 1 THEN revenue / 400 END", "exempt_securities": "CASE WHEN k % 6 > 2 THEN revenue / 700 END", "count": "CASE WHEN k % 12 <> 5 THEN 1000e0 + k % 60 END", "dps": "(k % 5) / 10e0", "eps": "(k % 8) / 4e0",
    "item": "CASE WHEN k % 3 = 0 THEN revenue / 90 END", "writein": "CASE WHEN k % 7 = 0 THEN revenue / 80 END", "substandard": "CASE WHEN k % 4 <> 1 THEN revenue * 20 END", "doubtful": "CASE WHEN k % 5 = 2 THEN revenue * 3 END", "mention": "CASE WHEN k % 2 = 0 THEN revenue * 30 END",
}
W = "OVER (PARTITION BY bank ORDER BY qi)"


def _flow(c: str) -> str:
    return f"(CASE WHEN qi % 4 = 0 THEN {c} WHEN lag(qi) {W} = qi - 1 THEN {c} - lag({c}) {W} END)"


def _mean(c: str) -> str:
    return f"coalesce(({c} + lag({c}) {W}) / 2, {c})"


def _pct(a: str, b: str, positive: bool = False) -> str:
    return f"CASE WHEN ({b}) {'>' if positive else '<>'} 0 THEN ({a}) / ({b}) * 100 END"


_EXEMPT = "(CASE WHEN exempt_loans IS NOT NULL OR exempt_securities IS NOT NULL THEN coalesce(exempt_loans, 0) + coalesce(exempt_securities, 0) END * (0.21::DOUBLE / (1 - 0.21::DOUBLE)))"
_FUND = f"(coalesce({_mean('deposits')}, 0) + coalesce({_mean('borrowings')}, 0))"
_TAX = "coalesce(CASE WHEN pretax <> 0 THEN least(greatest(taxes / pretax, 0), 0.40::DOUBLE) END, 0.21::DOUBLE)"
_CLASSIFIED = "CASE WHEN substandard IS NOT NULL OR doubtful IS NOT NULL THEN coalesce(substandard, 0) + coalesce(doubtful, 0) END"
#: Each row of the specification beside its SQL.
ROWS = [
    (("assets_row", "dollar", "assets"), "assets"), (("margin_row", "pct", "margin"), "margin"), (("net_interest", "diff", "interest", "expense"), "interest - expense"), (("spread_row", "pctdiff", "margin", "dps"), "margin - dps"),
    (("loans_to_assets", "ratio", "loans", "assets"), _pct("loans", "assets")), (("other_fees", "noniother", "other", "fees"), "other - coalesce(fees, 0)"), (("ppnr_row", "ppnr", "interest", "expense", "other", "cost"), "interest - expense + other - cost"),
    (("tax_rate", "etr", "taxes", "pretax"), _pct("taxes", "pretax")), (("tangible", "tce", "equity", "intangibles"), "equity - coalesce(intangibles, 0)"),
    (("roatce_row", "roatce", "net_income", "equity", "intangibles"), _pct(f"{_flow('net_income')} * 4", f"{_mean('equity')} - coalesce({_mean('intangibles')}, 0)", True)), (("roate_row", "roate", "net_income", "equity", "intangibles"), _pct(f"{_flow('net_income')} * 4", f"{_mean('equity')} - coalesce({_mean('intangibles')}, 0)", True)),
    (("roace_row", "roace", "net_income", "equity", "preferred"), f"CASE WHEN coalesce(preferred, 0) <= 0 THEN {_pct(_flow('net_income') + ' * 4', _mean('equity') + ' - coalesce(' + _mean('preferred') + ', 0)', True)} END"),
    (("margin_of_revenue", "marginrev", "net_income", "interest", "expense", "other"), _pct("net_income", "interest - expense + other")), (("net_opex", "netopex", "cost", "other", "assets"), _pct(f"({_flow('cost')} - {_flow('other')}) * 4", _mean("assets"))),
    (("cost_of_funds", "costfunds", "expense", "deposits", "borrowings"), _pct(f"{_flow('expense')} * 4", _FUND)),
    (("cost_of_debt", "costdebt", "expense", "deposit_expense", "borrowings"), f"CASE WHEN {_mean('borrowings')} >= 1000 THEN ({_flow('expense')} - {_flow('deposit_expense')}) * 4 / {_mean('borrowings')} * 100 END"),
    (("loan_yield", "yield", "interest", "loans"), _pct(f"{_flow('interest')} * 4", _mean("loans"))), (("net_yield", "yield2", "interest", "expense", "assets"), _pct(f"({_flow('interest')} - {_flow('expense')}) * 4", _mean("assets"))),
    (("fte_row", "fte_adj", "exempt_loans", "exempt_securities"), _EXEMPT), (("nii_fte_row", "nii_fte", "interest", "expense", "exempt_loans", "exempt_securities"), f"interest - expense + {_EXEMPT}"),
    (("fte_margin", "ftenim", "margin", "assets", "exempt_loans", "exempt_securities"), f"margin + {_EXEMPT} * (4e0 / (qi % 4 + 1)) / {_mean('assets')} * 100"),
    (("item_row", "rie", "details", "X1"), "item"), (("writein_row", "rie_wi", "writeins", "Card income"), "writein"), (("dep_cost", "dep_flow", "deposit_expense"), _flow("deposit_expense")), (("dep_balance", "dep_avg", "deposits"), "deposits"),
    (("dep_rate_row", "dep_rate", "deposit_expense", "deposits"), _pct(f"{_flow('deposit_expense')} * 4", "deposits", True)), (("unknown", "na"), "NULL::DOUBLE"), (("funding", "sum", "deposits", "borrowings"), "deposits + coalesce(borrowings, 0)"),
    (("held_row", "htm", "held", "securities", "available", "trading"), "coalesce(held, securities - available - coalesce(trading, 0))"), (("other_intangibles", "otherint", "intangibles", "goodwill", "servicing"), "CASE WHEN intangibles - goodwill - coalesce(servicing, 0) >= 0 THEN intangibles - goodwill - coalesce(servicing, 0) END"),
    (("residual_row", "residual", "securities", "available", "trading", "held"), "CASE WHEN securities - coalesce(available, 0) - coalesce(trading, 0) - coalesce(held, 0) >= 0 THEN securities - coalesce(available, 0) - coalesce(trading, 0) - coalesce(held, 0) END"),
    (("deposit_growth", "growth", "deposits", 4), f"CASE WHEN deposits / lag(deposits) {W} > 0 THEN (pow(deposits / lag(deposits) {W}, 4) - 1) * 100 END"), (("income_flow", "flow", "net_income", "net_income_q"), f"coalesce(net_income_q, {_flow('net_income')})"),
    (("liquid", "fratio", "available+held", "assets-trading"), f"CASE WHEN available IS NOT NULL OR held IS NOT NULL THEN {_pct('coalesce(available, 0) + coalesce(held, 0)', 'assets - coalesce(trading, 0)', True)} END"),
    (("expense_share", "flowratio", "expense", "interest"), f"CASE WHEN {_flow('expense')} >= 0 AND {_flow('interest')} > 0 THEN {_flow('expense')} / {_flow('interest')} * 100 END"),
    (("classified", "crit", "grades", "classified", "loans"), f"({_CLASSIFIED}) / 1000"), (("criticized", "crit", "grades", "criticized", "loans"), "CASE WHEN substandard IS NOT NULL OR doubtful IS NOT NULL OR mention IS NOT NULL THEN coalesce(substandard, 0) + coalesce(doubtful, 0) + coalesce(mention, 0) END / 1000"),
    (("graded", "crit", "grades", "coverage", "loans"), "CASE WHEN coalesce(substandard, 0) + coalesce(doubtful, 0) + coalesce(mention, 0) > 0 THEN (coalesce(substandard, 0) + coalesce(doubtful, 0) + coalesce(mention, 0)) / 1000 / loans * 100 END"),
    (("dps_row", "ps", "dps"), "dps"), (("share_count", "shares", "count"), '"count"'), (("payout_row", "payout", "dps", "eps"), _pct("dps", "eps")),
    (("core", "core_income"), "core_"), (("core_roaa_row", "core_roaa", "assets"), _pct(f"{_flow('core_')} * 4", _mean("assets"))), (("core_roae_row", "core_roae", "equity"), _pct(f"{_flow('core_')} * 4", _mean("equity"))),
    (("core_eps_row", "core_eps", "count"), 'CASE WHEN "count" <> 0 THEN core_ * 1000 / "count" END'), (("nonrecurring", "nonrecur"), _pct("coalesce(security_gains, 0) + coalesce(extraordinary, 0)", "pretax")),
]
SQL_SHEET = f"""{SQL_FILINGS}, sheet AS (SELECT bank, qi, {", ".join(f'{e} AS "{c}"' for c, e in FIGURES.items())} FROM (SELECT *, bank * 31 + qi * 17 AS k FROM filings)),
cored AS (SELECT *, net_income - coalesce(security_gains, 0) * (1 - {_TAX}) - coalesce(extraordinary, 0) AS core_ FROM sheet)"""


def _sheet(t: Tables) -> DataFrame:
    s = t.filings().withColumn("k", F.expr("bank * 31 + qi * 17")).select("bank", "qi", *(F.expr(e).cast("double").alias(c) for c, e in FIGURES.items()))
    filled = lambda **m: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*(F.col(c) for c in m.values()))), lambda k, v: v.isNotNull())
    named = F.map_filter(F.create_map(F.lit("Card income"), F.col("writein")), lambda k, v: v.isNotNull())
    return s.withColumns({"details": filled(X1="item"), "writeins": named, "grades": filled(substandard="substandard", doubtful="doubtful", special_mention="mention")})


@query("statement_rows", f"WITH {SQL_SHEET} SELECT bank, qi, {', '.join(f'round(({sql}) * 1e6) / 1e6 + 0e0 AS {row[0]}' for row, sql in ROWS)} FROM cored")
def statement_rows(t: Tables) -> DataFrame:
    s = K.statement(_sheet(t), [row for row, _ in ROWS])
    return s.select("bank", "qi", *(rounded(F.col(row[0]), 6).alias(row[0]) for row, _ in ROWS))

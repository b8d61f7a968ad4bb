"""The metrics of every bank and quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import metrics as M
from ledgerline.functions.numbers import rounded

from .base import SQL_FILINGS, Tables, query

_FIELDS = M.fields()
#: Call-report fields over revenue and k = bank * 31 + qi * 17, each missing in its own rows; and the row's market and filing figures.
FIELDS = {f: f"CASE WHEN k % {7 + i % 5} <> {i % 7} THEN revenue * ((k + {i}) % {11 + i % 13}) / 64e0 END" for i, f in enumerate(_FIELDS)}
MARKET = {
    "price": "8e0 + k % 90", "prev_close": "8e0 + k % 89", "shares_outstanding": "1e6 + k % 1000", "eps": "(k % 20 - 4) / 4e0", "tbvps": "CASE WHEN k % 6 <> 0 THEN 4e0 + k % 30 END", "bvps": "6e0 + k % 33",
    "dps": "CASE WHEN k % 5 <> 0 THEN k % 8 / 8e0 END", "roatce_4q": "CASE WHEN k % 4 <> 0 THEN 5e0 + k % 12 END", "roatce_holdco": "CASE WHEN k % 3 = 0 THEN 6e0 + k % 14 END",
}
SQL_REPORT = f"{SQL_FILINGS}, report AS (SELECT bank, qi, qi % 4 + 1 AS quarter, {', '.join(f'{e} AS {c}' for c, e in (FIELDS | MARKET).items())} FROM (SELECT *, bank * 31 + qi * 17 AS k FROM filings))"


def _report(t: Tables) -> DataFrame:
    k = t.filings().withColumn("k", F.expr("bank * 31 + qi * 17"))
    return k.select("bank", "qi", (F.col("qi") % 4 + 1).alias("quarter"), *(F.expr(e).cast("double").alias(c) for c, e in (FIELDS | MARKET).items()))


def _filed(m: M.Metric) -> str:
    return f"{m.source}{' * 4e0 / quarter' if m.ytd else ''}{' * 1000e0' if m.thousands else ''}"


_FILED = {m.key: _filed(m) for m in M.filed()}
_GROSS = "coalesce(nullif(LNLSGR, 0), LNLSNET)"
_TCE = "(EQTOT - coalesce(INTAN, 0))"
_ROATCE = f"(CASE WHEN {_TCE} > 0 THEN NETINC * 4e0 / quarter / {_TCE} * 100 END)"
_BLEND = f"coalesce(roatce_holdco, 0.75e0 * {_ROATCE} + 0.25e0 * roatce_4q, {_ROATCE}, roatce_4q)"
_FAIR = f"(CASE WHEN {_BLEND} > 4 THEN ({_BLEND} - 4e0) / 6e0 END)"
_WITH = {
    "change_pct": "(price / prev_close - 1) * 100", "market_cap": "price * shares_outstanding", "pe_ratio": "CASE WHEN eps > 0 THEN price / eps END", "ptbv_ratio": "price / tbvps", "pb_ratio": "price / bvps", "dividend_yield": "dps / price * 100",
    "roatce": _ROATCE, "roatce_blended": _BLEND, "fair_ptbv": _FAIR, "fair_price": f"{_FAIR} * tbvps", "ptbv_discount": f"({_FAIR} * tbvps - price) / price * 100",
} | {f"ln_{n}_pct": f"CASE WHEN {_GROSS} > 0 THEN {f} / {_GROSS} * 100 END" for n, f in (("re", "LNRE"), ("cre", "LNRENRES"), ("resi", "LNRERES"), ("multifam", "LNREMULT"), ("construct", "LNRECONS"), ("ci", "LNCI"), ("consumer", "LNCON"))} | {
    "cre_to_capital": "CASE WHEN EQTOT > 0 THEN LNRENRES / EQTOT * 100 END", "uninsured_pct": "DEPUNINS / nullif(DEP, 0) * 100", "core_dep_pct": "COREDEP / nullif(DEP, 0) * 100", "brokered_pct": "BRO / nullif(DEP, 0) * 100",
    "nonint_dep_pct": "DEPNIDOM / nullif(DEP, 0) * 100", "sec_to_assets_pct": "CASE WHEN ASSET > 0 THEN SC / ASSET * 100 END", "htm_pct": "CASE WHEN SC > 0 THEN SCHA / SC * 100 END", "nim_spread": "INTINCY - INTEXPY", "nonint_burden": "NONIXAY - NONIIAY",
    "cost_of_funds": "coalesce(INTEXPY, CASE WHEN DEPIDOM > 0 THEN EINTEXP * 4e0 / quarter / (DEPIDOM + coalesce(FREPO, 0) + coalesce(OTHBFHLB, 0) + coalesce(SUBND, 0)) * 100 END)",
    "price": "price", "eps": "eps", "tbvps": "tbvps", "bvps": "bvps", "roatce_4q": "roatce_4q", "roatce_holdco": "roatce_holdco",
}


@query("bank_metrics", f"WITH {SQL_REPORT} SELECT bank, qi, {', '.join(f'round(({e}) * 1e4) / 1e4 + 0e0 AS {k}' for k, e in (_FILED | _WITH).items())} FROM report")
def bank_metrics(t: Tables) -> DataFrame:
    m = M.bank_metrics(_report(t), ["bank", "qi"], F.col("quarter"))
    return m.select("bank", "qi", *(rounded(F.col(c), 4).alias(c) for c in m.columns if c not in ("bank", "qi")))

"""Flows to equity, warranted prices, scenarios, curve shocks, ladders and tie-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import rounded
from ledgerline.operators import rates as R
from ledgerline.operators import valuation as V

from .base import Tables, query
from .valuations import SQL_INPUTS, _dcf, _dcf_sql, _inputs


def _r(sql: str, d: int = 6) -> str:
    return f"round(({sql}) * 1e{d}) / 1e{d} + 0e0"


def _flow_sql(n: int) -> str:
    return f"eps * {n}e0 - 100e0 * pow(1 + 0.05::DOUBLE, {n - 1}) * 0.05::DOUBLE * 0.1::DOUBLE"


@query("fcfe_per_share", f"WITH {SQL_INPUTS} SELECT bank, {', '.join(f'{_r(_flow_sql(n), 4)} AS y{n}' for n in (1, 2, 3))} FROM x")
def fcfe_per_share(t: Tables) -> DataFrame:
    e = F.col("eps")
    flows = V.fcfe(F.array(e, e * 2, e * 3), F.array(*[F.lit(0.05)] * 3), F.lit(100.0), 10.0)
    return _inputs(t).select("bank", flows.alias("f")).select("bank", *(rounded(F.col("f")[n - 1], 4).alias(f"y{n}") for n in (1, 2, 3)))


@query("warranted_grid", f"""WITH {SQL_INPUTS}, p AS (SELECT x.*, r, c FROM x, (SELECT unnest([8.0, 12.0, 16.0]::DOUBLE[]) AS r), (SELECT unnest([3.0, 9.0, 11.0]::DOUBLE[]) AS c))
SELECT bank, r, c, {_r("CASE WHEN c > 4 AND (r - 4) / (c - 4) > 0 THEN (r - 4) / (c - 4) END * price")} AS fair FROM p""")
def warranted_grid(t: Tables) -> DataFrame:
    p = V.grid(_inputs(t), "r", [8.0, 12.0, 16.0], "c", [3.0, 9.0, 11.0])
    return p.select("bank", "r", "c", rounded(V.warranted_price(F.col("r"), F.col("c"), F.lit(4.0), F.col("price")), 6).alias("fair"))


@query("dcf_scenarios", f"""WITH {SQL_INPUTS}, s AS (SELECT bank, 'base' AS scenario, {_dcf_sql()} AS v FROM x UNION ALL SELECT bank, 'bull', {_dcf_sql(g="g + 2", k="k - 1")} FROM x UNION ALL SELECT bank, 'bear', {_dcf_sql(g="g - 2", k="k + 1")} FROM x)
SELECT bank, scenario, round(v, 9) AS value FROM s""")
def dcf_scenarios(t: Tables) -> DataFrame:
    value = lambda s: _dcf(g=s.get("growth", 0.0), k=s.get("coe", 0.0))
    s = V.scenarios(_inputs(t), "bank", value, {"bull": {"growth": 2.0, "coe": -1.0}, "bear": {"growth": -2.0, "coe": 1.0}})
    return s.withColumn("value", F.round("value", 9))


@query("adjusted_growth", f"WITH {SQL_INPUTS} SELECT bank, {_r('g / 100 + (k - 10) * -0.02::DOUBLE')} AS loans, {_r('g / 100 + (k - 10) * -0.01::DOUBLE')} AS deposits, {_r('(k - 10) * 0.005::DOUBLE')} AS securities, {_r('(k - 10) * (-0.02::DOUBLE * 0.7::DOUBLE + 0.005::DOUBLE * 0.3::DOUBLE)')} AS earning_assets FROM x")
def adjusted_growth(t: Tables) -> DataFrame:
    g, zero = F.col("g") / 100, F.lit(0.0)
    out = R.adjusted_growth({"loans": g, "deposits": g, "securities": zero, "earning_assets": zero}, (F.col("k") - 10) * 100)
    return _inputs(t).select("bank", *(rounded(c, 6).alias(n) for n, c in out.items()))


@query("curve_scenario", f"""WITH {SQL_INPUTS}, p AS (SELECT *, greatest(size, 0) * 0.6::DOUBLE AS ib, greatest(size, 0) * 0.2::DOUBLE AS ni, CASE WHEN size > 0 THEN size * 0.8::DOUBLE ELSE 0 END AS dep FROM x),
m AS (SELECT bank, size, (k - 11) * 0.5::DOUBLE * 1e0 - CASE WHEN dep > 0 THEN (ib * (g - 4) / 4 * 0.4::DOUBLE + ni * (g - 4) / 4 * 0e0) / dep ELSE (g - 4) / 4 * 0.4::DOUBLE END AS move FROM p)
SELECT bank, {_r("move * 100")} AS margin_bps, {_r("size * move / 100")} AS income FROM m""")
def curve_scenario(t: Tables) -> DataFrame:
    size, some = F.col("size"), F.greatest(F.col("size"), F.lit(0.0))
    bps, income = R.curve_scenario(F.lit(3.0), size, some * 0.6, some * 0.2, F.when(size > 0, size * 0.8).otherwise(0.0), (F.col("g") - 4) * 25, (F.col("k") - 11) * 50, F.lit(0.4))
    return _inputs(t).select("bank", rounded(bps, 6).alias("margin_bps"), rounded(income, 6).alias("income"))


@query("resolved_beta", f"""WITH {SQL_INPUTS}, b AS (SELECT bank, CASE WHEN bank % 3 = 0 THEN g / 4 END AS c, CASE WHEN bank % 5 <> 0 THEN (k - 10) * 0.9::DOUBLE END AS h FROM x)
SELECT bank, round(CASE WHEN c IS NOT NULL THEN greatest(0, least(1, c)) WHEN h IS NOT NULL THEN greatest(-0.2::DOUBLE, least(1.5::DOUBLE, h)) ELSE 0.5::DOUBLE END, 6) AS beta, CASE WHEN c IS NOT NULL THEN 'custom' WHEN h IS NOT NULL THEN 'historical' ELSE 'textbook_fallback' END AS source FROM b""")
def resolved_beta(t: Tables) -> DataFrame:
    value, source = R.resolved_beta(F.when(F.col("bank") % 3 == 0, F.col("g") / 4), F.when(F.col("bank") % 5 != 0, (F.col("k") - 10) * 0.9))
    return _inputs(t).select("bank", F.round(value, 6).alias("beta"), source.alias("source"))


_AMOUNTS = ["size", "k * 100", "CASE WHEN bank % 3 > 0 THEN g * 80 END", "price * 20", "roe * 10", "CASE WHEN bank % 4 > 0 THEN 50e0 END"]
_TOTAL = " + ".join(f"coalesce({a}, 0)" for a in _AMOUNTS)
_YEARS = " + ".join(f"coalesce({a}, 0) * {(lo + hi) / 2}e0" for a, (_, lo, hi) in zip(_AMOUNTS, R.BUCKETS))


@query("maturity_ladder", f"""WITH {SQL_INPUTS}, l AS (SELECT bank, {_TOTAL} AS total, coalesce(size, 0) AS a, k * 100 AS b, {_YEARS} AS years FROM x)
SELECT bank, {_r("CASE WHEN total > 0 THEN total END")} AS total, {_r("CASE WHEN total > 0 THEN a / total END")} AS floating, {_r("CASE WHEN total > 0 THEN (a + b) / total END")} AS within_year, {_r("CASE WHEN total > 0 THEN years / total END", 3)} AS years FROM l""")
def maturity_ladder(t: Tables) -> DataFrame:
    from ledgerline.functions.numbers import rounded as tidy

    amounts = [F.expr(a) for a in _AMOUNTS]
    l = R.ladder(amounts)
    known = [F.coalesce(a, F.lit(0.0)) for a in amounts]
    years = F.when(l["total"] > 0, sum((a * ((lo + hi) / 2) for a, (_, lo, hi) in zip(known, R.BUCKETS)), F.lit(0.0)) / l["total"])
    return _inputs(t).select("bank", *(tidy(l[c], 6).alias(c) for c in ("total", "floating", "within_year")), tidy(years, 3).alias("years"))


@query("figures_tie_out", f"""WITH {SQL_INPUTS}, f AS (SELECT bank, eps AS s, CASE WHEN bank % 6 > 0 THEN eps * (1 + (bank % 5) / 20e0) END AS r, eps * 1e6 * (1 + (bank % 4) / 60e0) AS income, 1e3 AS shares, (bank % 9) / 3e0 AS p FROM x)
SELECT bank, CASE WHEN s IS NOT NULL AND NOT coalesce(abs(s - r) >= 0.15::DOUBLE * abs(r), false) THEN 'reported' WHEN r IS NOT NULL THEN 'reconstructed' END AS source, coalesce(abs(s - r) >= 0.15::DOUBLE * abs(r), false) AS conflict,
  CASE WHEN s <> 0 THEN abs(income / (shares * 1e3) - s) <= greatest(abs(s) * 0.02::DOUBLE, 0.006::DOUBLE) END AS ties, coalesce(p > 0 AND abs(s) BETWEEN p * 0.2::DOUBLE AND p * 5, false) AS plausible,
  CASE bank % 3 WHEN 0 THEN 4e0 WHEN 1 THEN 1e0 END AS per_year FROM f""")
def figures_tie_out(t: Tables) -> DataFrame:
    b, s = F.col("bank"), F.col("eps")
    r = F.when(b % 6 > 0, s * (1 + (b % 5) / 20))
    _, source, conflict = V.chosen_figure(s, r)
    p = (b % 9) / 3
    period = F.when(b % 3 == 0, "2026q2 ").when(b % 3 == 1, "2026").otherwise("H1")
    return _inputs(t).select(
        "bank", source.alias("source"), conflict.alias("conflict"), V.ties_out(s, s * 1e6 * (1 + (b % 4) / 60), F.lit(1e3)).alias("ties"), V.plausible_quarter(s, F.array(p, p - 1, p + 9)).alias("plausible"), V.per_year(period).alias("per_year")
    )

"""Valuation and rate scenarios on customers as banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import rates as R
from ledgerline.operators import valuation as V

from .base import SQL_FILINGS, Tables, query, spread

SQL_INPUTS = """x AS (SELECT c_custkey AS bank, c_mktsegment AS scope, CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 END AS eps, CAST(2 + c_custkey % 7 AS DOUBLE) AS g, 0.4::DOUBLE AS payout,
  CAST(9 + c_custkey % 4 AS DOUBLE) AS k, CAST(8 + c_custkey % 9 AS DOUBLE) AS roe, CAST(10 + c_custkey % 30 AS DOUBLE) AS price, c_acctbal AS size FROM customer)"""


def _inputs(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    d = lambda e: e.cast("double")
    return t.customer.select(
        k.alias("bank"), F.col("c_mktsegment").alias("scope"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 1000).alias("eps"), d(2 + k % 7).alias("g"), F.lit(0.4).alias("payout"),
        d(9 + k % 4).alias("k"), d(8 + k % 9).alias("roe"), d(10 + k % 30).alias("price"), F.col("c_acctbal").alias("size"),
    )


def _dcf_sql(eps="eps", g="g", payout="payout", k="k", last="3.0") -> str:
    path = " + ".join(f"{eps} * pow(1 + ({g}) / 100, {n}) * {payout} / pow(1 + ({k}) / 100, {n})" for n in range(1, 6))
    return f"CASE WHEN {eps} > 0 AND ({k}) > {last} THEN {path} + {eps} * pow(1 + ({g}) / 100, 5) * (1 + {last} / 100) * {payout} / ((({k}) - {last}) / 100) / pow(1 + ({k}) / 100, 5) END"


def _dcf(g=0.0, k=0.0, payout=0.0):
    return V.dcf(F.col("eps"), F.col("g") + g, F.col("payout") + payout, F.col("k") + k, F.lit(3.0))


@query(
    "valuation_ratios",
    f"""WITH {SQL_INPUTS} SELECT bank, round(CASE WHEN eps > 0 THEN price / eps END, 9) AS pe, round(CASE WHEN price > 0 THEN eps * 0.4 / price * 100 END, 9) AS yield_pct,
  round(CASE WHEN k > 3 AND (roe - 3) / (k - 3) > 0 THEN (roe - 3) / (k - 3) END, 9) AS warranted, round(coalesce(0.75 * roe + 0.25 * eps, roe, eps), 9) AS blended FROM x""",
)
def valuation_ratios(t: Tables) -> DataFrame:
    c = F.col
    return _inputs(t).select(
        "bank", F.round(V.multiple(c("price"), c("eps")), 9).alias("pe"), F.round(V.dividend_yield(c("eps") * 0.4, c("price")), 9).alias("yield_pct"),
        F.round(V.warranted(c("roe"), c("k"), F.lit(3.0)), 9).alias("warranted"), F.round(V.blended(c("roe"), c("eps")), 9).alias("blended"),
    )


@query("dcf_value", f"WITH {SQL_INPUTS} SELECT bank, round({_dcf_sql()}, 9) AS value, round(CASE WHEN price > 0 THEN (({_dcf_sql()}) - price) / price * 100 END, 4) AS upside_pct FROM x")
def dcf_value(t: Tables) -> DataFrame:
    return _inputs(t).select("bank", F.round(_dcf(), 9).alias("value"), F.round(V.upside(F.col("price"), _dcf()), 4).alias("upside_pct"))


@query(
    "dcf_grid",
    f"""WITH {SQL_INPUTS}, p AS (SELECT x.*, dk, dg FROM x, (SELECT unnest([-1.0, 0.0, 1.0]::DOUBLE[]) AS dk), (SELECT unnest([-2.0, 0.0, 2.0]::DOUBLE[]) AS dg))
SELECT bank, dk, dg, round({_dcf_sql(g="g + dg", k="k + dk")}, 9) AS value FROM p""",
)
def dcf_grid(t: Tables) -> DataFrame:
    p = V.grid(_inputs(t), "dk", [-1.0, 0.0, 1.0], "dg", [-2.0, 0.0, 2.0])
    return p.select("bank", "dk", "dg", F.round(_dcf(g=F.col("dg"), k=F.col("dk")), 9).alias("value"))


@query(
    "warranted_rank",
    f"""WITH {SQL_INPUTS}, m AS (SELECT bank, scope, CASE WHEN k > 3 AND (roe - 3) / (k - 3) > 0 THEN (roe - 3) / (k - 3) END * size / 1000 AS fair, price FROM x),
u AS (SELECT bank, scope, round((fair - price) / price * 100, 9) AS upside FROM m)
SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY upside DESC NULLS LAST, bank) AS INTEGER) AS place FROM u""",
)
def warranted_rank(t: Tables) -> DataFrame:
    fair = V.warranted(F.col("roe"), F.col("k"), F.lit(3.0)) * F.col("size") / 1000
    u = _inputs(t).select("bank", "scope", F.round(V.upside(F.col("price"), fair), 9).alias("upside"))
    return u.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc_nulls_last("upside"), "bank")))


_CHANGE = "size * (0.3 + 0.7 * least(1.0, year / 2.5)) * shock_bps / 10000.0 - size * 0.8 * 0.4 * shock_bps / 10000.0"


@query(
    "rate_matrix",
    f"""WITH {SQL_INPUTS}, p AS (SELECT x.*, s, l FROM x, (SELECT unnest([-200.0, -100.0, 0.0, 100.0, 200.0]::DOUBLE[]) AS s), (SELECT unnest([-200.0, -100.0, 0.0, 100.0, 200.0]::DOUBLE[]) AS l))
SELECT bank, s AS short_bps, l AS long_bps, round(size * 0.3 * s / 10000 + size * 0.7 * 0.4 * l / 10000 - size * 0.8 * 0.4 * s / 10000, 9) AS change FROM p""",
)
def rate_matrix(t: Tables) -> DataFrame:
    steps = [-200.0, -100.0, 0.0, 100.0, 200.0]
    p = V.grid(_inputs(t), "short_bps", steps, "long_bps", steps)
    s, l, size = F.col("short_bps"), F.col("long_bps"), F.col("size")
    change = size * 0.3 * s / 10000 + size * 0.7 * 0.4 * l / 10000 - size * 0.8 * 0.4 * s / 10000
    return p.select("bank", "short_bps", "long_bps", F.round(change, 9).alias("change"))


@query(
    "phased_scenario",
    f"""WITH {SQL_INPUTS}, p AS (SELECT x.*, shock_bps, year FROM x, (SELECT unnest([-100.0, 100.0]::DOUBLE[]) AS shock_bps), (SELECT unnest([1, 2, 3]) AS year))
SELECT bank, shock_bps, year, round({_CHANGE}, 9) AS change FROM p""",
)
def phased_scenario(t: Tables) -> DataFrame:
    size = F.col("size")

    def change(shock, year):
        share = F.least(F.lit(1.0), year / 2.5)
        return F.round(R.income_change(size, size * 0.8, F.lit(0.3), F.lit(0.4), shock, share), 9)

    return R.phased(_inputs(t), "bank", [-100.0, 100.0], 3, change)


@query(
    "tornado",
    f"""WITH {SQL_INPUTS}, c AS (SELECT bank, 'coe' AS param, {_dcf_sql(k="k - 1")} AS low, {_dcf_sql(k="k + 1")} AS high FROM x
UNION ALL SELECT bank, 'growth', {_dcf_sql(g="g - 2")}, {_dcf_sql(g="g + 2")} FROM x UNION ALL SELECT bank, 'payout', {_dcf_sql(payout="(payout - 0.1)")}, {_dcf_sql(payout="(payout + 0.1)")} FROM x)
SELECT bank, param, round(low, 9) AS low, round(high, 9) AS high, round(abs(high - low), 9) AS spread FROM c""",
)
def tornado(t: Tables) -> DataFrame:
    out = V.tornado(_inputs(t), "bank", lambda s: _dcf(g=s["growth"], k=s["coe"], payout=s["payout"]), {"coe": 1.0, "growth": 2.0, "payout": 0.1})
    return out.select("bank", "param", *(F.round(c, 9).alias(c) for c in ("low", "high", "spread")))


def _worth_sql(k: str) -> str:
    paid = " + ".join(f"power((1 + g / 100) / (1 + ({k}) / 100), {i})" for i in range(1, 6))
    return f"eps * payout * ({paid} + power((1 + g / 100) / (1 + ({k}) / 100), 5) * 1.03 / ((({k}) - 3) / 100))"


@query(
    "implied_irr",
    f"""WITH {SQL_INPUTS}, s AS (SELECT bank, price, {_worth_sql("3.5e0")} AS high, {_worth_sql("60e0")} AS low, list_reduce(list_concat([[3.5e0, 60e0]], list_transform(range(60), lambda i: [0e0, 0e0])),
  lambda a, i: CASE WHEN {_worth_sql("(a[1] + a[2]) / 2")} > price THEN [(a[1] + a[2]) / 2, a[2]] ELSE [a[1], (a[1] + a[2]) / 2] END) AS ends FROM x)
SELECT bank, price, CASE WHEN high >= price AND low <= price THEN round((ends[1] + ends[2]) / 2, 6) END AS rate FROM s""",
)
def implied_irr(t: Tables) -> DataFrame:
    x = spread(_inputs(t), "bank")
    value = lambda k: V.dcf(F.col("eps"), F.col("g"), F.col("payout"), k, F.lit(3.0))
    return x.select("bank", "price", F.round(V.implied_rate(F.col("price"), value), 6).alias("rate"))


@query(
    "deposit_betas",
    f"""WITH {SQL_INPUTS} SELECT bank, round(CASE WHEN size * 0.3 + roe * 100 + k * 50 > 0 THEN least(1.5, greatest(0.0, (size * 0.3 * 0.0 + roe * 100 * 0.5 + k * 50 * 0.8) / (size * 0.3 + roe * 100 + k * 50))) END, 9) AS beta,
  round(CASE WHEN roe > 0 THEN least(1.0, 1 / (roe / 4)) END, 9) AS pace_1, round(CASE WHEN roe > 0 THEN least(1.0, 2 / (roe / 4)) END, 9) AS pace_2 FROM x""",
)
def deposit_betas(t: Tables) -> DataFrame:
    c = F.col
    beta = R.blended_beta([c("size") * 0.3, c("roe") * 100, c("k") * 50], [0.0, 0.5, 0.8])
    one, two = R.pace(c("roe") / 4, 2)
    return _inputs(t).select("bank", F.round(beta, 9).alias("beta"), F.round(one, 9).alias("pace_1"), F.round(two, 9).alias("pace_2"))


@query(
    "walk_forward_backtest",
    f"""WITH {SQL_FILINGS}, f AS (SELECT bank, qi, revenue AS actual, lag(revenue, 4) OVER w AS base, lag(revenue, 8) OVER w AS b8 FROM filings WINDOW w AS (PARTITION BY bank ORDER BY qi)),
p AS (SELECT f.*, base * base / b8 AS predicted, c_mktsegment AS scope FROM f JOIN customer ON bank = c_custkey WHERE b8 > 0 AND base IS NOT NULL)
SELECT scope, count(*) AS n, round(sqrt(avg((predicted - actual) * (predicted - actual))), 2) AS rmse, round(avg(predicted - actual), 2) AS bias, round(corr(predicted - base, actual - base), 9) AS corr,
  round(avg(CASE WHEN sign(predicted - base) = sign(actual - base) THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM p GROUP BY 1""",
)
def walk_forward_backtest(t: Tables) -> DataFrame:
    b = R.backtest(t.filings(), "bank", "qi", "revenue").join(t.customer.select(F.col("c_custkey").alias("bank"), F.col("c_mktsegment").alias("scope")), "bank")
    e = R.errors(b, ["scope"])
    return e.select("scope", "n", F.round("rmse", 2).alias("rmse"), F.round("bias", 2).alias("bias"), F.round("corr", 9).alias("corr"), F.round("hit_rate", 9).alias("hit_rate"))

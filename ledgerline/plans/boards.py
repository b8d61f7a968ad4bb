"""Boards: consolidations, surprise rankings, peer tables and skipped markets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import rounded
from ledgerline.operators import markets as M
from ledgerline.operators import peers as P
from ledgerline.operators import registers as G

from .aggregates import SQL_BEAT, _beats
from .base import SQL_BRANCHES, SQL_FILINGS, Tables, query


@query("merger_skipped", f"WITH {SQL_BRANCHES}, z AS (SELECT market % 5 AS market, bank % 3 AS bank, CASE WHEN bank % 3 = 2 AND market % 2 = 0 THEN 0 ELSE deposits END AS deposits FROM branch_deposits), m AS (SELECT market, sum(deposits) FILTER (WHERE bank = 1) AS a, sum(deposits) FILTER (WHERE bank = 2) AS b FROM z GROUP BY 1) SELECT market, 'zero deposits' AS reason FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND (a <= 0 OR b <= 0)")
def merger_skipped(t: Tables) -> DataFrame:
    d = t.branch_deposits()
    z = d.select((F.col("market") % 5).alias("market"), (F.col("bank") % 3).alias("bank"), F.when((F.col("bank") % 3 == 2) & (F.col("market") % 2 == 0), 0.0).otherwise(F.col("deposits")).alias("deposits"))
    return M.skipped(z, 1, 2)


@query(
    "consolidated_records",
    f"""WITH {SQL_FILINGS}, j AS (SELECT c_nationkey AS holder, qi, bank, revenue, CASE WHEN bank % 4 > 0 THEN filings * 10e0 END AS income, bank % 17 / 4e0 AS roa, c_acctbal FROM filings JOIN customer ON bank = c_custkey)
SELECT holder, qi, round(sum(revenue), 2) AS revenue, sum(income) AS income, round(CASE WHEN sum(revenue) <> 0 THEN sum(income) / sum(revenue) * 100 END, 6) AS margin, CASE WHEN count(*) = 1 THEN max(roa) END AS roa,
  arg_max(bank, {{'a': c_acctbal, 'b': -bank}}) AS lead, count(*) AS members FROM j GROUP BY 1, 2""",
)
def consolidated_records(t: Tables) -> DataFrame:
    j = t.filings().join(t.customer, F.col("bank") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("holder"), "qi", "bank", "revenue", F.when(F.col("bank") % 4 > 0, F.col("filings") * 10.0).alias("income"), (F.col("bank") % 17 / 4).alias("roa"), "c_acctbal"
    )
    out = G.consolidated(j, ["holder", "qi"], "bank", "c_acctbal", ["revenue", "income"], {"margin": ("income", "revenue")}, ["roa"])
    return out.withColumns({"revenue": F.round("revenue", 2), "margin": F.round("margin", 6)})


@query(
    "surprise_rankings",
    f"""{SQL_BEAT}, k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY surprise_pct DESC, ticker, period) AS up, row_number() OVER (PARTITION BY metric ORDER BY surprise_pct, ticker, period) AS down FROM x WHERE surprise_pct IS NOT NULL)
SELECT metric, ticker, period, surprise_pct, 'beat' AS side FROM k WHERE up <= 5 UNION ALL SELECT metric, ticker, period, surprise_pct, 'miss' FROM k WHERE down <= 5""",
)
def surprise_rankings(t: Tables) -> DataFrame:
    b = _beats(t).where("surprise_pct is not null")
    tie = [F.col("ticker"), F.col("period")]
    up = G.top(b, ["metric"], [F.desc("surprise_pct"), *tie], 5).withColumn("side", F.lit("beat"))
    down = G.top(b, ["metric"], [F.asc("surprise_pct"), *tie], 5).withColumn("side", F.lit("miss"))
    return up.unionByName(down).select("metric", "ticker", "period", "surprise_pct", "side")


@query("surprise_heatmap", f"{SQL_BEAT} SELECT ticker, metric, {', '.join(f'max(CASE WHEN period = {y} THEN surprise_pct END) AS y{y}' for y in range(1996, 2002))} FROM x GROUP BY 1, 2")
def surprise_heatmap(t: Tables) -> DataFrame:
    years = list(range(1996, 2002))
    p = _beats(t).groupBy("ticker", "metric").pivot("period", years).agg(F.max("surprise_pct"))
    return p.select("ticker", "metric", *(F.col(str(y)).alias(f"y{y}") for y in years))


SQL_COHORT = f"""{SQL_FILINGS}, cohort AS (SELECT c_custkey AS bank, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS capital, max_by(revenue, qi) AS latest FROM customer LEFT JOIN filings ON bank = c_custkey GROUP BY 1, 2)"""


def _cohort(t: Tables) -> DataFrame:
    last = t.filings().groupBy("bank").agg(F.max_by("revenue", "qi").alias("latest"))
    return t.customer.select(F.col("c_custkey").alias("bank"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("capital")).join(last, "bank", "left")


@query("peer_highlights", f"""WITH {SQL_COHORT} SELECT 'capital' AS metric, arg_max(bank, {{'v': capital, 'b': -bank}}) FILTER (WHERE capital IS NOT NULL) AS bank, max(capital) AS value FROM cohort
UNION ALL SELECT 'latest', arg_min(bank, {{'v': latest, 'b': bank}}) FILTER (WHERE latest IS NOT NULL), min(latest) FROM cohort""")
def peer_highlights(t: Tables) -> DataFrame:
    return G.best_of_each(_cohort(t), "bank", {"capital": True, "latest": False})


@query("peer_table", f"""WITH {SQL_COHORT}, u AS (SELECT bank, metric, value FROM cohort UNPIVOT (value FOR metric IN (capital, latest))), m AS (SELECT *, median(value) OVER (PARTITION BY metric) AS median FROM u)
SELECT metric, bank, value, round(median, 4) AS median, round((value - median) * 1e4) / 1e4 + 0e0 AS gap FROM m""")
def peer_table(t: Tables) -> DataFrame:
    g = G.against_median(_cohort(t), "bank", ["capital", "latest"])
    return g.select("metric", "bank", "value", F.round("median", 4).alias("median"), rounded(F.col("gap"), 4).alias("gap"))


@query("radar_values", f"""WITH {SQL_COHORT}, u AS (SELECT bank, metric, value FROM cohort UNPIVOT (value FOR metric IN (capital, latest))),
r AS (SELECT bank, metric, (rank() OVER (PARTITION BY metric ORDER BY value) - 1 + 0.5 * count(*) OVER (PARTITION BY metric, value)) / count(*) OVER (PARTITION BY metric) * 100 AS p FROM u)
SELECT bank, metric, round(CASE WHEN metric = 'latest' THEN 100 - p ELSE p END, 6) AS percentile FROM r""")
def radar_values(t: Tables) -> DataFrame:
    u = _cohort(t).unpivot(["bank"], ["capital", "latest"], "metric", "value").where("value is not null")
    p = P.hazen(["metric"], "value")
    return u.select("bank", "metric", p.alias("p")).select("bank", "metric", F.round(F.when(F.col("metric") == "latest", 100 - F.col("p")).otherwise(F.col("p")), 6).alias("percentile"))

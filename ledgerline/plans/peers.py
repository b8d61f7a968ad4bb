"""Projections, screens and peer comparisons over banks with their filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import banded, size_tier
from ledgerline.functions.registry import Metric, project
from ledgerline.operators import peers as P
from ledgerline.operators import timeseries as T
from ledgerline.operators.order import placed
from ledgerline.operators.screen import Spec, screen

from .base import SQL_FILINGS, Tables, query

BANDS = [0.0, 2000.0, 4000.0, 7000.0]
BAND_NAMES = ["negative", "tiny", "small", "middle", "large"]
BAND_SQL = "CASE WHEN x IS NULL THEN NULL WHEN x < 0 THEN 'negative' WHEN x < 2000 THEN 'tiny' WHEN x < 4000 THEN 'small' WHEN x < 7000 THEN 'middle' ELSE 'large' END"
TIER_SQL = "CASE WHEN a IS NULL OR a <= 0 THEN NULL WHEN a >= 250e9 THEN 'mega' WHEN a >= 50e9 THEN 'large' WHEN a >= 10e9 THEN 'regional' ELSE 'community' END"


@query(
    "scan_project_filter",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL
  ORDER BY c_acctbal DESC, c_custkey LIMIT 100""",
)
def scan_project_filter(t: Tables) -> DataFrame:
    kept = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").isNotNull())
    return kept.select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)


@query(
    "registry_projection",
    f"""WITH {SQL_FILINGS}, y AS (SELECT bank, qi, revenue, filings, CAST(qi % 4 + 1 AS BIGINT) AS quarter,
  round(sum(revenue) OVER (PARTITION BY bank, qi // 4 ORDER BY qi), 2) AS ytd FROM filings)
SELECT bank, qi, round(revenue * 1000.0, 2) AS revenue_usd, round(ytd * 4.0 / quarter, 4) AS revenue_annualised,
  round(CASE WHEN filings > 0 THEN revenue / filings END, 4) AS per_filing FROM y""",
)
def registry_projection(t: Tables) -> DataFrame:
    y = T.year_to_date(t.filings(), "bank", "qi", "revenue").withColumn("ytd", F.round("ytd", 2))
    metrics = [Metric("revenue_usd", "revenue", thousands=True), Metric("revenue_annualised", "ytd", ytd=True), Metric("per_filing", "case when filings > 0 then revenue / filings end")]
    out = project(y, metrics, ["bank", "qi"], F.col("qi") % 4 + 1)
    return out.select("bank", "qi", F.round("revenue_usd", 2).alias("revenue_usd"), F.round("revenue_annualised", 4).alias("revenue_annualised"), F.round("per_filing", 4).alias("per_filing"))


@query(
    "tier_band_classify",
    f"""SELECT c_custkey, {TIER_SQL.replace("a ", "c_acctbal * 3e7 ")} AS tier, {BAND_SQL.replace("x ", "c_acctbal ")} AS band FROM customer""",
)
def tier_band_classify(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", size_tier(F.col("c_acctbal") * 3e7).alias("tier"), banded(F.col("c_acctbal"), BANDS, BAND_NAMES).alias("band"))


def _profile(t: Tables, n: int = 5) -> DataFrame:
    """One row per customer: scope, acctbal (null if negative) and its revenue history as an array of n, newest first."""
    w = Window.partitionBy("bank").orderBy(F.desc("qi"))
    h = t.filings().withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    h = h.groupBy("bank").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "revenue"))), lambda x: x["revenue"]).alias("history"), F.max_by("revenue", "qi").alias("latest"))
    c = t.customer.select(F.col("c_custkey").alias("bank"), F.col("c_mktsegment").alias("scope"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("capital"))
    return c.join(h, "bank", "left")


SQL_PROFILE = f"""{SQL_FILINGS}, hist AS (SELECT bank, max(CASE WHEN r = 1 THEN revenue END) AS h0, max(CASE WHEN r = 2 THEN revenue END) AS h1,
  max(CASE WHEN r = 3 THEN revenue END) AS h2, max(CASE WHEN r = 5 THEN revenue END) AS h4
  FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS r FROM filings) GROUP BY bank),
profile AS (SELECT c_custkey AS bank, c_mktsegment AS scope, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS capital, h0, h1, h2, h4
  FROM customer LEFT JOIN hist ON c_custkey = bank),
pct AS (SELECT *, CASE WHEN capital IS NOT NULL THEN (rank() OVER (PARTITION BY scope, capital IS NULL ORDER BY capital) - 1
    + 0.5 * count(*) OVER (PARTITION BY scope, capital)) / count(capital) OVER (PARTITION BY scope) * 100 END AS p_capital,
  CASE WHEN h0 IS NOT NULL THEN (rank() OVER (PARTITION BY scope, h0 IS NULL ORDER BY h0) - 1
    + 0.5 * count(*) OVER (PARTITION BY scope, h0)) / count(h0) OVER (PARTITION BY scope) * 100 END AS p_latest FROM profile)"""


def _outcome(*verdicts: str) -> str:
    out = "'keep'"
    for v in reversed(verdicts):
        out = f"CASE WHEN ({v}) IS NULL THEN 'nodata' WHEN NOT ({v}) THEN 'fail' ELSE {out} END"
    return f"WITH {SQL_PROFILE} SELECT bank, {out} AS outcome FROM pct"


def _screened(name: str, specs: list[Spec], *verdicts: str) -> None:
    query(name, _outcome(*verdicts))(lambda t: screen(_profile(t), specs, ["scope"]).select("bank", "outcome"))


_screened("screen_absolute", [Spec("absolute", "capital", ">", 5000.0)], "capital > 5000")
_screened("screen_peer_relative", [Spec("peer", "capital", "top", 25)], "p_capital >= 75")
_screened("screen_change", [Spec("change", "history", ">", 0.0, 1), Spec("change", "history", ">", -50000.0, 4)], "h0 - h1 > 0", "h0 - h4 > -50000")
_screened("screen_trend", [Spec("trend", "history", "up", 0, 2)], "CASE WHEN h0 - h1 IS NOT NULL AND h1 - h2 IS NOT NULL THEN h0 - h1 > 0 AND h1 - h2 > 0 END")
_screened(
    "screen_mixed_nodata", [Spec("absolute", "capital", ">=", 1000.0), Spec("peer", "latest", "bottom", 50), Spec("change", "history", "<", 0.0, 1)],
    "capital >= 1000", "p_latest <= 50", "h0 - h1 < 0",
)
query(
    "screen_top_growth",
    f"WITH {SQL_PROFILE} SELECT bank, scope, h0 AS latest, round(p_latest, 6) AS percentile FROM pct WHERE p_latest >= 75 AND h0 - h1 > 0",
)(
    lambda t: screen(_profile(t).withColumn("percentile", P.hazen(["scope"], "latest")), [Spec("peer", "latest", "top", 25), Spec("change", "history", ">", 0.0, 1)], ["scope"])
    .where("outcome = 'keep'").select("bank", "scope", "latest", F.round("percentile", 6).alias("percentile"))
)
query("screen_counts", f"WITH {SQL_PROFILE} SELECT outcome, count(*) AS banks FROM ({_outcome('capital >= 1000', 'h0 - h1 > 0')}) GROUP BY outcome".replace(f"(WITH {SQL_PROFILE} SELECT", "(SELECT"))(
    lambda t: screen(_profile(t), [Spec("absolute", "capital", ">=", 1000.0), Spec("change", "history", ">", 0.0, 1)], ["scope"]).groupBy("outcome").agg(F.count("*").alias("banks"))
)


def _capital(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("bank"), F.col("c_mktsegment").alias("scope"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("capital"))


SQL_CAPITAL = "k AS (SELECT c_custkey AS bank, c_mktsegment AS scope, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS capital FROM customer)"
SQL_HAZEN = """CASE WHEN capital IS NOT NULL THEN (rank() OVER (PARTITION BY scope, capital IS NULL ORDER BY capital) - 1
  + 0.5 * count(*) OVER (PARTITION BY scope, capital)) / count(capital) OVER (PARTITION BY scope) * 100 END"""


@query("peer_hazen", f"WITH {SQL_CAPITAL} SELECT bank, scope, round({SQL_HAZEN}, 6) AS percentile FROM k")
def peer_hazen(t: Tables) -> DataFrame:
    return _capital(t).select("bank", "scope", F.round(P.hazen(["scope"], "capital"), 6).alias("percentile"))


@query(
    "peer_avg_rank",
    f"""WITH {SQL_CAPITAL}, r AS (SELECT *, rank() OVER (PARTITION BY scope, capital IS NULL ORDER BY capital) AS up,
  rank() OVER (PARTITION BY scope, capital IS NULL ORDER BY capital DESC) AS down, count(*) OVER (PARTITION BY scope, capital) AS ties,
  count(capital) OVER (PARTITION BY scope) AS n FROM k)
SELECT bank, round(CASE WHEN capital IS NOT NULL AND n >= 2 THEN (up + (ties - 1) / 2.0) / n * 100 END, 6) AS higher_better,
  round(CASE WHEN capital IS NOT NULL AND n >= 2 THEN (down + (ties - 1) / 2.0) / n * 100 END, 6) AS lower_better FROM r""",
)
def peer_avg_rank(t: Tables) -> DataFrame:
    up, down = P.average_rank(["scope"], "capital"), P.average_rank(["scope"], "capital", False)
    return _capital(t).select("bank", F.round(up, 6).alias("higher_better"), F.round(down, 6).alias("lower_better"))


@query(
    "peer_context",
    f"""WITH {SQL_CAPITAL}, p AS (SELECT *, {SQL_HAZEN} AS pct, count(capital) OVER (PARTITION BY scope) AS n, median(capital) OVER (PARTITION BY scope) AS med,
  rank() OVER (PARTITION BY scope, capital IS NULL ORDER BY capital) AS rk FROM k)
SELECT bank, n, round(pct, 6) AS percentile, round(100 - pct, 6) AS goodness, round(CASE WHEN pct IS NOT NULL THEN med END, 4) AS median,
  CASE WHEN pct IS NOT NULL THEN rk END AS min_rank FROM p""",
)
def peer_context(t: Tables) -> DataFrame:
    c = P.context(_capital(t), ["scope"], "capital", 5, higher_better=False)
    return c.select("bank", "n", F.round("percentile", 6).alias("percentile"), F.round("goodness", 6).alias("goodness"), F.round("median", 4).alias("median"), F.col("min_rank").cast("long").alias("min_rank"))


@query(
    "peer_composite",
    f"""WITH {SQL_PROFILE}, s AS (SELECT bank, p_capital AS a, 100 - p_latest AS b FROM pct)
SELECT bank, round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END, 6) AS score,
  (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n_metrics, coalesce((a >= 80)::INT, 0) + coalesce((b >= 80)::INT, 0) AS n_top,
  coalesce((a < 20)::INT, 0) + coalesce((b < 20)::INT, 0) AS n_bottom FROM s""",
)
def peer_composite(t: Tables) -> DataFrame:
    c = P.composite(_profile(t), "bank", ["scope"], {"capital": True, "latest": False})
    return c.select("bank", F.round("score", 6).alias("score"), "n_metrics", "n_top", "n_bottom")


@query(
    "nearest_peers",
    """WITH k AS (SELECT c_custkey AS bank, c_nationkey AS scope, c_acctbal AS size FROM customer),
p AS (SELECT a.bank, b.bank AS peer, round(abs(a.size - b.size), 2) AS distance,
  row_number() OVER (PARTITION BY a.bank ORDER BY round(abs(a.size - b.size), 2), b.bank) AS rank FROM k a JOIN k b ON a.scope = b.scope AND a.bank <> b.bank)
SELECT bank, peer, distance, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 5""",
)
def nearest_peers(t: Tables) -> DataFrame:
    k = t.customer.select(F.col("c_custkey").alias("bank"), F.col("c_nationkey").alias("scope"), F.col("c_acctbal").cast("decimal(18,2)").alias("size"))
    return P.nearest(k, ["scope"], "bank", "size", 5).select("bank", "peer", F.col("distance").cast("double").alias("distance"), "rank")


@query(
    "leaderboard",
    f"WITH {SQL_CAPITAL} SELECT bank, scope, capital, rank() OVER (PARTITION BY scope ORDER BY capital DESC NULLS LAST) AS place FROM k QUALIFY place <= 10",
)
def leaderboard(t: Tables) -> DataFrame:
    w = Window.partitionBy("scope").orderBy(F.desc_nulls_last("capital"))
    return _capital(t).withColumn("place", F.rank().over(w)).where("place <= 10").select("bank", "scope", "capital", F.col("place").cast("long").alias("place"))


@query(
    "screen_sort_nulls_first",
    f"WITH {SQL_CAPITAL} SELECT bank, capital, row_number() OVER (ORDER BY capital DESC NULLS FIRST, bank) AS place FROM k",
)
def screen_sort(t: Tables) -> DataFrame:
    return placed(_capital(t).select("bank", "capital"), [F.desc_nulls_first("capital"), F.asc("bank")], "place")

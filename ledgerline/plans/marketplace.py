"""Market shares, concentration, mergers and branch geography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import geo
from ledgerline.operators import markets as M

from .base import SQL_BRANCHES, Tables, query


@query(
    "market_share",
    f"""WITH {SQL_BRANCHES} SELECT market, bank, deposits, round(deposits / sum(deposits) OVER (PARTITION BY market) * 100, 6) AS share,
  CAST(rank() OVER (PARTITION BY market ORDER BY deposits DESC) AS INTEGER) AS rank FROM branch_deposits""",
)
def market_share(t: Tables) -> DataFrame:
    return M.shares(t.branch_deposits()).withColumn("share", F.round("share", 6))


@query(
    "market_hhi",
    f"""WITH {SQL_BRANCHES}, h AS (SELECT market, count(*) AS n, sum(deposits) AS total, sum(deposits * deposits) / (sum(deposits) * sum(deposits)) * 10000 AS hhi
  FROM branch_deposits GROUP BY 1)
SELECT market, n, round(total, 2) AS total, round(hhi, 4) AS hhi,
  CASE WHEN hhi < 1500 THEN 'unconcentrated' WHEN hhi <= 2500 THEN 'moderate' WHEN hhi > 2500 THEN 'high' END AS band FROM h""",
)
def market_hhi(t: Tables) -> DataFrame:
    return M.hhi(t.branch_deposits()).withColumn("total", F.round("total", 2)).withColumn("hhi", F.round("hhi", 4))


SQL_REGIONS = f"""{SQL_BRANCHES}, held AS (SELECT n_regionkey AS market, bank % 20 AS bank, round(sum(deposits), 2) AS deposits
  FROM branch_deposits JOIN nation ON market = n_nationkey GROUP BY 1, 2)"""


def _regional(t: Tables) -> DataFrame:
    """Deposits of 20 bank groups by region, so that groups share markets."""
    j = t.branch_deposits().join(t.nation, F.col("market") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("market"), (F.col("bank") % 20).alias("bank")).agg(F.round(F.sum("deposits"), 2).alias("deposits"))


@query(
    "market_overlap",
    f"""WITH {SQL_REGIONS} SELECT a.market, a.deposits AS deposits_a, b.deposits AS deposits_b, round(a.deposits + b.deposits, 2) AS combined
  FROM held a JOIN held b ON a.market = b.market WHERE a.bank = 1 AND b.bank = 2""",
)
def market_overlap(t: Tables) -> DataFrame:
    return M.overlap(_regional(t), 1, 2).withColumn("combined", F.round("combined", 2))


@query(
    "market_proforma",
    f"""WITH {SQL_REGIONS}, s AS (SELECT market, bank, deposits / sum(deposits) OVER (PARTITION BY market) * 100 AS share FROM held),
m AS (SELECT market, max(CASE WHEN bank = 1 THEN share END) AS share_a, max(CASE WHEN bank = 2 THEN share END) AS share_b, sum(share * share) AS pre,
  sum(CASE WHEN bank NOT IN (1, 2) THEN share * share END) AS others FROM s GROUP BY 1)
SELECT market, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b, round(pre, 4) AS pre,
  round(coalesce(others, 0) + (share_a + share_b) * (share_a + share_b), 4) AS post,
  round(coalesce(others, 0) + (share_a + share_b) * (share_a + share_b) - pre, 4) AS delta,
  coalesce(others, 0) + (share_a + share_b) * (share_a + share_b) > 1800 AND 2 * share_a * share_b > 200 AS flagged
FROM m WHERE share_a > 0 AND share_b > 0""",
)
def market_proforma(t: Tables) -> DataFrame:
    m = M.pro_forma(_regional(t), 1, 2)
    return m.select("market", F.round("share_a", 6).alias("share_a"), F.round("share_b", 6).alias("share_b"), F.round("pre", 4).alias("pre"), F.round("post", 4).alias("post"), F.round("delta", 4).alias("delta"), "flagged")


@query("market_semi_join", f"WITH {SQL_REGIONS} SELECT market, bank, deposits FROM held WHERE market IN (SELECT DISTINCT market FROM held WHERE bank = 3)")
def market_semi_join(t: Tables) -> DataFrame:
    return M.participants(_regional(t), 3)


@query(
    "market_top_competitor",
    f"""WITH {SQL_REGIONS}, s AS (SELECT *, deposits / sum(deposits) OVER (PARTITION BY market) * 100 AS share FROM held),
p AS (SELECT a.market, a.bank, a.share, b.bank AS top_competitor, b.share AS top_share,
  row_number() OVER (PARTITION BY a.market, a.bank ORDER BY b.deposits DESC, b.bank) AS r FROM s a LEFT JOIN s b ON a.market = b.market AND a.bank <> b.bank)
SELECT market, bank, round(share, 6) AS share, top_competitor, round(top_share, 6) AS top_share FROM p WHERE r = 1""",
)
def market_top_competitor(t: Tables) -> DataFrame:
    c = M.competitors(M.shares(_regional(t)))
    return c.select("market", "bank", F.round("share", 6).alias("share"), "top_competitor", F.round("top_share", 6).alias("top_share"))


@query(
    "branch_rollup",
    f"""WITH {SQL_BRANCHES} SELECT n_name AS state, count(*) AS branches, round(sum(deposits), 2) AS deposits, max(s_name) AS label
  FROM branch_deposits JOIN supplier ON bank = s_suppkey JOIN nation ON market = n_nationkey GROUP BY 1""",
)
def branch_rollup(t: Tables) -> DataFrame:
    j = t.branch_deposits().join(t.supplier, F.col("bank") == F.col("s_suppkey")).join(t.nation, F.col("market") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("state")).agg(F.count("*").alias("branches"), F.round(F.sum("deposits"), 2).alias("deposits"), F.max("s_name").alias("label"))


SQL_POINTS = """pts AS (SELECT c_custkey AS id, 30 + (c_custkey * 7919 % 10000) / 1000.0::DOUBLE AS lat, -90 + (c_custkey * 104729 % 10000) / 1000.0::DOUBLE AS lng FROM customer)"""
SQL_MILES = """2 * 3958.7613 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"""


def _points(t: Tables) -> DataFrame:
    """Customers on a deterministic 10 x 10 degree plane."""
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), (30 + (k * 7919 % 10000) / 1000.0).alias("lat"), (-90 + (k * 104729 % 10000) / 1000.0).alias("lng"))


@query(
    "geo_radius_pairs",
    f"""WITH {SQL_POINTS} SELECT a.id AS id, b.id AS other, round({SQL_MILES}, 6) AS miles FROM pts a JOIN pts b ON a.id <> b.id
  WHERE {SQL_MILES} <= 15""",
)
def geo_radius_pairs(t: Tables) -> DataFrame:
    p = _points(t)
    return geo.within(p, p, 15.0, 6).where("id != other")


@query(
    "geo_nearest",
    f"""WITH {SQL_POINTS}, p AS (SELECT a.id AS id, b.id AS other, {SQL_MILES} AS miles FROM pts a JOIN pts b ON a.id <> b.id)
SELECT id, other, round(miles, 6) AS miles, CAST(rank AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(miles, 9), other) AS rank FROM p WHERE miles <= 60) WHERE rank <= 5""",
)
def geo_nearest(t: Tables) -> DataFrame:
    p = _points(t)
    return geo.nearest(p, p, 5, 60.0).withColumn("miles", F.round("miles", 6))

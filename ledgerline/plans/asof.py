"""As-of and interval joins between trading days, filings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import asof as A
from ledgerline.operators import timeseries as T

from .base import SQL_FILINGS, Tables, query

SQL_FACTS = f"""{SQL_FILINGS}, facts AS (SELECT bank, CAST(make_date(CAST(qi // 4 AS BIGINT), CAST(qi % 4 * 3 + 1 AS BIGINT), 1) + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS dt, qi, revenue FROM filings)"""
SQL_PROBES = "probes AS (SELECT o_orderkey AS trade, o_custkey AS bank, CAST(o_orderdate AS DATE) AS dt, o_totalprice AS price FROM orders)"


def _facts(t: Tables) -> DataFrame:
    """Filings as published: 45 days into the next quarter."""
    first = F.make_date(F.floor(F.col("qi") / 4).cast("int"), (F.col("qi") % 4 * 3 + 1).cast("int"), F.lit(1))
    return t.filings().select("bank", F.date_add(F.add_months(first, 3), 44).alias("dt"), "qi", "revenue")


def _probes(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("trade"), F.col("o_custkey").alias("bank"), F.to_date("o_orderdate").alias("dt"), F.col("o_totalprice").alias("price"))


@query("asof_backward", f"WITH {SQL_FACTS}, {SQL_PROBES} SELECT p.trade, f.dt AS fact_at, f.revenue FROM probes p ASOF LEFT JOIN facts f ON p.bank = f.bank AND p.dt >= f.dt", dates=["fact_at"])
def asof_backward(t: Tables) -> DataFrame:
    return A.backward(_probes(t), _facts(t), "bank", "dt").select("trade", "fact_at", "revenue")


@query(
    "asof_staleness",
    f"""WITH {SQL_FACTS}, {SQL_PROBES}, j AS (SELECT p.trade, p.dt, f.dt AS fact_at, f.revenue FROM probes p ASOF LEFT JOIN facts f ON p.bank = f.bank AND p.dt >= f.dt)
SELECT trade, CASE WHEN date_diff('day', fact_at, dt) <= 200 THEN fact_at END AS fact_at, CASE WHEN date_diff('day', fact_at, dt) <= 200 THEN revenue END AS revenue FROM j""", dates=["fact_at"]
)
def asof_staleness(t: Tables) -> DataFrame:
    return A.fresh(A.backward(_probes(t), _facts(t), "bank", "dt"), "dt", 200, ["revenue"]).select("trade", "fact_at", "revenue")


@query(
    "asof_yoy",
    f"""WITH {SQL_FACTS}, p AS (SELECT bank, qi, revenue AS now, CAST(dt - INTERVAL 12 MONTH AS DATE) AS dt FROM facts)
SELECT p.bank, p.qi, round(CASE WHEN f.revenue <> 0 THEN (p.now / f.revenue - 1) * 100 END, 6) AS yoy_pct FROM p ASOF LEFT JOIN facts f ON p.bank = f.bank AND p.dt >= f.dt""",
)
def asof_yoy(t: Tables) -> DataFrame:
    f = _facts(t)
    p = f.select("bank", F.add_months("dt", -12).alias("dt"), F.col("qi").alias("own"), F.col("revenue").alias("now"))
    j = A.backward(p, f.select("bank", "dt", "revenue"), "bank", "dt")
    return j.select("bank", F.col("own").alias("qi"), F.round(F.when(F.col("revenue") != 0, (F.col("now") / F.col("revenue") - 1) * 100), 6).alias("yoy_pct"))


@query(
    "asof_nearest_tolerance",
    f"""WITH {SQL_FACTS}, {SQL_PROBES}, u AS (SELECT p.trade, p.dt, p.bank, f.dt AS ua, f.revenue AS ur FROM probes p ASOF LEFT JOIN facts f ON p.bank = f.bank AND p.dt <= f.dt),
d AS (SELECT u.*, f.dt AS da, f.revenue AS dr FROM u ASOF LEFT JOIN facts f ON u.bank = f.bank AND u.dt >= f.dt)
SELECT trade, CASE WHEN date_diff('day', dt, ua) <= 110 THEN ua WHEN date_diff('day', da, dt) <= 400 THEN da END AS fact_at,
  CASE WHEN date_diff('day', dt, ua) <= 110 THEN ur WHEN date_diff('day', da, dt) <= 400 THEN dr END AS revenue FROM d""", dates=["fact_at"]
)
def asof_nearest_tolerance(t: Tables) -> DataFrame:
    return A.nearest(_probes(t), _facts(t).drop("qi"), "bank", "dt", 110, 400, "revenue").select("trade", "fact_at", "revenue")


@query(
    "reaction_forward_asof",
    """WITH c AS (SELECT event_type AS series, CAST(ts AS DATE) AS dt, round(avg(value), 4) AS price FROM events WHERE extract(dow FROM ts) NOT IN (0, 6) GROUP BY 1, 2),
l AS (SELECT *, lag(price) OVER (PARTITION BY series ORDER BY dt) AS before FROM c),
s AS (SELECT event_id, event_type AS series, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE) AS dt FROM events)
SELECT s.event_id, CASE WHEN date_diff('day', s.dt, l.dt) <= 4 THEN l.dt END AS session, round(CASE WHEN date_diff('day', s.dt, l.dt) <= 4 AND l.before <> 0 THEN (l.price / l.before - 1) * 100 END, 6) AS reaction_pct
FROM s ASOF LEFT JOIN l ON s.series = l.series AND s.dt <= l.dt""", dates=["session"]
)
def reaction_forward_asof(t: Tables) -> DataFrame:
    weekday = F.dayofweek("ts").isin(1, 7)
    c = t.events.where(~weekday).groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("dt")).agg((F.round(F.avg("value") * 10_000) / 10_000).alias("price"))  # ties as the scaled double has them
    closes = c.withColumn("before", F.lag("price").over(T.by("series", "dt")))
    s = t.events.select("event_id", F.col("event_type").alias("series"), F.date_add(F.to_date("ts"), 1).alias("dt"))
    j = A.fresh(A.forward(s, closes, "series", "dt"), "dt", 4, ["price", "before"])
    return j.select("event_id", F.col("fact_at").alias("session"), F.round(F.when(F.col("before") != 0, (F.col("price") / F.col("before") - 1) * 100), 6).alias("reaction_pct"))


@query(
    "interval_join_pr",
    """WITH rep AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS dt FROM events WHERE event_type = 'purchase'),
m AS (SELECT r.user_id, r.dt, e.event_id, e.ts, row_number() OVER (PARTITION BY r.user_id, r.dt ORDER BY e.ts DESC, e.event_id) AS k
  FROM rep r JOIN events e ON r.user_id = e.user_id AND e.event_type = 'click' AND date_diff('day', r.dt, CAST(e.ts AS DATE)) BETWEEN 0 AND 3)
SELECT user_id, dt, event_id FROM m WHERE k = 1""", dates=["dt"]
)
def interval_join_pr(t: Tables) -> DataFrame:
    reports = t.events.where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("dt")).distinct()
    releases = t.events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    return A.newest_within(reports, releases, "user_id", "dt", 3, "ts", ["event_id"]).select("user_id", "dt", "event_id")


@query(
    "price_multiple_history",
    f"""WITH {SQL_FACTS}, {SQL_PROBES}, s AS (SELECT bank, dt, CASE WHEN qi - lag(qi, 3) OVER w = 3 THEN sum(revenue) OVER (PARTITION BY bank ORDER BY qi ROWS 3 PRECEDING) END AS ttm
  FROM facts WINDOW w AS (PARTITION BY bank ORDER BY qi))
SELECT p.trade, round(CASE WHEN f.ttm > 0 THEN p.price / f.ttm END, 6) AS multiple FROM probes p ASOF LEFT JOIN s f ON p.bank = f.bank AND p.dt >= f.dt""",
)
def price_multiple_history(t: Tables) -> DataFrame:
    ttm = T.full_window_sum(_facts(t), "bank", "qi", "revenue").select("bank", "dt", "ttm")
    j = A.backward(_probes(t), ttm, "bank", "dt")
    return j.select("trade", F.round(F.when(F.col("ttm") > 0, F.col("price") / F.col("ttm")), 6).alias("multiple"))

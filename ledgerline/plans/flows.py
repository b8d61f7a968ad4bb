"""Quarterly flows and daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import timeseries as T

from .base import SQL_DAILY, SQL_FILINGS, Tables, query

W = "OVER (PARTITION BY bank ORDER BY qi)"
YTD = f"""{SQL_FILINGS}, y AS (SELECT bank, qi, round(sum(revenue) OVER (PARTITION BY bank, qi // 4 ORDER BY qi), 2) AS ytd FROM filings)"""


def r(name: str, digits: int = 4, alias: str | None = None):
    return F.round(name, digits).alias(alias or name)


@query(
    "ytd_decumulate",
    f"""WITH {YTD} SELECT bank, qi, ytd, round(CASE WHEN qi % 4 = 0 THEN ytd WHEN lag(qi) {W} = qi - 1 THEN ytd - lag(ytd) {W} END, 2) AS flow FROM y""",
)
def ytd_decumulate(t: Tables) -> DataFrame:
    y = T.year_to_date(t.filings(), "bank", "qi", "revenue").select("bank", "qi", r("ytd", 2))
    return T.decumulated(y, "bank", "qi", "ytd").select("bank", "qi", "ytd", r("flow", 2))


@query("qoq_gap_masked", f"WITH {SQL_FILINGS} SELECT bank, qi, round(CASE WHEN qi - lag(qi) {W} = 1 THEN revenue - lag(revenue) {W} END, 2) AS change FROM filings")
def qoq_gap_masked(t: Tables) -> DataFrame:
    return T.change(t.filings(), "bank", "qi", "revenue").select("bank", "qi", r("change", 2))


TTM = f"""{SQL_FILINGS}, s AS (SELECT bank, qi, revenue, CASE WHEN qi - lag(qi, 3) {W} = 3 THEN sum(revenue) OVER (PARTITION BY bank ORDER BY qi ROWS 3 PRECEDING) END AS ttm FROM filings)"""


@query("ttm_full_window", f"WITH {TTM} SELECT bank, qi, round(ttm, 2) AS ttm FROM s")
def ttm_full_window(t: Tables) -> DataFrame:
    return T.full_window_sum(t.filings(), "bank", "qi", "revenue").select("bank", "qi", r("ttm", 2))


@query(
    "ttm_partial_scaled",
    f"""WITH {SQL_FILINGS}, s AS (SELECT bank, qi, count(revenue) OVER w AS n, sum(revenue) OVER w AS total FROM filings
  WINDOW w AS (PARTITION BY bank ORDER BY qi RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT bank, qi, round(CASE WHEN n >= 2 THEN total * 4 / n END, 2) AS ttm_scaled FROM s""",
)
def ttm_partial_scaled(t: Tables) -> DataFrame:
    return T.scaled_window_sum(t.filings(), "bank", "qi", "revenue").select("bank", "qi", r("ttm_scaled", 2))


@query(
    "yoy_ttm",
    f"""WITH {SQL_FILINGS}, s AS (SELECT bank, qi, count(revenue) OVER a AS k1, sum(revenue) OVER a AS s1, count(revenue) OVER b AS k2, sum(revenue) OVER b AS s2 FROM filings
  WINDOW a AS (PARTITION BY bank ORDER BY qi ROWS 3 PRECEDING), b AS (PARTITION BY bank ORDER BY qi ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING))
SELECT bank, qi, round(CASE WHEN k1 = 4 AND k2 = 4 AND s1 <> 0 AND s2 <> 0 THEN (s1 / s2 - 1) * 100 END, 4) AS growth_pct FROM s""",
)
def yoy_ttm(t: Tables) -> DataFrame:
    return T.year_on_year(t.filings(), "bank", "qi", "revenue").select("bank", "qi", r("growth_pct", 4))


@query(
    "cagr_four_quarters",
    f"""WITH {SQL_FILINGS}, y AS (SELECT bank, qi, revenue, CASE WHEN qi - lag(qi, 4) {W} = 4 THEN lag(revenue, 4) {W} END AS before FROM filings)
SELECT bank, qi, round(CASE WHEN before > 0 AND revenue > 0 THEN (pow(revenue / before, 1.0) - 1) * 100 END, 4) AS cagr FROM y""",
)
def cagr_four_quarters(t: Tables) -> DataFrame:
    w = T.by("bank", "qi")
    before = F.when(F.col("qi") - F.lag("qi", 4).over(w) == 4, F.lag("revenue", 4).over(w))
    y = t.filings().withColumn("before", before)
    return y.select("bank", "qi", F.round(F.when((F.col("before") > 0) & (F.col("revenue") > 0), (F.pow(F.col("revenue") / F.col("before"), F.lit(4 / 4)) - 1) * 100), 4).alias("cagr"))


@query(
    "ffill_origin",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN value >= 40 THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER w AS filled, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER w AS origin
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def ffill_origin(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.when(F.col("value") >= 40, F.col("value")).alias("v"))
    return T.filled(e, "user_id", "event_id", "v").select("event_id", "filled", "origin")


@query(
    "winsorised_ttm",
    f"""WITH {SQL_FILINGS}, w AS (SELECT bank, qi, list(revenue) OVER (PARTITION BY bank ORDER BY qi ROWS 7 PRECEDING) AS e,
  list(revenue) OVER (PARTITION BY bank ORDER BY qi ROWS 3 PRECEDING) AS f FROM filings),
c AS (SELECT bank, qi, f, 3 * list_aggregate(e, 'median') AS cap FROM w)
SELECT bank, qi, round(CASE WHEN len(f) = 4 AND list_sum(f) > 0 THEN greatest(0.2, least(1.0, list_sum(list_transform(f, lambda x: least(x, cap))) / list_sum(f))) END, 6) AS factor FROM c""",
)
def winsorised_ttm(t: Tables) -> DataFrame:
    return T.winsorised_factor(t.filings(), "bank", "qi", "revenue").select("bank", "qi", r("factor", 6))


@query(
    "rolling_ols_beta",
    f"""WITH {SQL_DAILY}, m AS (SELECT series, d, v - lag(v) OVER w AS y, CAST(n - lag(n) OVER w AS DOUBLE) AS x FROM daily WINDOW w AS (PARTITION BY series ORDER BY d)),
s AS (SELECT series, d, count(CASE WHEN y IS NOT NULL AND x IS NOT NULL THEN 1 END) OVER w AS k, var_pop(CASE WHEN y IS NOT NULL THEN x END) OVER w AS vx,
  regr_slope(y, x) OVER w AS slope, regr_r2(y, x) OVER w AS r2 FROM m WINDOW w AS (PARTITION BY series ORDER BY d ROWS 3 PRECEDING))
SELECT series, d, round(CASE WHEN k >= 3 AND vx > 1e-12 THEN slope END, 6) AS slope, round(CASE WHEN k >= 3 AND vx > 1e-12 THEN r2 END, 6) AS r2 FROM s""", dates=["d"]
)
def rolling_ols_beta(t: Tables) -> DataFrame:
    w = T.by("series", "d")
    m = t.daily().select("series", "d", (F.col("v") - F.lag("v").over(w)).alias("y"), (F.col("n") - F.lag("n").over(w)).cast("double").alias("x"))
    return T.rolling_slope(m, "series", "d", "y", "x").select("series", "d", r("slope", 6), r("r2", 6))


@query(
    "cycle_beta",
    f"""WITH {SQL_DAILY}, m AS (SELECT *, n - lag(n) OVER w AS dn, row_number() OVER w AS k FROM daily WINDOW w AS (PARTITION BY series ORDER BY d)),
s AS (SELECT *, CASE WHEN dn > 0.03 THEN 1 WHEN dn < -0.03 THEN -1 END AS s FROM m),
l AS (SELECT series, max(k) AS z, max_by(s, k) FILTER (WHERE s IS NOT NULL) AS way FROM s GROUP BY 1),
a AS (SELECT l.series, l.z, l.way, coalesce(max(k) FILTER (WHERE s = -l.way), 1) AS a FROM l JOIN s ON l.series = s.series WHERE way IS NOT NULL GROUP BY ALL)
SELECT a.series, x.d AS cycle_start, y.d AS cycle_end, a.z - a.a + 1 AS rows, CAST(y.n - x.n AS DOUBLE) AS rate_change, round(y.v - x.v, 6) AS value_change,
  CASE WHEN way = 1 THEN 'up' ELSE 'down' END AS direction, round((y.v - x.v) / (y.n - x.n), 6) AS beta
FROM a JOIN s x ON x.series = a.series AND x.k = a.a JOIN s y ON y.series = a.series AND y.k = a.z WHERE a.z > a.a AND abs(y.n - x.n) >= 0.15""", dates=["cycle_start", "cycle_end"]
)
def cycle_beta(t: Tables) -> DataFrame:
    c = T.cycle_beta(t.daily(), "series", "d", "v", "n")
    return c.withColumns({"rate_change": F.col("rate_change").cast("double"), "value_change": F.round("value_change", 6), "beta": F.round("beta", 6)})


@query(
    "zscore_trailing",
    f"""WITH {SQL_DAILY}, s AS (SELECT series, d, v, count(v) OVER a AS k, avg(v) OVER a AS m1, stddev_samp(v) OVER a AS s1, count(v) OVER b AS k2, avg(v) OVER b AS m2, stddev_samp(v) OVER b AS s2 FROM daily
  WINDOW a AS (PARTITION BY series ORDER BY d RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY d ROWS UNBOUNDED PRECEDING)),
z AS (SELECT series, d, v, CASE WHEN k >= 12 THEN m1 WHEN k2 >= 12 THEN m2 END AS m, CASE WHEN k >= 12 THEN s1 WHEN k2 >= 12 THEN s2 END AS s FROM s)
SELECT series, d, round(CASE WHEN s > 0 THEN (v - m) / s END, 6) AS z FROM z""", dates=["d"]
)
def zscore_trailing(t: Tables) -> DataFrame:
    return T.zscore(t.daily(), "series", "d", "v", 10).select("series", "d", r("z", 6))


@query(
    "runs_islands",
    f"""WITH {SQL_DAILY}, f AS (SELECT series, d, coalesce(v > lag(v) OVER (PARTITION BY series ORDER BY d), false) AS up FROM daily),
s AS (SELECT *, CASE WHEN up <> coalesce(lag(up) OVER (PARTITION BY series ORDER BY d), NOT up) THEN 1 ELSE 0 END AS st FROM f),
g AS (SELECT *, sum(st) OVER (PARTITION BY series ORDER BY d) AS run FROM s)
SELECT series, min(d) AS run_start, max(d) AS run_end, count(*) AS length FROM g WHERE up GROUP BY series, run""", dates=["run_start", "run_end"]
)
def runs_islands(t: Tables) -> DataFrame:
    up = F.coalesce(F.col("v") > F.lag("v").over(T.by("series", "d")), F.lit(False))
    return T.runs(t.daily().withColumn("up", up), "series", "d", "up")


@query(
    "anchors_window",
    f"""WITH {SQL_DAILY} SELECT series, d, v, lag(v, 1) OVER w AS back_1, lag(v, 5) OVER w AS back_5, lag(v, 21) OVER w AS back_21,
  min(v) OVER (PARTITION BY series ORDER BY d ROWS 9 PRECEDING) AS low, max(v) OVER (PARTITION BY series ORDER BY d ROWS 9 PRECEDING) AS high
FROM daily WINDOW w AS (PARTITION BY series ORDER BY d)""", dates=["d"]
)
def anchors_window(t: Tables) -> DataFrame:
    return T.anchors(t.daily(), "series", "d", "v", 10).drop("n")


def _mean(n: int) -> str:
    w = f"OVER (PARTITION BY series ORDER BY d ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(volume) {w} >= {n} / 2.0 THEN avg(volume) {w} END"


@query(
    "relative_volume",
    f"""WITH v AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, count(*) AS volume FROM orders GROUP BY 1, 2),
m AS (SELECT series, d, {_mean(5)} AS m5, {_mean(21)} AS m21, {_mean(126)} AS m126, {_mean(63)} AS base FROM v)
SELECT series, d, round(CASE WHEN base > 0 THEN m5 / base END, 6) AS rv_5, round(CASE WHEN base > 0 THEN m21 / base END, 6) AS rv_21,
  round(CASE WHEN base > 0 THEN m126 / base END, 6) AS rv_126 FROM m""", dates=["d"]
)
def relative_volume(t: Tables) -> DataFrame:
    v = t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("volume"))
    return T.relative_volume(v, "series", "d", "volume", [5, 21, 126], 63).select("series", "d", r("rv_5", 6), r("rv_21", 6), r("rv_126", 6))


@query(
    "indexed_pct",
    f"WITH {SQL_DAILY} SELECT series, d, round((v / first_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY d) - 1) * 100, 6) AS pct FROM daily", dates=["d"]
)
def indexed_pct(t: Tables) -> DataFrame:
    first = F.first("v", True).over(T.by("series", "d").rowsBetween(-(1 << 30), 0))
    return t.daily().select("series", "d", F.round((F.col("v") / first - 1) * 100, 6).alias("pct"))


@query(
    "period_stats",
    f"""WITH {SQL_DAILY}, s AS (SELECT series, min_by(v, d) AS first, max_by(v, d) AS last, min(v) AS low, max(v) AS high FROM daily GROUP BY 1)
SELECT *, round(CASE WHEN first <> 0 THEN (last / first - 1) * 100 END, 6) AS return_pct FROM s""",
)
def period_stats(t: Tables) -> DataFrame:
    return T.stats(t.daily(), ["series"], "d", "v").withColumn("return_pct", F.round("return_pct", 6))


@query(
    "latest_session",
    "SELECT event_id, user_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)",
)
def latest_session(t: Tables) -> DataFrame:
    last = t.events.agg(F.to_date(F.max("ts")).alias("last"))
    return t.events.join(F.broadcast(last), F.to_date("ts") == F.col("last")).select("event_id", "user_id", "event_type")


@query(
    "macro_bases",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1),
x AS (SELECT month, v, lag(v) OVER (ORDER BY month) AS p1, y.v AS p12 FROM m LEFT JOIN (SELECT month AS ym, v FROM m) y ON y.ym = month - INTERVAL 12 MONTH)
SELECT CAST(month AS DATE) AS month, round((v / p1 - 1) * 100, 6) AS mom_pct, round(v - p1, 2) AS mom_change, round((v / p12 - 1) * 100, 6) AS yoy_pct FROM x""".replace("SELECT month, v, lag(v) OVER (ORDER BY month) AS p1, y.v AS p12 FROM m", "SELECT m.month, m.v, lag(m.v) OVER (ORDER BY m.month) AS p1, y.v AS p12 FROM m"), dates=["month"]
)
def macro_bases(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    # one series: its months are few whatever the rows behind them
    w = T.by([F.lit(1)], "month")
    y = m.select(F.add_months("month", 12).alias("month"), F.col("v").alias("p12"))
    x = m.withColumn("p1", F.lag("v").over(w)).join(y, "month", "left")
    pct = lambda a, b: F.round((F.col(a) / F.col(b) - 1) * 100, 6)
    return x.select("month", pct("v", "p1").alias("mom_pct"), F.round(F.col("v") - F.col("p1"), 2).alias("mom_change"), pct("v", "p12").alias("yoy_pct"))


@query(
    "credit_alerts",
    f"""WITH {SQL_FILINGS}, a AS (SELECT bank, qi, revenue, lag(revenue, 1) {W} AS p1, lag(revenue, 2) {W} AS p2, lag(revenue, 3) {W} AS p3, lag(qi, 3) {W} AS q3,
  avg(revenue) OVER (PARTITION BY bank ORDER BY qi ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS recent,
  avg(revenue) OVER (PARTITION BY bank ORDER BY qi ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS prior FROM filings)
SELECT bank, qi, coalesce(revenue > p1 AND p1 > p2 AND p2 > p3 AND qi - q3 = 3, false) AS three_rises, coalesce(recent > 1.5 * prior, false) AS surge FROM a""",
)
def credit_alerts(t: Tables) -> DataFrame:
    w = T.by("bank", "qi")
    back = [F.col("revenue"), *(F.lag("revenue", k).over(w) for k in (1, 2, 3))]
    rises = (back[0] > back[1]) & (back[1] > back[2]) & (back[2] > back[3]) & T.consecutive(w, "qi", 4)
    recent, prior = F.avg("revenue").over(w.rowsBetween(-1, 0)), F.avg("revenue").over(w.rowsBetween(-5, -2))
    no = F.lit(False)
    return t.filings().select("bank", "qi", F.coalesce(rises, no).alias("three_rises"), F.coalesce(recent > 1.5 * prior, no).alias("surge"))


@query(
    "annual_flows",
    f"""WITH {SQL_FILINGS} SELECT bank, qi // 4 AS year, round(sum(revenue), 2) AS flow, max_by(revenue, qi) AS last_level, count(*) AS quarters,
  CASE WHEN count(*) = 4 THEN round(sum(revenue) - sum(CASE WHEN qi % 4 < 3 THEN revenue END), 2) END AS q4_by_difference FROM filings GROUP BY 1, 2""",
)
def annual_flows(t: Tables) -> DataFrame:
    total, three = F.sum("revenue"), F.sum(F.when(F.col("qi") % 4 < 3, F.col("revenue")))
    return t.filings().groupBy("bank", F.floor(F.col("qi") / 4).alias("year")).agg(
        F.round(total, 2).alias("flow"), F.max_by("revenue", "qi").alias("last_level"), F.count("*").alias("quarters"), F.when(F.count("*") == 4, F.round(total - three, 2)).alias("q4_by_difference")
    )


@query(
    "quarter_grid_arrays",
    f"""WITH {SQL_FILINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS k FROM filings)
SELECT bank, array_to_string(list(printf('%.2f', revenue) ORDER BY k), ',') AS history FROM r WHERE k <= 4 GROUP BY 1""",
)
def quarter_grid_arrays(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("bank").orderBy(F.desc("qi")))
    h = t.filings().withColumn("k", k).where("k <= 4").groupBy("bank").agg(F.sort_array(F.collect_list(F.struct("k", F.format_string("%.2f", "revenue").alias("v")))).alias("h"))
    return h.select("bank", F.array_join(F.col("h.v"), ",").alias("history"))

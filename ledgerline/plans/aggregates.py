"""Rollups, consensus, ownership, blends, ladders, reshaping and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import exact_mean, rounded
from ledgerline.operators import estimates as E
from ledgerline.operators import ownership as O
from ledgerline.operators import quality as V

from .base import SQL_FILINGS, SQL_HOLDINGS, Tables, query


def r(name: str, digits: int = 4, alias: str | None = None):
    return F.round(name, digits).alias(alias or name)


@query(
    "sector_medians_rollup",
    """WITH m AS (SELECT c_mktsegment AS tier, n_regionkey AS region, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT tier, region, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN median(c_acctbal) END, 4) AS median FROM m GROUP BY GROUPING SETS ((tier), (region), ())""",
)
def sector_medians_rollup(t: Tables) -> DataFrame:
    m = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("tier"), F.col("n_regionkey").alias("region"), "c_acctbal")
    sets = [[F.col("tier")], [F.col("region")], []]
    out = m.groupingSets(sets, "tier", "region").agg(F.count("*").alias("n"), F.when(F.count("*") >= 5, F.median("c_acctbal")).alias("median"))
    return out.withColumn("median", F.round("median", 4))


@query(
    "consolidate_groups",
    f"""WITH {SQL_FILINGS}, j AS (SELECT c_nationkey AS holder, qi, bank, revenue, filings, c_acctbal FROM filings JOIN customer ON bank = c_custkey)
SELECT holder, qi, round(sum(revenue), 2) AS revenue, sum(filings)::BIGINT AS filings, round(sum(revenue) / sum(filings), 4) AS ratio,
  NULL::DOUBLE AS average_based, max_by(bank, c_acctbal) AS lead, count(*) AS members FROM j GROUP BY 1, 2""",
)
def consolidate_groups(t: Tables) -> DataFrame:
    j = t.filings().join(t.customer, F.col("bank") == F.col("c_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("holder"), "qi").agg(
        F.round(F.sum("revenue"), 2).alias("revenue"), F.sum("filings").alias("filings"), F.round(F.sum("revenue") / F.sum("filings"), 4).alias("ratio"),
        F.max(F.lit(None).cast("double")).alias("average_based"), F.max_by("bank", "c_acctbal").alias("lead"), F.count("*").alias("members"),
    )


SQL_ESTIMATES = """est AS (SELECT p_brand AS ticker, CAST(year(l_shipdate) AS BIGINT) AS period, l_suppkey % 10 AS firm, CASE WHEN l_linenumber % 2 = 0 THEN 'ni' ELSE 'eps' END AS metric,
  l_extendedprice AS value, CASE WHEN l_returnflag = 'A' THEN '$B' WHEN l_returnflag = 'N' THEN '$K' ELSE '$M' END AS unit FROM lineitem JOIN part ON l_partkey = p_partkey),
can AS (SELECT *, value * CASE unit WHEN '$B' THEN 1000.0::DOUBLE WHEN '$K' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS v FROM est),
firm AS (SELECT ticker, period, metric, firm, avg(v) AS v FROM can GROUP BY ALL),
con AS (SELECT ticker, period, metric, avg(v) AS mean, min(v) AS low, max(v) AS high, count(*) AS n FROM firm GROUP BY ALL)"""


def _estimates(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.when(F.col("l_returnflag") == "A", "$B").when(F.col("l_returnflag") == "N", "$K").otherwise("$M")
    return j.select(
        F.col("p_brand").alias("ticker"), F.year("l_shipdate").cast("long").alias("period"), (F.col("l_suppkey") % 10).alias("firm"),
        F.when(F.col("l_linenumber") % 2 == 0, "ni").otherwise("eps").alias("metric"), F.col("l_extendedprice").alias("value"), unit.alias("unit"),
    )


@query("consensus_compile", f"WITH {SQL_ESTIMATES} SELECT ticker, period, metric, round(mean, 2) AS mean, round(low, 2) AS low, round(high, 2) AS high, n FROM con")
def consensus_compile(t: Tables) -> DataFrame:
    return E.consensus(_estimates(t)).select("ticker", "period", "metric", r("mean", 2), r("low", 2), r("high", 2), "n")


@query(
    "consensus_matrix",
    f"""WITH {SQL_ESTIMATES} SELECT ticker, period, metric, {", ".join(f"round(CAST(sum(CASE WHEN firm = {k} THEN CAST(v AS DECIMAL(28, 6)) END) AS DOUBLE) / count(CASE WHEN firm = {k} THEN v END) * 100) / 100 AS firm_{k}" for k in range(10))} FROM can GROUP BY ALL""",
)
def consensus_matrix(t: Tables) -> DataFrame:
    v = _estimates(t).withColumn("v", E.canonical(F.col("value"), F.col("unit")))
    m = v.groupBy("ticker", "period", "metric").pivot("firm", list(range(10))).agg(exact_mean(F.col("v"), 6))
    return m.select("ticker", "period", "metric", *(rounded(F.col(str(k)), 2).alias(f"firm_{k}") for k in range(10)))


SQL_BEAT = f"""WITH {SQL_ESTIMATES}, j AS (SELECT a.ticker, a.period, a.metric, a.mean AS actual, b.mean AS estimate,
  CASE WHEN b.mean <> 0 THEN (a.mean - b.mean) / abs(b.mean) * 100 END AS s FROM con a JOIN con b ON a.ticker = b.ticker AND a.metric = b.metric AND a.period = b.period + 1),
o AS (SELECT ticker, period, metric, round(s, 4) AS surprise_pct, CASE WHEN metric = 'ni' THEN -s ELSE s END AS d FROM j),
x AS (SELECT ticker, period, metric, surprise_pct, CASE WHEN abs(d) <= 1 THEN 'inline' WHEN d > 0 THEN 'beat' WHEN d < 0 THEN 'miss' END AS outcome FROM o)"""


def _beats(t: Tables) -> DataFrame:
    c = E.consensus(_estimates(t))
    b = c.select("ticker", "metric", (F.col("period") + 1).alias("period"), F.col("mean").alias("estimate"))
    j = c.join(b, ["ticker", "metric", "period"])
    return j.select("ticker", "period", "metric", F.round(E.surprise(F.col("mean"), F.col("estimate")), 4).alias("surprise_pct"), E.outcome(F.col("mean"), F.col("estimate"), F.col("metric") == "ni").alias("outcome"))


query("beat_miss", f"{SQL_BEAT} SELECT * FROM x")(_beats)


@query(
    "beat_miss_summary",
    f"{SQL_BEAT} SELECT metric, count(*) FILTER (WHERE outcome = 'beat') AS beats, count(*) FILTER (WHERE outcome = 'miss') AS misses, round(avg(surprise_pct), 3) AS mean_surprise FROM x GROUP BY 1",
)
def beat_miss_summary(t: Tables) -> DataFrame:
    return _beats(t).groupBy("metric").agg(F.count_if(F.col("outcome") == "beat").alias("beats"), F.count_if(F.col("outcome") == "miss").alias("misses"), F.round(F.avg("surprise_pct"), 3).alias("mean_surprise"))


@query("estimate_coverage", f"WITH {SQL_ESTIMATES} SELECT ticker, period, count(DISTINCT firm) AS firms, count(*) AS estimates FROM est GROUP BY ALL")
def estimate_coverage(t: Tables) -> DataFrame:
    return _estimates(t).groupBy("ticker", "period").agg(F.count_distinct("firm").alias("firms"), F.count("*").alias("estimates"))


@query(
    "holder_turnover",
    f"""WITH {SQL_HOLDINGS}, s AS (SELECT *, abs(shares - lag(shares) OVER (PARTITION BY issuer, holder ORDER BY qi)) AS move FROM holdings),
h AS (SELECT issuer, holder, count(*) AS quarters, CASE WHEN count(*) >= 2 AND avg(shares) > 0 THEN (sum(move) / count(move)) / (sum(shares) / count(shares)) * 100 END AS t FROM s GROUP BY 1, 2),
l AS (SELECT issuer, list_sort(list(t)) AS d, len(list(t)) AS n FROM h WHERE t IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
j AS (SELECT issuer, d, i, greatest(1, least(n - 1, i * (n + 1) // 4)) AS j, n FROM l, (SELECT unnest([1, 2, 3]) AS i)),
q AS (SELECT issuer, i, (d[j] * (4 - (i * (n + 1) - j * 4)) + d[j + 1] * (i * (n + 1) - j * 4)) / 4 AS q FROM j),
p AS (SELECT issuer, max(CASE WHEN i = 1 THEN q END) AS q1, max(CASE WHEN i = 2 THEN q END) AS q2, max(CASE WHEN i = 3 THEN q END) AS q3 FROM q GROUP BY 1)
SELECT h.issuer, holder, quarters, round(t, 6) AS turnover, CASE WHEN t <= q1 THEN 'Very Low' WHEN t <= q2 THEN 'Low' WHEN t <= q3 THEN 'Moderate' WHEN t > q3 THEN 'High' END AS category
FROM h LEFT JOIN p ON h.issuer = p.issuer""",
)
def holder_turnover(t: Tables) -> DataFrame:
    return O.turnover(t.holdings()).withColumn("turnover", F.round("turnover", 6))


@query(
    "holder_concentration",
    f"""WITH {SQL_HOLDINGS}, n AS (SELECT * FROM holdings h WHERE qi = (SELECT max(qi) FROM holdings x WHERE x.issuer = h.issuer) AND shares > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY shares DESC, holder) AS k FROM n)
SELECT issuer, count(*) AS n, round(sum(shares), 2) AS total, round(sum(CASE WHEN k <= 5 THEN shares END) / sum(shares) * 100, 6) AS top5,
  round(sum(CASE WHEN k <= 10 THEN shares END) / sum(shares) * 100, 6) AS top10, round(sum(shares * shares) / (sum(shares) * sum(shares)) * 10000, 4) AS hhi FROM k GROUP BY 1""",
)
def holder_concentration(t: Tables) -> DataFrame:
    return O.concentration(t.holdings()).select("issuer", "n", r("total", 2), r("top5", 6), r("top10", 6), r("hhi", 4))


@query(
    "holder_moves",
    f"""WITH {SQL_HOLDINGS}, a AS (SELECT *, dense_rank() OVER (PARTITION BY issuer ORDER BY qi DESC) AS age FROM holdings),
m AS (SELECT issuer, holder, sum(CASE WHEN age = 1 THEN shares END) AS now, sum(CASE WHEN age = 2 THEN shares END) AS before FROM a WHERE age <= 2 GROUP BY 1, 2)
SELECT *, CASE WHEN before IS NULL OR before = 0 THEN 'New' WHEN now IS NULL OR now = 0 THEN 'Exited' WHEN abs((now - before) / before) < 0.005 THEN 'Unchanged' WHEN now > before THEN 'Added' ELSE 'Trimmed' END AS move FROM m""",
)
def holder_moves(t: Tables) -> DataFrame:
    return O.moves(t.holdings())


@query(
    "holder_matrix",
    f"""WITH {SQL_HOLDINGS}, a AS (SELECT *, dense_rank() OVER (ORDER BY qi DESC) AS age FROM holdings)
SELECT issuer, holder, {", ".join(f"sum(CASE WHEN age = {k} THEN shares END) AS q{k}" for k in range(1, 5))} FROM a WHERE age <= 4 GROUP BY 1, 2""",
)
def holder_matrix(t: Tables) -> DataFrame:
    h = t.holdings()
    ages = h.select("qi").distinct().orderBy(F.desc("qi")).limit(4)
    ages = ages.withColumn("age", F.row_number().over(Window.orderBy(F.desc("qi"))))
    m = h.join(F.broadcast(ages), "qi").groupBy("issuer", "holder").pivot("age", [1, 2, 3, 4]).agg(F.sum("shares"))
    return m.select("issuer", "holder", *(F.col(str(k)).alias(f"q{k}") for k in range(1, 5)))


@query(
    "crossholdings",
    f"""WITH {SQL_HOLDINGS}, s AS (SELECT issuer AS other, holder, sum(value_usd) AS v FROM holdings WHERE issuer <> 'Brand#1' AND holder IN (SELECT holder FROM holdings WHERE issuer = 'Brand#1') GROUP BY 1, 2)
SELECT other, count(*) AS shared, arg_max(holder, {{'v': v, 'h': holder}}) AS largest FROM s GROUP BY 1 HAVING count(*) >= 2""",
)
def crossholdings(t: Tables) -> DataFrame:
    return O.common_holders(t.holdings(), "Brand#1")


@query(
    "harmonic_blend",
    """WITH h AS (SELECT l_suppkey AS fund, l_quantity AS w, l_extendedprice / l_quantity / 100 AS pe FROM lineitem WHERE l_quantity > 0)
SELECT fund, round(sum(CASE WHEN pe > 0 AND pe <= 12 THEN w END) / sum(CASE WHEN pe > 0 AND pe <= 12 THEN w / pe END), 6) AS blend, count(CASE WHEN pe > 0 AND pe <= 12 THEN 1 END) AS n FROM h GROUP BY 1""",
)
def harmonic_blend(t: Tables) -> DataFrame:
    h = t.lineitem.where("l_quantity > 0").select(F.col("l_suppkey").alias("fund"), F.col("l_quantity").alias("w"), (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("pe"))
    return O.harmonic(h, "fund", "w", "pe", 0.0, 12.0).withColumn("blend", F.round("blend", 6))


@query("latest_per_key", "SELECT user_id, max_by(event_id, ts) AS event_id, max_by(value, ts) AS value FROM events GROUP BY 1")
def latest_per_key(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "e.event_id", "e.value")


LADDER = {"purchase": 100.0, "click": 80.0, "view": 0.0}


@query(
    "first_available",
    """WITH l AS (SELECT user_id, max_by(CASE WHEN event_type = 'purchase' AND value > 100 THEN value END, event_id) FILTER (WHERE event_type = 'purchase' AND value > 100) AS a,
  max_by(value, event_id) FILTER (WHERE event_type = 'click' AND value > 80) AS b, max_by(value, event_id) FILTER (WHERE event_type = 'view' AND value > 0) AS c FROM events GROUP BY 1)
SELECT user_id, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'purchase' WHEN b IS NOT NULL THEN 'click' WHEN c IS NOT NULL THEN 'view' END AS source FROM l""",
)
def first_available(t: Tables) -> DataFrame:
    last = [F.max_by("value", F.when((F.col("event_type") == k) & (F.col("value") > v), F.col("event_id"))).alias(k) for k, v in LADDER.items()]
    l = t.events.where(F.expr(" or ".join(f"(event_type = '{k}' and value > {v})" for k, v in LADDER.items()))).groupBy("user_id").agg(*last)
    users = t.events.select("user_id").distinct().join(l, "user_id", "left")
    source = F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in LADDER))
    return users.select("user_id", F.coalesce(*LADDER).alias("value"), source.alias("source"))


@query(
    "freshest_wins",
    """WITH c AS (SELECT user_id, event_type, CASE WHEN event_type <> 'signup' THEN ts END AS as_of, value, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS p, event_id FROM events)
SELECT user_id, event_type AS source, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY as_of IS NULL, as_of DESC, p, event_id) AS k FROM c) WHERE k = 1""",
)
def freshest_wins(t: Tables) -> DataFrame:
    p = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "error", 4).otherwise(5)
    as_of = F.when(F.col("event_type") != "signup", F.col("ts"))
    key = F.struct(as_of.isNotNull(), as_of, -p, -F.col("event_id"))
    best = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), key).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("source"), "b.value")


@query(
    "pivot_quarter_grid",
    f"""WITH {SQL_FILINGS} SELECT bank, qi // 4 AS year, {", ".join(f"max(CASE WHEN qi % 4 = {k} THEN revenue END) AS q{k + 1}" for k in range(4))} FROM filings GROUP BY 1, 2""",
)
def pivot_quarter_grid(t: Tables) -> DataFrame:
    quarter = F.concat(F.lit("q"), (F.col("qi") % 4 + 1).cast("string"))
    return t.filings().withColumn("quarter", quarter).groupBy("bank", F.floor(F.col("qi") / 4).alias("year")).pivot("quarter", ["q1", "q2", "q3", "q4"]).agg(F.max("revenue"))


SQL_SEGMENTS = """seg AS (SELECT o_custkey AS bank, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS filled,
  round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS partial, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)"""


def _segments(t: Tables) -> DataFrame:
    part = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).otherwise(0.0)), 2)
    return t.orders.groupBy(F.col("o_custkey").alias("bank")).agg(part("O").alias("open"), part("F").alias("filled"), part("P").alias("partial"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("unpivot_segments", f"WITH {SQL_SEGMENTS} SELECT bank, metric, value FROM seg UNPIVOT (value FOR metric IN (open, filled, partial))")
def unpivot_segments(t: Tables) -> DataFrame:
    return V.unpivoted(_segments(t), "bank", ["open", "filled", "partial"])


@query(
    "segment_hotspots",
    f"""WITH {SQL_SEGMENTS}, u AS (SELECT bank, metric, value, total FROM seg UNPIVOT (value FOR metric IN (open, filled, partial)))
SELECT bank, metric, round(value / total, 6) AS share FROM u WHERE total > 0 AND value / total >= 2.0 / 3""",
)
def segment_hotspots(t: Tables) -> DataFrame:
    u = _segments(t).unpivot(["bank", "total"], ["open", "filled", "partial"], "metric", "value").where("total > 0")
    return u.where(F.col("value") / F.col("total") >= 2.0 / 3).select("bank", "metric", F.round(F.col("value") / F.col("total"), 6).alias("share"))


RULES = [("acctbal", -500.0, 9000.0, True), ("orders", 1.0, 15.0, False), ("revenue", 100000.0, 4000000.0, True)]
SQL_FINDINGS = """WITH o AS (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1),
m AS (SELECT c_custkey AS bank, c_acctbal AS acctbal, CAST(orders AS DOUBLE) AS orders, revenue FROM customer LEFT JOIN o ON c_custkey = o_custkey),
u AS (SELECT bank, metric, value FROM m UNPIVOT (value FOR metric IN (acctbal, orders, revenue))),
r(metric, low, high, skip_zero) AS (VALUES ('acctbal', -500.0, 9000.0, true), ('orders', 1.0, 15.0, false), ('revenue', 100000.0, 4000000.0, true)),
f AS (SELECT bank, u.metric, value, CASE WHEN value < low THEN 'below' WHEN value > high THEN 'above' END AS finding FROM u JOIN r ON u.metric = r.metric WHERE NOT (skip_zero AND value = 0))"""


def _findings(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("bank")).agg(F.count("*").cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    m = t.customer.select(F.col("c_custkey").alias("bank"), F.col("c_acctbal").alias("acctbal")).join(o, "bank", "left")
    rules = t.spark.createDataFrame(RULES, "metric string, low double, high double, skip_zero boolean")
    return V.range_findings(V.unpivoted(m, "bank", ["acctbal", "orders", "revenue"]), "bank", rules)


query("validation_findings", f"{SQL_FINDINGS} SELECT * FROM f WHERE finding IS NOT NULL")(_findings)
query("validation_summary", f"{SQL_FINDINGS} SELECT metric, finding, count(*) AS n FROM f WHERE finding IS NOT NULL GROUP BY 1, 2")(
    lambda t: _findings(t).groupBy("metric", "finding").agg(F.count("*").alias("n"))
)


@query(
    "cross_source_check",
    f"""WITH {SQL_FILINGS}, a AS (SELECT bank, round(sum(revenue), 2) AS own FROM filings GROUP BY 1),
b AS (SELECT o_custkey AS bank, round(sum(l_extendedprice), 2) AS other FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT a.bank, own, other, CASE WHEN other <> 0 THEN abs(own / other - 1) <= 0.25 END AS agrees FROM a LEFT JOIN b ON a.bank = b.bank""",
)
def cross_source_check(t: Tables) -> DataFrame:
    a = t.filings().groupBy("bank").agg(F.round(F.sum("revenue"), 2).alias("own"))
    b = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("bank")).agg(F.round(F.sum("l_extendedprice"), 2).alias("other"))
    return a.join(b, "bank", "left").withColumn("agrees", V.agree(F.col("own"), F.col("other"), 0.25))


@query(
    "agreement_gate",
    "SELECT p_brand, p_type, CASE WHEN max(p_retailprice) - min(p_retailprice) <= 120 THEN min(p_retailprice) END AS p_retailprice, count(p_retailprice) AS n FROM part GROUP BY 1, 2",
)
def agreement_gate(t: Tables) -> DataFrame:
    return V.agreed(t.part, ["p_brand", "p_type"], "p_retailprice", 120.0)


@query(
    "deal_comps",
    """WITH d AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice AS v, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'middle' ELSE 'large' END AS size FROM orders WHERE o_orderstatus = 'F'),
s AS (SELECT unnest(range(1994, 2004)) AS year)
SELECT s.year, round(median(d.v), 4) AS median, count(d.v) AS n, count(d.v) FILTER (WHERE size = 'large') AS large FROM s LEFT JOIN d ON s.year = d.year GROUP BY 1""",
)
def deal_comps(t: Tables) -> DataFrame:
    d = t.orders.where("o_orderstatus = 'F'").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_totalprice").alias("v"))
    by_year = d.groupBy("year").agg(F.round(F.median("v"), 4).alias("median"), F.count("v").alias("n"), F.count_if(F.col("v") >= 300000).alias("large"))
    spine = t.spark.range(1994, 2004).select(F.col("id").alias("year"))
    return spine.join(by_year, "year", "left").select("year", "median", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("large", F.lit(0)).alias("large"))


@query(
    "insider_activity",
    """SELECT o_custkey AS person, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS bought, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS sold,
  count(*) AS trades FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders) GROUP BY 1""",
)
def insider_activity(t: Tables) -> DataFrame:
    last = t.orders.agg(F.max("o_orderdate") - F.expr("interval 365 days")).scalar()
    o = t.orders.where(F.col("o_orderdate") >= last)
    part = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    return o.groupBy(F.col("o_custkey").alias("person")).agg(part("O").alias("bought"), part("F").alias("sold"), F.count("*").alias("trades"))

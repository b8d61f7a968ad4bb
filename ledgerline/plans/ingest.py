"""Sources and sinks: documents parsed to rows, files read back, stores merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources import feeds, reports, sinks
from ledgerline.sources.workspace import folder

from .base import Tables, query


@query(
    "call_report_coercion",
    """SELECT c_custkey AS cert, strftime(DATE '2024-03-31' - CAST(c_custkey % 5 AS INTEGER), '%Y-%m-%d') AS repdte, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS asset, c_name AS name FROM customer""",
    dates=["repdte"],
)
def call_report_coercion(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = t.customer.select(
        k.cast("string").alias("cert"), F.date_format(F.date_sub(F.lit("2024-03-31").cast("date"), (k % 5).cast("int")), "yyyyMMdd").alias("repdte"),
        F.when(k % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("asset"), F.col("c_name").alias("name"),
    )
    return reports.coerced(raw, "repdte", ["name"]).withColumn("cert", F.col("cert").cast("long"))


@query(
    "cert_history_limit",
    "SELECT o_custkey AS bank, o_orderkey, o_orderdate AS d, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 8",
    dates=["d"],
)
def cert_history_limit(t: Tables) -> DataFrame:
    return reports.newest_each(t.orders, "o_custkey", "o_orderdate", "o_orderkey", 8).select(F.col("o_custkey").alias("bank"), "o_orderkey", F.col("o_orderdate").alias("d"), "o_totalprice")


@query(
    "company_facts_flatten",
    """SELECT o_custkey AS cik, 'us-gaap' AS taxonomy, 'Revenues' AS concept, 'USD' AS unit, CAST(o_orderdate AS DATE) AS filed, o_totalprice AS val, o_orderpriority AS form FROM orders""",
    dates=["filed"],
)
def company_facts_flatten(t: Tables) -> DataFrame:
    fact = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.col("o_totalprice").alias("val"), F.col("o_orderpriority").alias("form"))
    per = t.orders.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(fact).alias("f"))
    doc = F.to_json(F.struct("cik", F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), F.col("f")).alias("units")))).alias("facts")))
    return reports.facts(per.select(doc.alias("doc")), "doc").select("cik", "taxonomy", "concept", "unit", "filed", "val", "form")


@query("feed_items", "SELECT event_id, 'Event ' || event_type AS title, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_second FROM events")
def feed_items(t: Tables) -> DataFrame:
    when = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    xml = F.concat(F.lit("<item><title>Event "), F.col("event_type"), F.lit("</title><link>http://example.com/x?a=1&amp;b=2</link><pubDate>"), when, F.lit("</pubDate></item>"))
    raw = t.events.select("event_id", xml.alias("xml"))
    return feeds.items(raw, "xml").select("event_id", "title", F.unix_seconds("published_at").alias("at_second"))


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    path = folder(t.spark, "csv")
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    c.write.option("header", True).csv(path)
    return feeds.delimited(t.spark, path, c.schema)


@query(
    "upsert_fresher_wins",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def upsert_fresher_wins(t: Tables) -> DataFrame:
    table = sinks.Table(t.spark, folder(t.spark, "upsert"))
    e = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    order = [F.col("ts"), F.col("event_id")]
    for part in range(2):
        table.upsert(e.where(F.col("event_id") % 2 == part), ["user_id", "event_type"], order)
    return table.read().drop("ts")


@query(
    "overlay_known_fields",
    """WITH a AS (SELECT user_id, max_by(value, event_id) AS v, max_by(event_id, event_id) AS e FROM events WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT user_id, max(CASE WHEN value > 150 THEN value END) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.v, a.v) AS v, a.e FROM a FULL JOIN b ON a.user_id = b.user_id""",
)
def overlay_known_fields(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"), F.max("event_id").alias("e"))
    b = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.max(F.when(F.col("value") > 150, F.col("value"))).alias("v"))
    return sinks.overlaid(a, b, ["user_id"])


@query(
    "unique_insert",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type FROM events)
SELECT user_id, d FROM e WHERE event_type <> 'purchase' AND (user_id, d) NOT IN (SELECT (user_id, d) FROM e WHERE event_type = 'purchase') GROUP BY 1, 2""",
    dates=["d"],
)
def unique_insert(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.to_date("ts").alias("d"), "event_type")
    return sinks.unique(e.where("event_type = 'purchase'"), e.where("event_type != 'purchase'"), ["user_id", "d"]).drop("event_type")


@query("cache_live", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts)) BETWEEN 0 AND 86399")
def cache_live(t: Tables) -> DataFrame:
    now = F.unix_timestamp(F.lit("2024-01-15 00:00:00"))
    e = t.events.withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp"))).where(F.col("s") <= now)
    return sinks.live(e, "s", now, 86400).select("event_id")


@query("guarded_snapshot", "SELECT c_custkey FROM customer")
def guarded_snapshot(t: Tables) -> DataFrame:
    table = sinks.Table(t.spark, folder(t.spark, "snapshot"))
    c = t.customer.select("c_custkey")
    table.publish(c, 0.9)
    table.publish(c.where("c_custkey % 2 = 0"), 0.9)  # too thin: refused
    return table.read()

"""Event store, names, texts and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import numbers as N
from ledgerline.functions import text as X
from ledgerline.operators import entity as E
from ledgerline.operators import events as V
from ledgerline.operators import graph as G
from ledgerline.sources.sinks import Table
from ledgerline.sources.workspace import folder
from ledgerline.streaming import events as S
from ledgerline.streaming.stories import land, stories

from .base import ORACLES, Tables, query

ORDER = ["purchase", "signup", "click", "view"]
RANK_SQL = "CASE source WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"
SQL_STORE = "store AS (SELECT event_id, user_id AS ticker, event_type AS source, props AS headline, ts FROM events)"
KEY_SQL = "trim(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g'))"


def _store(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("user_id").alias("ticker"), F.col("event_type").alias("source"), F.col("props").alias("headline"), "ts")


@query(
    "event_dedup_priority",
    f"""WITH RECURSIVE {SQL_STORE}, k AS (SELECT *, {KEY_SQL} AS key FROM store),
r AS (SELECT ticker, key, event_id, ts, {RANK_SQL} AS rank, row_number() OVER (PARTITION BY ticker, key ORDER BY ts, event_id) AS k FROM k WHERE source <> 'error'),
w AS (SELECT ticker, key, k, event_id, ts, rank, 1 AS story FROM r WHERE k = 1
  UNION ALL SELECT r.ticker, r.key, r.k, CASE WHEN r.ts > w.ts + INTERVAL 5 DAY OR r.rank < w.rank THEN r.event_id ELSE w.event_id END,
    CASE WHEN r.ts > w.ts + INTERVAL 5 DAY OR r.rank < w.rank THEN r.ts ELSE w.ts END, CASE WHEN r.ts > w.ts + INTERVAL 5 DAY OR r.rank < w.rank THEN r.rank ELSE w.rank END,
    CASE WHEN r.ts > w.ts + INTERVAL 5 DAY THEN w.story + 1 ELSE w.story END FROM w JOIN r ON r.ticker = w.ticker AND r.key = w.key AND r.k = w.k + 1)
SELECT max_by(event_id, k) AS event_id, ticker, key, count(*) AS copies FROM w GROUP BY ticker, key, story UNION ALL SELECT event_id, ticker, key, 1 FROM k WHERE source = 'error'""",
)
def event_dedup_priority(t: Tables) -> DataFrame:
    return V.deduplicated(_store(t).withColumn("key", V.headline_key(F.col("headline"))), ["ticker", "key"], ORDER, eligible=ORDER)


@query(
    "event_feed",
    f"""WITH {SQL_STORE}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker, source ORDER BY ts DESC, event_id) AS k FROM store WHERE source <> 'error')
SELECT event_id, ticker, source FROM (SELECT * FROM r WHERE k <= 2 ORDER BY ts DESC, event_id LIMIT 50)""",
)
def event_feed(t: Tables) -> DataFrame:
    return V.capped_feed(_store(t).where("source != 'error'"), ["ticker", "source"], 2, 50).select("event_id", "ticker", "source")


@query(
    "event_cap",
    f"WITH {SQL_STORE} SELECT event_id, ticker, source FROM (SELECT *, row_number() OVER (PARTITION BY ticker, source ORDER BY ts DESC, event_id) AS k FROM store) WHERE k <= 2",
)
def event_cap(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("ticker", "source").orderBy(F.desc("ts"), "event_id")
    return _store(t).withColumn("k", F.row_number().over(w)).where("k <= 2").select("event_id", "ticker", "source")


@query(
    "event_future_clamp",
    "SELECT event_id, ts > TIMESTAMP '2024-01-20 12:00:00' AS clamped, CAST(epoch(CASE WHEN ts > TIMESTAMP '2024-01-20 12:00:00' THEN TIMESTAMP '2024-01-20 00:00:00' ELSE date_trunc('second', ts) END) AS BIGINT) AS at_second FROM events",
)
def event_future_clamp(t: Tables) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", (ts > now + F.expr("interval 12 hours")).alias("clamped"), F.unix_seconds(V.clamped(ts, now)).alias("at_second"))


@query(
    "calendar_merge",
    """WITH a AS (SELECT user_id, CAST(ts AS DATE) AS d, max(CASE WHEN value > 60 THEN value END) AS actual FROM events WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT user_id, CAST(ts AS DATE) AS d, max(CASE WHEN value > 60 THEN value END) AS actual FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT user_id, d, max(actual) AS actual FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""",
    dates=["d"],
)
def calendar_merge(t: Tables) -> DataFrame:
    def of(kind: str) -> DataFrame:
        return t.events.where(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max(F.when(F.col("value") > 60, F.col("value"))).alias("actual"))

    return V.calendar([of("click"), of("view")], ["user_id", "d"], "actual")


@query(
    "topic_curation",
    f"""WITH {SQL_STORE}, h AS (SELECT event_id, ' ' || {KEY_SQL.replace('headline', "source || ' ' || headline")} || ' ' AS h FROM store),
s AS (SELECT event_id, h, (contains(h, ' purchase '))::INT * 3 + (contains(h, ' 69 '))::INT * 2 + (contains(h, ' click '))::INT AS score FROM h),
k AS (SELECT event_id, score, array_to_string((string_split(trim(h), ' '))[1:8], ' ') AS k FROM s WHERE score > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, event_id) AS r FROM k)
SELECT event_id, score FROM b WHERE r = 1 ORDER BY score DESC, event_id LIMIT 25""",
)
def topic_curation(t: Tables) -> DataFrame:
    s = _store(t).withColumn("headline", F.concat_ws(" ", "source", "headline"))
    return V.curated(s, {"purchase": 3, "69": 2, "click": 1}, 25)


@query(
    "universe_feed",
    f"""WITH RECURSIVE store AS (SELECT event_id, user_id % 20 AS ticker, event_type AS source, CASE event_type WHEN 'purchase' THEN 'm_and_a' ELSE event_type END AS kind, props AS headline, ts,
  ['a' || event_id % 2, 'b' || event_id % 3, 'c' || event_id % 5] AS tokens FROM events),
n AS (SELECT *, {KEY_SQL} AS key, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id) AS k FROM store ORDER BY k LIMIT 400),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, ticker BIGINT, key VARCHAR, source VARCHAR, kind VARCHAR, tokens VARCHAR[], ts TIMESTAMP, stage INTEGER)[]) AS st
  UNION ALL SELECT n.k, list_append(st, {{'id': n.event_id, 'ticker': n.ticker, 'key': n.key, 'source': n.source, 'kind': n.kind, 'tokens': n.tokens, 'ts': n.ts, 'stage': CASE
    WHEN n.source <> 'error' AND len(list_filter(st, lambda x: x.ticker = n.ticker AND x.key = n.key AND x.source <> 'error')) > 0 THEN 0
    WHEN n.kind = 'm_and_a' AND len(list_filter(st, lambda x: x.kind = 'm_and_a' AND x.stage >= 2 AND x.ticker = n.ticker AND len(list_intersect(x.tokens, n.tokens)) >= 2 AND coalesce(x.ts - n.ts <= INTERVAL 5 DAY, true))) > 0 THEN 1
    WHEN n.source = 'click' AND len(list_filter(st, lambda x: x.source = 'click' AND x.stage >= 2 AND x.ticker = n.ticker AND x.kind = n.kind)) >= 2 THEN 2 ELSE 3 END}}) FROM w JOIN n ON n.k = w.k + 1)
SELECT x.id AS event_id, CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS position FROM (SELECT unnest(st) AS x, generate_subscripts(st, 1) AS i FROM (SELECT st FROM w ORDER BY k DESC LIMIT 1)) WHERE x.stage = 3""",
)
def universe_feed(t: Tables) -> DataFrame:
    tokens = F.array(*(F.concat(F.lit(c), (F.col("event_id") % k).cast("string")) for c, k in (("a", 2), ("b", 3), ("c", 5))))
    s = _store(t).withColumns({"ticker": F.col("ticker") % 20, "kind": F.when(F.col("source") == "purchase", "m_and_a").otherwise(F.col("source")), "tokens": tokens})
    return V.universe_feed(s, 400, ["error"], ["click"], 2)


@query("exclusion_antijoin", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def exclusion_antijoin(t: Tables) -> DataFrame:
    out = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).union(t.customer.where("c_acctbal < 0").select("c_custkey"))
    return t.customer.select("c_custkey").join(out, "c_custkey", "left_anti")


@query(
    "share_class_primary",
    """SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'ECONOMY' DESC, p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1""",
)
def share_class_primary(t: Tables) -> DataFrame:
    return E.primary(t.part, "p_brand", [F.desc(F.col("p_type") == "ECONOMY"), F.desc("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey")


SQL_EDGES = """edges AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child, 100.0::DOUBLE AS pct, true AS active FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 50 + CAST(c_custkey % 50 AS DOUBLE), c_acctbal >= 0 FROM customer)"""


def _edges(t: Tables) -> DataFrame:
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    a = t.nation.select(name("R", "n_regionkey").alias("parent"), name("N", "n_nationkey").alias("child"), F.lit(100.0).alias("pct"), F.lit(True).alias("active"))
    b = t.customer.select(name("N", "c_nationkey").alias("parent"), name("C", "c_custkey").alias("child"), (50 + F.col("c_custkey") % 50).cast("double").alias("pct"), (F.col("c_acctbal") >= 0).alias("active"))
    return a.unionByName(b)


@query(
    "hierarchy_tree",
    f"""WITH RECURSIVE {SQL_EDGES}, live AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY pct DESC, child) AS place FROM edges WHERE active),
t AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS node, NULL::VARCHAR AS parent, NULL::DOUBLE AS pct, 0 AS depth, NULL::BIGINT AS place FROM region
  UNION ALL SELECT t.root, l.child, l.parent, l.pct, t.depth + 1, l.place FROM t JOIN live l ON t.node = l.parent WHERE t.depth < 4)
SELECT root, node, parent, pct, depth, CAST(place AS INTEGER) AS place FROM t WHERE depth > 0""",
)
def hierarchy_tree(t: Tables) -> DataFrame:
    return G.tree(_edges(t), t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node")))


@query(
    "hierarchy_climb",
    """SELECT 'C' || c_custkey AS node, CASE WHEN c_acctbal >= 0 THEN 'R' || n_regionkey ELSE 'C' || c_custkey END AS top, CASE WHEN c_acctbal >= 0 THEN 2 ELSE 0 END AS steps
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def hierarchy_climb(t: Tables) -> DataFrame:
    return G.climb(_edges(t), t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node")))


@query(
    "membership_as_of",
    """WITH life AS (SELECT o_custkey AS bank, min(o_orderdate) AS start, CASE WHEN max(o_orderdate) < TIMESTAMP '2001-01-01' THEN max(o_orderdate) END AS stop FROM orders GROUP BY 1)
SELECT bank, CASE WHEN bank % 3 = 0 THEN 'base' WHEN stop IS NOT NULL THEN 'failure' ELSE 'lineage' END AS origin FROM life
WHERE start <= TIMESTAMP '1998-06-30' AND (stop IS NULL OR stop >= TIMESTAMP '1998-06-30')""",
)
def membership_as_of(t: Tables) -> DataFrame:
    last = F.max("o_orderdate")
    life = t.orders.groupBy(F.col("o_custkey").alias("bank")).agg(F.min("o_orderdate").alias("start"), F.when(last < F.lit("2001-01-01").cast("timestamp_ntz"), last).alias("stop"))
    origin = F.when(F.col("bank") % 3 == 0, "base").when(F.col("stop").isNotNull(), "failure").otherwise("lineage")
    return G.open_at(life, F.lit("1998-06-30").cast("timestamp_ntz"), "start", "stop").select("bank", origin.alias("origin"))


SUFFIX_SQL = "|".join(E.SUFFIXES)
NAME_SQL = "c_name || CASE c_custkey % 4 WHEN 0 THEN ' Holdings, Inc.' WHEN 1 THEN ' Bancorp' WHEN 2 THEN ' & Co. Group' ELSE '' END"
NORMAL_SQL = f"trim(regexp_replace(trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')), '( ({SUFFIX_SQL}))+$', ''))"


def _names(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    tail = F.when(k == 0, " Holdings, Inc.").when(k == 1, " Bancorp").when(k == 2, " & Co. Group").otherwise("")
    return t.customer.select("c_custkey", "c_acctbal", F.concat("c_name", tail).alias("name"))


@query("name_normalise", f"WITH n AS (SELECT c_custkey, {NAME_SQL} AS name FROM customer) SELECT c_custkey, {NORMAL_SQL} AS name FROM n")
def name_normalise(t: Tables) -> DataFrame:
    return _names(t).select("c_custkey", E.normal(F.col("name")).alias("name"))


TOKENS = lambda c: f"list_filter(list_distinct(string_split(upper({c}), ' ')), lambda x: x NOT IN ({', '.join(repr(x) for x in E.TRIVIAL)}, ''))"


@query(
    "name_jaccard",
    f"""WITH l AS (SELECT p_partkey AS id, {TOKENS("p_name")} AS a FROM part), r AS (SELECT p_partkey AS other, p_retailprice AS weight, {TOKENS("p_name || ' ' || p_type")} AS b FROM part),
j AS (SELECT id, other, weight, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS s FROM l JOIN r ON list_has_any(a, b))
SELECT id, other, round(s, 6) AS similarity, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, weight DESC, other) AS k FROM j WHERE s >= 0.5) WHERE k <= 3""",
)
def name_jaccard(t: Tables) -> DataFrame:
    l = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    r = t.part.select(F.col("p_partkey").alias("other"), F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_retailprice").alias("weight"))
    return E.fuzzy_join(l, r, 0.5, 3).withColumn("similarity", F.round("similarity", 6))


PHRASES = {"red widget": "RWD", "widget": "WID", "small ring": "SRG", "ring": "RNG", "bolt": "BLT"}


@query(
    "entity_tag",
    """SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'RWD' WHEN p_name LIKE '% widget' THEN 'WID' WHEN p_name = 'small ring' THEN 'SRG' WHEN p_name LIKE '% ring' THEN 'RNG' WHEN p_name LIKE '% bolt' THEN 'BLT' END AS entity, CAST(1 AS BIGINT) AS n
FROM part WHERE p_name LIKE '% widget' OR p_name LIKE '% ring' OR p_name LIKE '% bolt'""",
)
def entity_tag(t: Tables) -> DataFrame:
    return E.tagged(t.part, "p_partkey", "p_name", PHRASES)


@query("headline_key", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def headline_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", V.headline_key(F.col("text")).alias("key"))


@query("html_links", """SELECT page_id, len(l) AS n, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def html_links(t: Tables) -> DataFrame:
    l = X.links(F.col("html"))
    return t.pages.select("page_id", F.size(l).cast("long").alias("n"), F.array_join(l, " ").alias("links"))


@query(
    "html_to_text",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) AS text FROM pages""",
)
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.plain(F.col("html")).alias("text"))


@query("url_host", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(url, '^https://') AS secure FROM pages")
def url_host(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.host(F.col("url")).alias("host"), F.col("url").rlike("^https://").alias("secure"))


@query("json_surface", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 AS round_k FROM events")
def json_surface(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.select("event_id", k.alias("k"), (k % 10 == 0).alias("round_k"))


@query(
    "period_normalise",
    """WITH p AS (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, quarter(o_orderdate) AS q, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 3 THEN CAST(y AS VARCHAR) WHEN k = 2 AND y < 2000 THEN NULL ELSE y || 'Q' || q END AS period FROM p""",
)
def period_normalise(t: Tables) -> DataFrame:
    y, q, k = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    written = (
        F.when(k == 0, F.concat(F.lit("q"), q, F.lit(" "), y)).when(k == 1, F.concat(y, F.lit("Q"), q))
        .when((k == 2) & (F.year("o_orderdate") >= 2000), F.concat(q, F.lit("Q"), F.substring(y, 3, 2))).when(k == 2, "unclear").otherwise(F.concat(F.lit("FY"), y))
    )
    return t.orders.select("o_orderkey", N.period_label(written).alias("period"))


@query(
    "accounting_numbers",
    "SELECT c_custkey, c_acctbal AS value FROM customer",
)
def accounting_numbers(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    printed = F.when(b < 0, F.concat(F.lit("($"), F.format_number(-b, 2), F.lit(")"))).otherwise(F.concat(F.lit("$ "), F.format_number(b, 2)))
    return t.customer.select("c_custkey", N.accounting_number(printed).alias("value"))


@query(
    "search_universe",
    """WITH m AS (SELECT c_custkey, c_name, CASE WHEN c_name = 'Customer#000000012' THEN 0 WHEN starts_with(c_name, 'Customer#00000001') THEN 1 WHEN contains(c_name, '12') THEN 2 END AS p FROM customer)
SELECT c_custkey, c_name, p FROM m WHERE p IS NOT NULL ORDER BY p, c_name LIMIT 25""",
)
def search_universe(t: Tables) -> DataFrame:
    n = F.col("c_name")
    p = F.when(n == "Customer#000000012", 0).when(n.startswith("Customer#00000001"), 1).when(n.contains("12"), 2)
    return t.customer.select("c_custkey", "c_name", p.alias("p")).where("p is not null").orderBy("p", "c_name").limit(25)


@query("stream_story_store", ORACLES["event_dedup_priority"])
def stream_story_store(t: Tables) -> DataFrame:
    """The store's events in three shuffled arrivals and a last one that moves the watermark past them all."""
    store = _store(t).withColumn("key", V.headline_key(F.col("headline")))
    arrivals = folder(t.spark, "arrivals")
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for k in range(3):
        store.where(third == k).repartition(1).write.mode("append").parquet(arrivals)
    last = store.groupBy(F.lit(-1).cast("long").alias("event_id")).agg(F.max("ts").alias("ts"))
    late = store.limit(0).unionByName(last.withColumn("ts", F.col("ts") + F.expr("interval 900 days")).withColumn("source", F.lit("close")), allowMissingColumns=True)
    late.coalesce(1).write.mode("append").parquet(arrivals)
    stream = t.spark.readStream.schema(store.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    table = Table(t.spark, folder(t.spark, "stories"))
    land(stories(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["ticker", "key"], ORDER, eligible=ORDER, late="400 days"), table, ["ticker", "key"], folder(t.spark, "progress"))
    return table.read().where("event_id >= 0").select("event_id", "ticker", "key", "copies")


@query("stream_event_dedup", "SELECT user_id, event_type, count(*) AS days FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY 1, 2")
def stream_event_dedup(t: Tables) -> DataFrame:
    stream = S.read(t.spark, f"{t._folder}/events.parque[t]", t.events.schema)
    kept = S.deduplicated(stream.withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"], "40 days")
    return S.landed(kept, t.spark).groupBy("user_id", "event_type").agg(F.count("*").alias("days"))


@query(
    "stream_windowed_counts",
    "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
)
def stream_windowed_counts(t: Tables) -> DataFrame:
    stream = S.read(t.spark, f"{t._folder}/events.parque[t]", t.events.schema)
    return S.collected(S.hourly(stream), t.spark).select(F.unix_seconds("hour").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))

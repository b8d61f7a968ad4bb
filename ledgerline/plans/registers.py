"""Registers: rosters, lists, merges, hierarchies and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import registers as G

from .base import SQL_DAILY, SQL_HOLDINGS, Tables, query

SQL_BRANCHES = """br AS (SELECT s_suppkey AS branch, s_nationkey AS market, CAST(year(l_shipdate) AS BIGINT) AS year, sum(l_quantity) AS deposits FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _branches(t: Tables) -> DataFrame:
    b = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("year")).agg(F.sum("l_quantity").alias("deposits"))
    return b.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("branch"), F.col("s_nationkey").alias("market"), "year", "deposits")


@query("market_list", "SELECT n_regionkey AS code, max(n_name) AS label, count(*) AS n FROM nation GROUP BY 1")
def market_list(t: Tables) -> DataFrame:
    return G.labelled(t.nation.select(F.col("n_regionkey").alias("code"), F.col("n_name").alias("label")), "code", "label")


@query("latest_branch_roster", f"WITH {SQL_BRANCHES} SELECT branch, market, year, deposits FROM br b WHERE year = (SELECT max(year) FROM br x WHERE x.market = b.market)")
def latest_branch_roster(t: Tables) -> DataFrame:
    return G.latest_roster(_branches(t), "market", "year")


@query("branch_roster_top", f"WITH {SQL_BRANCHES} SELECT branch, market, year, deposits, row_number() OVER (PARTITION BY branch ORDER BY deposits DESC NULLS LAST, year) AS place FROM br QUALIFY place <= 3")
def branch_roster_top(t: Tables) -> DataFrame:
    return G.top(_branches(t), ["branch"], [F.desc_nulls_last("deposits"), F.col("year")], 3).withColumn("place", F.col("place").cast("long"))


@query("missing_coordinates", "SELECT c_nationkey AS market, count(*) AS rows, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS missing FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN 1 END AS a, CASE WHEN c_custkey % 5 > 0 THEN 1 END AS b FROM customer) GROUP BY 1")
def missing_coordinates(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_nationkey").alias("market"), F.when(F.col("c_acctbal") >= 0, 1).alias("a"), F.when(F.col("c_custkey") % 5 > 0, 1).alias("b"))
    return G.missing(c, "market", ["a", "b"])


@query(
    "named_sets",
    "SELECT c_custkey, 'Set ' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'ABC,XYZ' WHEN 1 THEN 'A,B' ELSE '' END AS members FROM customer",
)
def named_sets(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, "xyz, abc ,XYZ,").when(k == 1, "b,a,a").otherwise(" ,")
    s = G.named_set(t.customer.select("c_custkey", F.concat(F.lit(" Set "), F.col("c_custkey").cast("string")).alias("name"), raw.alias("members")), "name", "members")
    return s.select(F.substring("name", 5, 20).cast("long").alias("c_custkey"), "name", F.array_join("members", ",").alias("members"))


@query(
    "history_append",
    f"""WITH {SQL_DAILY}, h AS (SELECT d, count(*) AS n FROM daily GROUP BY 1), m AS (SELECT max(d) AS m FROM h) SELECT d, CASE WHEN d = m THEN 99 ELSE n END AS n FROM h, m WHERE d >= m - 10 UNION SELECT m, 99 FROM m""",
    dates=["d"],
)
def history_append(t: Tables) -> DataFrame:
    h = t.daily().groupBy("d").agg(F.count("*").alias("n"))
    last = h.agg(F.max("d").alias("d"))
    return G.appended(h, last.withColumn("n", F.lit(99).cast("long")), "d", last.scalar(), 10)


@query(
    "update_only",
    """WITH f AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS v FROM orders GROUP BY 1) SELECT c_custkey, c_name, coalesce(v, c_acctbal) AS value FROM customer LEFT JOIN f ON c_custkey = o_custkey""",
)
def update_only(t: Tables) -> DataFrame:
    stored = t.customer.select("c_custkey", "c_name", F.col("c_acctbal").alias("value"))
    fresh = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("value"))
    return G.updated(stored, fresh, ["c_custkey"], ["value"])


@query(
    "ownership_buckets",
    f"""WITH {SQL_HOLDINGS}, t AS (SELECT issuer, qi, sum(shares) AS total FROM holdings GROUP BY 1, 2) SELECT *, round((total - lag(total) OVER w) / nullif(lag(total) OVER w, 0) * 100, 6) AS change_pct FROM t WINDOW w AS (PARTITION BY issuer ORDER BY qi)""",
)
def ownership_buckets(t: Tables) -> DataFrame:
    return G.buckets(t.holdings()).withColumn("change_pct", F.round("change_pct", 6))


@query(
    "reverse_holdings",
    f"""WITH {SQL_HOLDINGS}, n AS (SELECT *, max(qi) OVER (PARTITION BY issuer) AS last FROM holdings), o AS (SELECT issuer, holder, qi, value_usd FROM n WHERE qi = last QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY value_usd DESC, holder) <= 25)
SELECT o.issuer, o.holder, o.value_usd, count(*) FILTER (WHERE h.issuer <> o.issuer) AS others, arg_max(h.issuer, {{'v': h.value_usd, 'o': h.issuer}}) FILTER (WHERE h.issuer <> o.issuer) AS largest_other
FROM o JOIN holdings h ON o.holder = h.holder AND o.qi = h.qi GROUP BY 1, 2, 3""",
)
def reverse_holdings(t: Tables) -> DataFrame:
    return G.reverse_holdings(t.holdings())


@query(
    "holder_positions",
    f"""WITH {SQL_HOLDINGS}, p AS (SELECT *, CASE WHEN lag(qi) OVER w = qi - 1 THEN lag(shares) OVER w END AS before, max(qi) OVER (PARTITION BY issuer) AS last FROM holdings WINDOW w AS (PARTITION BY issuer, holder ORDER BY qi)),
o AS (SELECT p_brand AS issuer, sum(p_size) * 10.0::DOUBLE AS outstanding FROM part GROUP BY 1)
SELECT p.issuer, holder, shares, round(shares * 12.5::DOUBLE, 4) AS position, round(shares / outstanding * 100, 6) AS pct_of_outstanding, round(CASE WHEN before <> 0 THEN (shares / before - 1) * 100 END, 6) AS change_pct FROM p LEFT JOIN o ON p.issuer = o.issuer WHERE qi = last""",
)
def holder_positions(t: Tables) -> DataFrame:
    o = t.part.groupBy(F.col("p_brand").alias("issuer")).agg((F.sum("p_size") * 10.0).alias("outstanding"))
    p = G.positions(t.holdings().withColumn("price", F.lit(12.5)), o, "price")
    return p.select("issuer", "holder", "shares", *(F.round(c, d).alias(c) for c, d in (("position", 4), ("pct_of_outstanding", 6), ("change_pct", 6))))


SQL_TRADES = "tr AS (SELECT o_orderkey AS id, o_custkey AS issuer, o_orderkey % 40 AS insider, CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'F' THEN 'S' ELSE 'M' END AS code, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS role FROM orders)"


def _trades(t: Tables) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "O", "P").when(F.col("o_orderstatus") == "F", "S").otherwise("M")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("issuer"), (F.col("o_orderkey") % 40).alias("insider"), code.alias("code"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("role"))


@query("insider_roster", f"WITH {SQL_TRADES} SELECT issuer, insider, arg_max(role, {{'d': date, 'r': role}}) AS role, max(date) AS date FROM tr GROUP BY 1, 2", dates=["date"])
def insider_roster(t: Tables) -> DataFrame:
    return G.roster(_trades(t), ["issuer", "insider"], "date", "role")


@query("open_market_trades", f"WITH {SQL_TRADES} SELECT id, issuer, code, date FROM tr WHERE code IN ('P', 'S') AND date >= DATE '2001-07-01' - 30 ORDER BY date DESC, id LIMIT 60", dates=["date"])
def open_market_trades(t: Tables) -> DataFrame:
    return G.open_market(_trades(t), F.lit("2001-07-01").cast("date"), 30, 60).select("id", "issuer", "code", "date")


SQL_STRUCTURE = """st AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS gone, o_orderkey % 20 AS acquirer, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 50 END AS survivor FROM orders)"""


def _structure(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("id"), F.to_date("o_orderdate").alias("date"), F.when(k % 9 > 0, F.col("o_custkey")).alias("gone"), (k % 20).alias("acquirer"), F.when(k % 7 > 0, k % 50).alias("survivor"))


@query("structure_direction", f"""WITH {SQL_STRUCTURE}, n AS (SELECT *, id % 50 AS node FROM st) SELECT id, CASE WHEN gone = node AND survivor IS NOT NULL AND survivor <> node THEN 'was_acquired'
  WHEN gone IS NOT NULL AND gone <> node AND (coalesce(acquirer = node, false) OR coalesce(survivor = node, false)) THEN 'acquired' ELSE 'other' END AS direction FROM n""")
def structure_direction(t: Tables) -> DataFrame:
    c = F.col
    return _structure(t).select("id", G.direction(c("id") % 50, c("gone"), c("acquirer"), c("survivor")).alias("direction"))


@query("lineage_predecessors", f"""WITH {SQL_STRUCTURE}, b AS (SELECT s_suppkey AS id FROM supplier) SELECT gone, arg_max(survivor, {{'d': date, 's': survivor}}) AS survivor, max(date) AS date FROM st
WHERE date >= DATE '1999-01-01' AND survivor IN (SELECT id FROM b) AND gone IS NOT NULL AND gone NOT IN (SELECT id FROM b) GROUP BY 1""", dates=["date"])
def lineage_predecessors(t: Tables) -> DataFrame:
    return G.absorbed(_structure(t), t.supplier.select(F.col("s_suppkey").alias("id")), F.lit("1999-01-01").cast("date"))


@query("acquisition_history", f"WITH {SQL_STRUCTURE} SELECT survivor, gone, date, row_number() OVER (PARTITION BY survivor ORDER BY date DESC, id) AS place FROM st WHERE survivor IS NOT NULL AND gone IS NOT NULL AND gone <> survivor QUALIFY place <= 10", dates=["date"])
def acquisition_history(t: Tables) -> DataFrame:
    own = _structure(t).where("survivor is not null and gone is not null and gone != survivor")
    return G.top(own, ["survivor"], [F.desc("date"), F.col("id")], 10).select("survivor", "gone", "date", F.col("place").cast("long").alias("place"))


@query("predecessors", f"WITH {SQL_STRUCTURE} SELECT survivor, count(DISTINCT gone) AS n FROM st WHERE survivor IS NOT NULL AND gone IS NOT NULL AND gone <> survivor GROUP BY 1")
def predecessors(t: Tables) -> DataFrame:
    return _structure(t).where("survivor is not null and gone is not null and gone != survivor").groupBy("survivor").agg(F.count_distinct("gone").alias("n"))


@query("lifespans", """SELECT o_custkey AS bank, min(CAST(o_orderdate AS DATE)) AS start, CASE WHEN o_custkey % 4 > 0 AND max(CAST(o_orderdate AS DATE)) <> DATE '9999-12-31' AND o_custkey % 6 > 0 THEN max(CAST(o_orderdate AS DATE)) END AS stop FROM orders GROUP BY 1""", dates=["start", "stop"])
def lifespans(t: Tables) -> DataFrame:
    far = F.lit("9999-12-31").cast("date")
    life = t.orders.groupBy(F.col("o_custkey").alias("bank")).agg(F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("stop"))
    life = life.withColumn("stop", F.when(F.col("bank") % 6 == 0, far).otherwise(F.col("stop")))
    return G.lifespan(life, "stop", far, F.col("bank") % 4 == 0)


@query("holder_targets", "SELECT c_nationkey AS holder, round(sum(c_acctbal), 2) AS total, count(*) AS children, arg_min(c_custkey, {'a': -c_acctbal, 'k': c_custkey}) AS largest FROM customer WHERE c_custkey % 8 > 0 GROUP BY 1")
def holder_targets(t: Tables) -> DataFrame:
    c = t.customer.select(F.when(F.col("c_custkey") % 8 > 0, F.col("c_nationkey")).alias("holder"), F.col("c_custkey").alias("child"), F.col("c_acctbal").alias("size"))
    return G.holder_totals(c, "holder", "child", "size").withColumn("total", F.round("total", 2))


@query("next_meeting", "SELECT min(d) AS next FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) WHERE d > DATE '2024-01-10'", dates=["next"])
def next_meeting(t: Tables) -> DataFrame:
    return G.next_after(t.events.select(F.to_date("ts").alias("day")).distinct(), F.lit("2024-01-10").cast("date"))


@query("series_window", f"WITH {SQL_DAILY} SELECT series, d, n FROM daily x WHERE d >= (SELECT max(d) FROM daily y WHERE y.series = x.series) - 7", dates=["d"])
def series_window(t: Tables) -> DataFrame:
    return G.window_of(t.daily().select("series", "d", "n"), "series", "d", 7)


@query("release_surprises", """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value END AS a, CASE WHEN event_id % 5 > 0 THEN event_id % 7 * 10.0::DOUBLE END AS b FROM events)
SELECT event_id, round(a - b, 4) AS surprise, round(CASE WHEN b <> 0 THEN (a - b) / abs(b) * 100 END * 1e4) / 1e4 AS surprise_pct, a IS NOT NULL AS released FROM e""")
def release_surprises(t: Tables) -> DataFrame:
    from ledgerline.functions.numbers import rounded

    k = F.col("event_id")
    s, pct, out = G.surprise_event(F.when(k % 4 > 0, F.col("value")), F.when(k % 5 > 0, (k % 7) * 10.0))
    return t.events.select("event_id", F.round(s, 4).alias("surprise"), rounded(pct, 4).alias("surprise_pct"), out.alias("released"))


def _calendar(t: Tables, kind: str) -> DataFrame:
    return t.events.where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("d"), "event_id")


@query("soonest_rows", "SELECT user_id, min(CAST(ts AS DATE)) AS d, arg_min(event_id, {'d': CAST(ts AS DATE), 'e': event_id}) AS event_id FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) >= DATE '2024-01-12' GROUP BY 1", dates=["d"])
def soonest_rows(t: Tables) -> DataFrame:
    return G.soonest(_calendar(t, "click"), "user_id", "d", F.lit("2024-01-12").cast("date"), ["event_id"])


@query("calls_agenda", """WITH a AS (SELECT user_id, min(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) >= DATE '2024-01-12' GROUP BY 1), b AS (SELECT user_id, min(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'view' AND CAST(ts AS DATE) >= DATE '2024-01-12' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, least(a.d, b.d) AS d, coalesce(a.d = b.d, false) AS confirmed FROM a FULL JOIN b ON a.user_id = b.user_id""", dates=["d"])
def calls_agenda(t: Tables) -> DataFrame:
    day = F.lit("2024-01-12").cast("date")
    a, b = (G.soonest(_calendar(t, k), "user_id", "d", day, ["event_id"]) for k in ("click", "view"))
    return G.agenda(a, b, "user_id", "d")


@query("series_spread", f"WITH {SQL_DAILY} SELECT a.d, CAST(a.n - b.n AS BIGINT) AS spread FROM daily a JOIN daily b ON a.d = b.d WHERE a.series = 'click' AND b.series = 'view'", dates=["d"])
def series_spread(t: Tables) -> DataFrame:
    d = t.daily()
    return G.spread(d.where("series = 'click'"), d.where("series = 'view'"), "d", "n")


@query("valid_holdings", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_discount > 0")
def valid_holdings(t: Tables) -> DataFrame:
    s = F.when(F.col("l_returnflag") == "R", "9X").when(F.col("l_returnflag") == "A", "BRK.B").otherwise("abc")
    return G.valid_holdings(t.lineitem.select("l_orderkey", "l_linenumber", s.alias("s"), F.col("l_discount").alias("w")), "s", "w").select("l_orderkey", "l_linenumber")


@query("unambiguous_match", """WITH c AS (SELECT p_brand AS key, p_partkey AS candidate, p_size AS score FROM part), m AS (SELECT *, max(score) OVER (PARTITION BY key) AS m FROM c) SELECT key, min(candidate) AS candidate FROM m WHERE score = m GROUP BY 1 HAVING count(*) = 1""")
def unambiguous_match(t: Tables) -> DataFrame:
    return G.choose(t.part.select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("candidate"), F.col("p_size").alias("score")), "key", "candidate", "score")


@query("name_index", "SELECT p_name AS name, p_type AS type, count(DISTINCT p_partkey) AS n, min(p_partkey) AS part FROM part GROUP BY 1, 2")
def name_index(t: Tables) -> DataFrame:
    one, many = G.unique_index(t.part.withColumn("name", F.concat_ws("|", "p_name", "p_type")), "name", "p_partkey")
    every = one.select("name", F.lit(1).cast("long").alias("n")).unionByName(many).join(t.part.groupBy(F.concat_ws("|", "p_name", "p_type").alias("name")).agg(F.min("p_partkey").alias("part")), "name")
    return every.select(F.split("name", "[|]")[0].alias("name"), F.split("name", "[|]")[1].alias("type"), "n", "part")


@query("synonyms_collapsed", """WITH p AS (SELECT p_brand AS grp, p_type AS label, p_partkey AS member, p_retailprice * 1e4 AS value FROM part), m AS (SELECT *, max(value) OVER (PARTITION BY grp, label) AS t FROM p),
f AS (SELECT *, max(CASE WHEN abs(value - t) > greatest(abs(t) * 0.01, 1e6) THEN 1 ELSE 0 END) OVER (PARTITION BY grp, label) AS mixed, row_number() OVER (PARTITION BY grp, label ORDER BY value DESC, member) AS k FROM m)
SELECT grp, label, member FROM f WHERE mixed = 1 OR k = 1""")
def synonyms_collapsed(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_brand").alias("grp"), F.col("p_type").alias("label"), F.col("p_partkey").alias("member"), (F.col("p_retailprice") * 1e4).alias("value"))
    return G.collapsed(p, "grp", "label", "member", "value").select("grp", "label", "member")


@query("equal_values_collapsed", "SELECT p_brand AS grp, min(p_partkey) AS member, p_size AS value FROM part GROUP BY 1, 3")
def equal_values_collapsed(t: Tables) -> DataFrame:
    return G.one_of_equal(t.part.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("member"), F.col("p_size").alias("value")), "grp", "member", "value")


@query("year_aggregate", "SELECT o_custkey AS lender, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS loans, round(sum(o_totalprice), 2) AS amount, count(*) FILTER (WHERE o_orderstatus = 'F') AS filed FROM orders GROUP BY 1, 2")
def year_aggregate(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("lender"), F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("loans"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.count_if(F.col("o_orderstatus") == "F").alias("filed"))


@query("movers", """WITH c AS (SELECT c_custkey, c_mktsegment AS tier, (c_acctbal - 4500) / 45 AS move FROM customer) SELECT c_custkey, tier, round(move, 6) AS move, 'up' AS side FROM c WHERE move > 0 QUALIFY row_number() OVER (PARTITION BY tier ORDER BY move DESC, c_custkey) <= 12
UNION ALL SELECT c_custkey, tier, round(move, 6), 'down' FROM c WHERE move < 0 QUALIFY row_number() OVER (PARTITION BY tier ORDER BY move, c_custkey) <= 12""")
def movers(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("tier"), ((F.col("c_acctbal") - 4500) / 45).alias("move"))
    up = G.top(c.where("move > 0"), ["tier"], [F.desc("move"), F.col("c_custkey")], 12).withColumn("side", F.lit("up"))
    down = G.top(c.where("move < 0"), ["tier"], [F.asc("move"), F.col("c_custkey")], 12).withColumn("side", F.lit("down"))
    return up.unionByName(down).select("c_custkey", "tier", F.round("move", 6).alias("move"), "side")

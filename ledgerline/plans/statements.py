"""Statements stitched from overlapping filings, and compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import filings as S

from .base import SQL_FILINGS, Tables, query

#: A filing covers its own quarter and the four before; every third one leaves its oldest quarter out.
SQL_CELLS = f"""{SQL_FILINGS}, cells AS (SELECT f.bank, f.qi AS filing, g.qi AS period, CASE WHEN f.qi % 3 = 0 AND g.qi = f.qi THEN NULL ELSE round(g.revenue + (f.qi - g.qi) * 0.25, 2) END AS value
  FROM filings f JOIN filings g ON f.bank = g.bank AND g.qi BETWEEN f.qi - 4 AND f.qi)"""


def _cells(t: Tables) -> DataFrame:
    """(bank, filing, period, value): each quarter's figure as later filings restate it; some filings miss their newest one."""
    g = t.filings().select("bank", F.col("qi").alias("period"), "revenue")
    f = t.filings().select("bank", F.col("qi").alias("filing")).withColumn("period", F.explode(F.sequence(F.col("filing") - 4, F.col("filing"))))
    j = f.join(g, ["bank", "period"])
    value = F.when(~((F.col("filing") % 3 == 0) & (F.col("period") == F.col("filing"))), F.round(F.col("revenue") + (F.col("filing") - F.col("period")) * 0.25, 2))
    return j.select("bank", "filing", "period", value.alias("value"))


@query(
    "statement_stitch",
    f"""WITH {SQL_CELLS} SELECT bank, period, max_by(value, filing) FILTER (WHERE value IS NOT NULL) AS value, max(filing) FILTER (WHERE value IS NOT NULL) AS source FROM cells GROUP BY 1, 2""",
)
def statement_stitch(t: Tables) -> DataFrame:
    return S.stitched(_cells(t), ["bank", "period"], "filing", "value")


@query("latest_filed_fact", f"WITH {SQL_CELLS} SELECT bank, period, filing, value FROM (SELECT *, row_number() OVER (PARTITION BY bank, period ORDER BY filing DESC) AS r FROM cells) WHERE r = 1")
def latest_filed_fact(t: Tables) -> DataFrame:
    return S.latest_filed(_cells(t), ["bank", "period"], "filing").select("bank", "period", "filing", "value")


@query(
    "expression_rows",
    """WITH s AS (SELECT o_custkey AS bank, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS a, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS b,
  round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS c FROM orders GROUP BY 1)
SELECT bank, CASE WHEN a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL THEN round(coalesce(a, 0) + coalesce(b, 0) - coalesce(c, 0), 2) END AS numerator,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a + b > 0 THEN round(a + b, 2) END AS denominator FROM s""",
)
def expression_rows(t: Tables) -> DataFrame:
    part = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    s = t.orders.groupBy(F.col("o_custkey").alias("bank")).agg(part("O").alias("a"), part("F").alias("b"), part("P").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return s.select("bank", F.round(S.row_value([(1, a), (1, b), (-1, c)]), 2).alias("numerator"), F.round(S.row_value([(1, a), (1, b)], True), 2).alias("denominator"))


@query(
    "quarter_from_durations",
    f"""WITH {SQL_FILINGS}, y AS (SELECT bank, qi, round(sum(revenue) OVER (PARTITION BY bank, qi // 4 ORDER BY qi), 2) AS ytd, lag(qi) OVER (PARTITION BY bank, qi // 4 ORDER BY qi) AS p FROM filings)
SELECT bank, qi, round(CASE WHEN qi % 4 = 0 THEN ytd WHEN p = qi - 1 THEN ytd - lag(ytd) OVER (PARTITION BY bank, qi // 4 ORDER BY qi) END, 2) AS value, qi % 4 <> 0 AS derived
FROM y QUALIFY value IS NOT NULL""",
)
def quarter_from_durations(t: Tables) -> DataFrame:
    from ledgerline.operators import timeseries as T

    y = T.year_to_date(t.filings(), "bank", "qi", "revenue")
    first = F.make_date(F.floor(F.col("qi") / 4).cast("int"), F.lit(1), F.lit(1))
    facts = y.select("bank", first.alias("start"), F.last_day(F.add_months(first, (F.col("qi") % 4 * 3 + 2).cast("int"))).alias("end"), F.round("ytd", 2).alias("value"), "qi")
    q = S.quarter_from_durations(facts, ["bank"], "start", "end", "value")
    return q.select("bank", (F.year("end") * 4 + F.quarter("end") - 1).cast("long").alias("qi"), F.round("value", 2).alias("value"), "derived")


@query(
    "composition_reconcile",
    """WITH p AS (SELECT p_partkey // 6 AS grp, p_partkey AS member, CAST(p_size * 100 + p_partkey % 7 AS BIGINT) AS v FROM part), t AS (SELECT grp, sum(v) FILTER (WHERE member % 6 < 3) AS total FROM p GROUP BY 1),
g AS (SELECT p.grp, list(member ORDER BY member) AS ms, list(v ORDER BY member) AS vs, sum(v) AS every, any_value(total) AS total FROM p JOIN t ON p.grp = t.grp WHERE total IS NOT NULL GROUP BY 1),
c AS (SELECT grp, ms, vs, total, every, m FROM g, (SELECT unnest(range(1, 64)) AS m) WHERE m < (1 << len(ms))),
s AS (SELECT grp, m, ms, vs FROM c WHERE every <> total AND list_sum(list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN vs[i] ELSE 0 END)) = total),
n AS (SELECT grp, count(*) AS n, any_value(m) AS m, any_value(ms) AS ms, any_value(vs) AS vs FROM s GROUP BY 1),
u AS (SELECT grp, unnest(range(1, len(ms) + 1)) AS i, m, ms, vs FROM n WHERE n = 1)
SELECT grp, unnest(ms) AS member, CAST(unnest(vs) AS DOUBLE) AS value, 'all' AS stage FROM g WHERE every = total
UNION ALL SELECT grp, ms[i], CAST(vs[i] AS DOUBLE), 'unique' FROM u WHERE (m >> (i - 1)) & 1 = 1 UNION ALL SELECT grp, NULL, NULL, 'several' FROM n WHERE n > 1
UNION ALL SELECT grp, NULL, NULL, 'none' FROM g WHERE every <> total AND grp NOT IN (SELECT grp FROM n)""",
)
def composition_reconcile(t: Tables) -> DataFrame:
    p = t.part.select(F.floor(F.col("p_partkey") / 6).alias("grp"), F.col("p_partkey").alias("member"), (F.col("p_size") * 100 + F.col("p_partkey") % 7).cast("double").alias("value"))
    totals = p.where("member % 6 < 3").groupBy("grp").agg(F.sum("value").alias("total"))
    return S.compositions(p.join(totals, "grp"), "grp", "member", "value", "total", 0.5, None)


@query(
    "statement_row_order",
    """WITH RECURSIVE r AS (SELECT l_suppkey AS company, year(l_shipdate) AS filing, p_name AS label, min({'o': l_orderkey, 'n': l_linenumber}) AS first_at FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
n AS (SELECT company, label, row_number() OVER (PARTITION BY company ORDER BY filing DESC, first_at, label) AS k, row_number() OVER (PARTITION BY company, filing ORDER BY first_at, label) AS f FROM r),
w AS (SELECT DISTINCT company, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ls, '' AS before FROM n
  UNION ALL SELECT company, k, CASE WHEN list_contains(ls, label) THEN ls ELSE list_concat(list_concat(ls[:p], [label]), ls[p + 1:]) END, label
  FROM (SELECT n.company, n.k, ls, label, CASE WHEN f = 1 THEN 0 ELSE list_position(ls, before) END AS p FROM w JOIN n ON n.company = w.company AND n.k = w.k + 1)),
l AS (SELECT company, ls FROM w QUALIFY row_number() OVER (PARTITION BY company ORDER BY k DESC) = 1)
SELECT company, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS position, unnest(ls) AS label FROM l""",
)
def statement_row_order(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    first = rows.groupBy(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("filing"), "p_name").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("at"))
    lists = first.groupBy("company", "filing").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "p_name"))), lambda x: x["p_name"]).alias("labels"))
    return S.row_order(lists, "company", "filing", "labels")

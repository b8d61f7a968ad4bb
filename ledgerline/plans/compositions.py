"""Breakdowns by member and walks to capital; members and figures are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import capitalwalk as W
from ledgerline.operators import compositions as C

from .base import SQL_FILINGS, Tables, query

SQL_TREE = """m AS (SELECT p_partkey % 7 AS grp, p_partkey // 7 AS member, p_size AS value FROM part WHERE p_size % 3 = 0), l AS (SELECT p_partkey % 7 AS grp, p_partkey // 7 // 2 AS parent, p_partkey // 7 AS child FROM part WHERE p_partkey // 7 > 0
  UNION ALL SELECT p_partkey % 7, p_partkey // 7, p_partkey // 7 - 40 FROM part WHERE p_partkey // 7 % 97 = 60)"""


def _whole(c: str, n: int):
    return F.floor(F.col(c) / n)


@query(
    "composition_leaves",
    f"""WITH RECURSIVE {SQL_TREE}, up AS (SELECT grp, member, parent AS above FROM m JOIN l USING (grp) WHERE child = member UNION SELECT up.grp, member, parent FROM up JOIN l ON l.grp = up.grp AND l.child = up.above)
SELECT grp, member, value FROM m WHERE (grp, member) NOT IN (SELECT (grp, above) FROM up)""",
)
def composition_leaves(t: Tables) -> DataFrame:
    p = t.part.select((F.col("p_partkey") % 7).alias("grp"), _whole("p_partkey", 7).alias("member"), F.col("p_size").alias("value"))
    tree = p.where("member > 0").select("grp", _whole("member", 2).alias("parent"), F.col("member").alias("child"))
    loops = p.where("member % 97 = 60").select("grp", F.col("member").alias("parent"), (F.col("member") - 40).alias("child"))
    return C.without_parents(p.where("value % 3 = 0"), tree.union(loops), "grp", "member")


#: Groups of eight: five parts, two sums of them (off by little in some groups), an unrelated line in some.
SQL_MEMBERS = """base AS (SELECT p_partkey // 8 AS grp, p_partkey % 8 AS k, CAST(CASE WHEN p_partkey // 8 % 9 = 4 THEN 100 ELSE p_size * 1000 + p_partkey * 37 % 991 END AS DOUBLE) AS v FROM part),
five AS (SELECT grp, max(v) FILTER (WHERE k = 0) AS a, max(v) FILTER (WHERE k = 1) AS b, max(v) FILTER (WHERE k = 2) AS c, max(v) FILTER (WHERE k = 3) AS d, max(v) FILTER (WHERE k = 4) AS e FROM base GROUP BY 1 HAVING count(*) = 8),
flat AS (SELECT grp, unnest([a, b, c, d, e, a + b, c + d + e, CASE grp % 4 WHEN 0 THEN 77e0 WHEN 1 THEN e ELSE -5e0 END]) AS value, unnest(range(8)) AS member, a + b + c + d + e + CASE WHEN grp % 5 = 3 THEN 3e4 ELSE 0 END AS total FROM five)"""
SQL_MASKS = """list_of AS (SELECT grp, list(member ORDER BY member) AS ms, list(value ORDER BY member) AS vs, any_value(total) AS total FROM w WHERE value > 0 GROUP BY 1),
mask AS (SELECT *, bit_count(m) AS n, list_sum(list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN vs[i] ELSE 0 END)) AS s FROM (SELECT *, unnest(range(1, 1 << len(ms))) AS m FROM list_of)),
fit AS (SELECT * FROM mask WHERE n >= 2 AND abs(s - total) <= greatest(total * 1e-4, 0.5)),
best AS (SELECT *, count(*) OVER (PARTITION BY grp) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY grp) AS most, count(*) OVER (PARTITION BY grp) AS fits FROM fit) WHERE n = most),
bad AS (SELECT DISTINCT b.grp FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM best WHERE ties = 1) b WHERE (b.m >> (i - 1)) & 1 = 0
  AND NOT EXISTS (SELECT 1 FROM mask x WHERE x.grp = b.grp AND x.m & b.m = x.m AND x.n >= 2 AND abs(x.s - b.vs[i]) <= greatest(b.vs[i] * 1e-4, 0.5))),
judged AS (SELECT l.grp, l.ms, l.vs, l.total, b.m, CASE WHEN b.grp IS NULL THEN 'none' WHEN b.ties > 1 THEN 'several' WHEN x.grp IS NOT NULL THEN 'inconsistent' ELSE 'finest' END AS status, f.m AS sole
  FROM list_of l LEFT JOIN (SELECT DISTINCT ON (grp) * FROM best) b ON l.grp = b.grp LEFT JOIN bad x ON l.grp = x.grp LEFT JOIN (SELECT grp, any_value(m) AS m FROM fit GROUP BY 1 HAVING count(*) = 1) f ON l.grp = f.grp)"""


def _members(t: Tables) -> DataFrame:
    base = t.part.select(
        _whole("p_partkey", 8).alias("grp"), (F.col("p_partkey") % 8).alias("k"),
        F.when(_whole("p_partkey", 8) % 9 == 4, 100.0).otherwise((F.col("p_size") * 1000 + F.col("p_partkey") * 37 % 991).cast("double")).alias("v"),
    )
    v = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    five = base.groupBy("grp").agg(*(v(k).alias(n) for k, n in enumerate("abcde")), F.count("*").alias("n")).where("n = 8")
    last = F.when(F.col("grp") % 4 == 0, 77.0).when(F.col("grp") % 4 == 1, F.col("e")).otherwise(-5.0)
    values = F.array(*"abcde", F.expr("a + b"), F.expr("c + d + e"), last)
    total = F.expr("a + b + c + d + e") + F.when(F.col("grp") % 5 == 3, 3e4).otherwise(0)
    return five.select("grp", total.alias("total"), F.posexplode(values).alias("member", "value"))


@query(
    "finest_partition",
    f"""WITH {SQL_MEMBERS}, w AS (SELECT * FROM flat), {SQL_MASKS}
SELECT grp, status, CAST(ms[i] AS INTEGER) AS member, vs[i] AS value FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM judged WHERE status = 'finest') WHERE (m >> (i - 1)) & 1 = 1 UNION ALL SELECT grp, status, NULL, NULL FROM judged WHERE status <> 'finest'""",
)
def finest_partition(t: Tables) -> DataFrame:
    m = _members(t)
    return C.finest_partition(m.drop("total"), m.groupBy("grp").agg(F.max("total").alias("total")), "grp", "member", "value", 0.5)


@query(
    "member_compositions",
    f"""WITH {SQL_MEMBERS}, labelled AS (SELECT *, CASE WHEN member = 7 AND grp % 2 = 1 THEN 'L4' ELSE 'L' || member END AS label FROM flat), alike AS (SELECT *, max(value) OVER l AS top FROM labelled WINDOW l AS (PARTITION BY grp, label)),
known AS (SELECT *, bool_and(abs(value - top) <= greatest(abs(top) * 0.01, 1)) OVER (PARTITION BY grp, label) AS same, row_number() OVER (PARTITION BY grp, label ORDER BY value DESC, member) AS k FROM alike), w AS (SELECT grp, member, value, total FROM known WHERE NOT same OR k = 1), {SQL_MASKS},
st AS (SELECT grp, 0 AS k, 'equal' AS stage, min(member) AS member, value FROM w GROUP BY grp, value
  UNION ALL SELECT grp, 1, 'linked', member, value FROM w WHERE NOT (grp % 3 = 0 AND member IN (5, 6) AND EXISTS (SELECT 1 FROM w x WHERE x.grp = w.grp AND x.member IN (0, 1, 2, 3, 4)))
  UNION ALL SELECT grp, 2, 'finest', ms[i], vs[i] FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM judged WHERE status = 'finest') WHERE (m >> (i - 1)) & 1 = 1
  UNION ALL SELECT grp, 3, 'sole', ms[i], vs[i] FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM judged WHERE sole IS NOT NULL) WHERE (sole >> (i - 1)) & 1 = 1),
f AS (SELECT grp, min(k) AS k FROM (SELECT s.grp, k FROM st s JOIN (SELECT DISTINCT grp, total FROM w) t ON s.grp = t.grp GROUP BY s.grp, k HAVING count(*) >= 2 AND abs(sum(value) - any_value(total)) <= any_value(total) * 0.01) GROUP BY 1)
SELECT grp, stage, CAST(member AS INTEGER) AS member, value FROM st JOIN f USING (grp, k) UNION ALL SELECT DISTINCT grp, 'unresolved', CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE) FROM w WHERE grp NOT IN (SELECT grp FROM f)""",
)
def member_compositions(t: Tables) -> DataFrame:
    m = _members(t).withColumn("label", F.when((F.col("member") == 7) & (F.col("grp") % 2 == 1), "L4").otherwise(F.concat(F.lit("L"), F.col("member").cast("string"))))
    arcs = F.array(*(F.struct(F.lit(a).alias("parent"), F.lit(b).alias("child")) for a, b in ((5, 9), (9, 0), (5, 1), (6, 2), (6, 3), (6, 4), (0, 5))))
    links = m.where("grp % 3 = 0").select("grp").distinct().select("grp", F.explode(F.slice(arcs, 1, 6)).alias("x")).select("grp", "x.*")
    return C.resolved(m.drop("total"), m.groupBy("grp").agg(F.max("total").alias("total")), links, "grp", "member", "label", "value", 0.01, 0.5, 1.0)


SQL_WALK = f"""{SQL_FILINGS}, own AS (SELECT bank, qi, revenue * 10 AS eq, revenue AS gw, bank * 31 + qi * 17 AS k, unnest([0, 1]) AS late FROM filings),
parts AS (SELECT bank, qi, late, CASE WHEN k % 23 > 0 THEN eq END AS total_equity, CASE WHEN k % 3 = 0 THEN gw / 4 END AS preferred, CASE WHEN k % 19 > 0 THEN gw END AS goodwill, CASE WHEN k % 2 = 0 THEN gw / 8 END AS other_intangibles,
  CASE WHEN k % 4 > 0 THEN -gw END AS aoci, CASE WHEN k % 7 = 0 THEN gw * 2 END AS subordinated_debt, k, eq, gw FROM own WHERE late = 0 OR k % 6 = 1),
target AS (SELECT *, coalesce(total_equity, eq) - coalesce(preferred, 0) - coalesce(goodwill, gw) - coalesce(other_intangibles, 0) - CASE WHEN k % 8 IN (1, 2) THEN coalesce(aoci, 0) ELSE 0 END + CASE WHEN (k + late) % 5 = 0 THEN gw * 3 ELSE 0 END AS t FROM parts),
walks AS (SELECT *, total_equity - coalesce(preferred, 0) AS common_equity, goodwill + coalesce(other_intangibles, 0) AS intangibles, CASE WHEN k % 29 > 0 THEN t END AS target, CASE WHEN k % 29 > 0 THEN CASE k % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'parent' ELSE 'fuzzy' END ELSE 'ambiguous' END AS basis FROM target),
built AS (SELECT *, common_equity - intangibles AS i, common_equity - intangibles - coalesce(aoci, 0) AS o FROM walks),
status AS (SELECT *, CASE WHEN i IS NULL OR target IS NULL THEN 'incomplete' WHEN abs(i - target) <= greatest(target * 0.01, 1) THEN 'included' WHEN abs(o - target) <= greatest(target * 0.01, 1) THEN 'excluded' ELSE 'unreconciled' END AS status FROM built)"""


def _walk_facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Facts of balance sheets with and without dimensions, and of capital by basis; some filings state a quarter again a year later."""
    own = t.filings().withColumn("k", F.expr("bank * 31 + qi * 17")).withColumn("late", F.explode(F.when(F.col("k") % 6 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    own = own.withColumns({"eq": F.col("revenue") * 10, "gw": F.col("revenue"), "filing": F.concat_ws("-", "bank", "qi", "late")})
    rows = [
        ("k % 23 > 0", "us-gaap:StockholdersEquity", "eq", None), ("k % 23 > 0", "us-gaap:StockholdersEquity", "eq / 2", "PreferredStockMember"), ("k % 3 = 0", "us-gaap:PreferredStockValue", "gw / 4", None),
        ("k % 3 = 0", "us-gaap:PreferredStockIncludingAdditionalPaidInCapitalNetOfDiscount", "gw", None), ("k % 19 > 0", "us-gaap:Goodwill", "gw", None), ("k % 19 > 0", "us-gaap:Goodwill", "gw * 7", None),
        ("k % 2 = 0", "us-gaap:FiniteLivedIntangibleAssetsNet", "gw / 8", None), ("k % 4 > 0", "us-gaap:AccumulatedOtherComprehensiveIncomeLossNetOfTax", "-gw", None), ("k % 7 = 0", "us-gaap:SubordinatedBorrowings", "gw * 2", None),
    ]
    each = F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("concept"), F.expr(v).alias("value"), (F.create_map(F.lit("us-gaap:EquityAxis"), F.lit(m)) if m else F.expr("map()").cast("map<string,string>")).alias("dims"))) for c, n, v, m in rows))
    facts = own.select("filing", "bank", "late", F.col("qi").alias("period"), F.posexplode(each).alias("place", "f")).where("f is not null").select("filing", "bank", "late", "period", "place", "f.*")
    zero = lambda c, e: f"CASE WHEN {c} THEN {e} ELSE 0 END"
    t0 = F.expr(f"eq - {zero('k % 3 = 0', 'gw / 4')} - gw - {zero('k % 2 = 0', 'gw / 8')} - {zero('k % 8 IN (1, 2) AND k % 4 > 0', '-gw')} + {zero('(k + late) % 5 = 0', 'gw * 3')}")
    best = F.when(F.col("k") % 3 == 0, "default").when(F.col("k") % 3 == 1, "parent").otherwise("fuzzy")
    told = lambda basis, confidence, value: F.struct(F.lit(basis).alias("basis"), confidence.cast("string").alias("confidence"), value.cast("double").alias("value"))
    stated = F.array(told("holdco", best, t0), told("bank", F.lit(None), t0 * 2), told("holdco", F.when(F.col("k") % 3 < 2, "fuzzy"), t0 * 3), told("holdco", F.when(F.col("k") % 29 == 0, best), t0 * 5))
    capital = own.select("filing", F.col("qi").alias("period"), F.explode(stated).alias("s")).select("filing", "period", "s.*")
    return facts, capital


WALK = ["total_equity", "preferred", "goodwill", "other_intangibles", "aoci", "subordinated_debt", "common_equity", "intangibles", "target", "built", "residual"]


@query(
    "capital_walk",
    f"WITH {SQL_WALK} SELECT bank, qi AS period, late, basis, status, {', '.join(f'round({c}, 6) AS {c}' for c in WALK[:9])}, round(b, 6) AS built, round(target - b, 6) + 0e0 AS residual FROM (SELECT *, CASE WHEN status <> 'incomplete' THEN CASE WHEN status = 'excluded' OR (status = 'unreconciled' AND abs(o - target) < abs(i - target)) THEN o ELSE i END END AS b FROM status)",
)
def capital_walk(t: Tables) -> DataFrame:
    facts, capital = _walk_facts(t)
    w = W.walk(W.steps(facts, "filing"), W.targets(capital, "filing"), "filing", 0.01, 1.0)
    part = lambda k: F.split_part("filing", F.lit("-"), F.lit(k)).cast("long")
    return w.select(part(1).alias("bank"), "period", part(3).cast("int").alias("late"), "basis", "status", *(F.round(c, 6).alias(c) for c in WALK[:-1]), (F.round("residual", 6) + F.lit(0.0)).alias("residual"))


@query(
    "capital_walk_stitched",
    f"WITH {SQL_WALK} SELECT bank, qi AS period, late, status FROM (SELECT *, row_number() OVER (PARTITION BY bank, qi ORDER BY status IN ('included', 'excluded') DESC, late DESC) AS r FROM status) WHERE r = 1",
)
def capital_walk_stitched(t: Tables) -> DataFrame:
    return W.stitched(capital_walk(t), "bank", "late").select("bank", "period", "late", "status")

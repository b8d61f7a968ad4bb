"""Two registries that name the same companies differently; names are composed of the tables' nations and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import registry as R

from .base import Tables, query

KINDS = ["First", "Citizens", "Peoples", "Farmers & Merchants", "United"]
TAILS = ["Bancorp Inc", "BANCORPORATION, INC.", "Bancshares", "Bank (NC)", "National Corp /MD/", "Bancorp Inc of Louisiana", ""]
_pick = lambda xs, k: f"(['{"', '".join(xs)}'])[CAST({k} % {len(xs)} + 1 AS INTEGER)]"
SQL_SPELT = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in [("BANCORPORATION", "BCORP"), ("BANCORP", "BCORP"), ("BANCSHARES", "BSHRS"), ("NATIONAL", "NATL")]) + " ELSE w END"
SQL_TOKENS = f"list_transform(list_filter(string_split(regexp_replace(replace(regexp_replace(upper({{0}}), '\\s*(?:/[A-Z]{{{{2,3}}}}/?|\\([A-Z]{{{{2}}}}\\))\\s*$', ''), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: {SQL_SPELT})"
SQL_NAMES = f"""l AS (SELECT c_custkey AS ticker, {_pick(KINDS, 'c_custkey // 11')} || ' ' || n_name || ' ' || {_pick(TAILS, 'c_custkey // 5')} AS name, CASE WHEN c_custkey % 4 > 0 THEN [c_nationkey % 6] ELSE [] END AS states FROM customer JOIN nation ON n_nationkey = c_nationkey),
r AS (SELECT s_suppkey AS cert, {_pick(KINDS, 's_suppkey // 3')} || ' ' || n_name || ' ' || {_pick(TAILS, 's_suppkey // 2')} AS holder, [s_nationkey % 6, s_suppkey % 6] AS states, floor(s_acctbal / 1000) AS size FROM supplier JOIN nation ON n_nationkey = s_nationkey),
lc AS (SELECT *, array_to_string({SQL_TOKENS.format('name')}, '') AS c FROM l), rc AS (SELECT *, array_to_string({SQL_TOKENS.format('holder')}, '') AS c FROM r)"""
SQL_ALIKE = "least(len(lc.c), len(rc.c)) >= 8 AND (contains(lc.c, rc.c) OR contains(rc.c, lc.c)) OR least(len(lc.c), len(rc.c)) >= 12 AND lc.c[:CAST(ceil(least(len(lc.c), len(rc.c)) * 0.8) AS INTEGER)] = rc.c[:CAST(ceil(least(len(lc.c), len(rc.c)) * 0.8) AS INTEGER)]"


def _of(xs: list[str], key: str, by: int):
    return F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.col(key) / by) % len(xs) + 1).cast("int"))


def _names(t: Tables) -> tuple[DataFrame, DataFrame]:
    nation = t.nation.select("n_nationkey", "n_name")
    text = lambda c: (c % 6).cast("string")
    left = t.customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("ticker"), F.concat_ws(" ", _of(KINDS, "c_custkey", 11), "n_name", _of(TAILS, "c_custkey", 5)).alias("name"),
        F.when(F.col("c_custkey") % 4 > 0, F.array(text(F.col("c_nationkey")))).otherwise(F.array().cast("array<string>")).alias("states"),
    )
    right = t.supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("cert"), F.concat_ws(" ", _of(KINDS, "s_suppkey", 3), "n_name", _of(TAILS, "s_suppkey", 2)).alias("holder"),
        F.array(text(F.col("s_nationkey")), text(F.col("s_suppkey"))).alias("states"), F.floor(F.col("s_acctbal") / 1000).cast("double").alias("size"),
    )
    return left, right


@query("registry_links", f"WITH {SQL_NAMES} SELECT ticker, cert FROM lc JOIN rc ON {SQL_ALIKE}")
def registry_links(t: Tables) -> DataFrame:
    left, right = _names(t)
    return R.name_links(left, right, "ticker", "name", "cert", "holder")


@query(
    "registry_match",
    f"""WITH {SQL_NAMES}, eq AS (SELECT ticker, cert, 1 AS phase FROM lc JOIN rc ON lc.c = rc.c), ln AS (SELECT ticker, cert, 2 AS phase FROM (SELECT * FROM lc WHERE ticker NOT IN (SELECT ticker FROM eq)) lc JOIN rc ON {SQL_ALIKE}),
p AS (SELECT x.*, l.states AS ls, r.size, len(list_intersect(l.states, r.states)) > 0 AS fits FROM (SELECT * FROM eq UNION ALL SELECT * FROM ln) x JOIN l USING (ticker) JOIN r USING (cert)),
b AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n, max(size) FILTER (WHERE fits) OVER (PARTITION BY ticker) AS best FROM p),
g AS (SELECT ticker, phase, count(*) FILTER (WHERE ok) AS c, min(cert) FILTER (WHERE ok) AS cert, max(len(ls)) AS k FROM (SELECT *, CASE WHEN len(ls) > 0 THEN fits AND size = best ELSE n = 1 END AS ok FROM b) GROUP BY 1, 2)
SELECT l.ticker, CASE WHEN c = 1 THEN cert END AS cert, phase, CASE WHEN c IS NULL THEN 'none' WHEN c = 1 THEN 'matched' WHEN c > 1 THEN 'tied' WHEN k = 0 THEN 'ambiguous' ELSE 'state' END AS status FROM l LEFT JOIN g USING (ticker)""",
)
def registry_match(t: Tables) -> DataFrame:
    left, right = _names(t)
    return R.matched(left, right, "ticker", "cert")


@query(
    "registry_flags",
    f"""WITH {SQL_NAMES}, j AS (SELECT ticker, ticker % 120 AS cert, name, c, {SQL_TOKENS.format('name')} AS tk, states, ticker * 7 % 100 AS assets, CASE WHEN ticker % 3 > 0 THEN ticker // 2 END AS cik FROM lc),
q AS (SELECT cert, c, {SQL_TOKENS.format('holder')} AS hk, states, cert % 5 = 0 AS multi, cert % 4 AS assets FROM rc),
m AS (SELECT j.*, q.cert IS NOT NULL AS there, hk, q.c AS hc, q.states AS rs, multi, q.assets AS ra, count(DISTINCT coalesce(CAST(cik AS VARCHAR), name)) OVER (PARTITION BY j.cert) AS claims FROM j LEFT JOIN q ON j.cert = q.cert),
f AS (SELECT ticker, cert, unnest([CASE WHEN NOT there THEN 'missing' END,
  CASE WHEN there AND NOT (len(list_intersect(list_filter(tk, lambda w: NOT list_contains(['AND', 'BCORP', 'BSHRS', 'CORP', 'INC', 'NATL', 'BANK', 'FIRST', 'UNITED', 'OF'], w)), hk)) > 0 OR least(len(c), len(hc)) >= 8 AND (contains(c, hc) OR contains(hc, c)) OR least(len(c), len(hc)) >= 12 AND c[:CAST(ceil(least(len(c), len(hc)) * 0.8) AS INTEGER)] = hc[:CAST(ceil(least(len(c), len(hc)) * 0.8) AS INTEGER)]) THEN 'mismatch' END,
  CASE WHEN there AND len(states) > 0 AND len(list_intersect(states, rs)) = 0 THEN 'state' END, CASE WHEN there AND NOT multi AND ra > 0 AND assets >= 20 * ra THEN 'size' END, CASE WHEN there AND claims > 1 THEN 'shared' END]) AS flag FROM m)
SELECT ticker, cert, flag FROM f WHERE flag IS NOT NULL""",
)
def registry_flags(t: Tables) -> DataFrame:
    left, right = _names(t)
    k = F.col("ticker")
    joins = left.withColumns({"cert": k % 120, "assets": (k * 7 % 100).cast("double"), "cik": F.when(k % 3 > 0, F.floor(k / 2))})
    records = right.select("cert", F.col("holder").alias("bank"), "holder", "states", (F.col("cert") % 5 == 0).alias("multibank"), (F.col("cert") % 4).cast("double").alias("assets"))
    return R.flags(joins, records)

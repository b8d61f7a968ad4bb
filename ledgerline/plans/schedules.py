"""Call-report schedules; a report is a customer's year, its figures follow from keys and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import schedules as S

from .base import Tables, query, spread

CODES = [c for lists in S.PAST_DUE.values() for codes in lists for c in codes] + S.TOTALS
LINES = {"common": "P742", "retained": "KW00", "aoci": "B530", "goodwill": "P841", "other_intangibles": "P842", "unrealised": "P844", "cet1": "P859"}
DERIVED = {"intangibles": [(-1, "goodwill"), (-1, "other_intangibles")]}
RESIDUALS = {"other_adjustments": ("cet1", ["common", "retained", "aoci", "intangibles"])}
ITEMS = {"legal": "4141", "marketing": "0497", "assessments": "4146"}
WRITTEN = ["4464", "4467", "4468"]
SQL_REPORTS = "reports AS (SELECT o_custkey AS bank, CAST(year(o_orderdate) AS INTEGER) AS period, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2)"


def _reports(t: Tables, codes: list[str], prefixes: list[str]) -> DataFrame:
    """Rows of codes: consolidated ones from every third bank, some as floats, text or NaN; figures by bank, year, code's place and prefix."""
    r = spread(t.orders.groupBy(F.col("o_custkey").alias("bank"), F.year("o_orderdate").alias("period")).agg(F.count("*").alias("n")), "bank")
    every = F.array(*(F.struct(F.lit(p.lower() + c).alias("mdrm"), F.lit(j).alias("j"), F.lit(k).alias("k")) for j, p in enumerate(prefixes) for k, c in enumerate(codes)))
    x = r.select("*", F.explode(every).alias("x")).select("bank", "period", "n", "x.*").withColumn("h", F.expr("(bank * 7 + period * 3 + k * 5 + j) % 11"))
    x = x.where("h > 2 and (j > 0 or bank % 3 = 0)").withColumn("v", F.expr("n * 10 + h * (k % 4) - CASE WHEN k % 6 = 5 THEN 40 ELSE 0 END"))
    kind = F.when(F.col("h") == 3, "float").when(F.col("h") == 4, "str").otherwise("int")
    return x.select(
        "bank", "period", "mdrm", kind.alias("data_type"), F.when(F.col("h") > 4, F.col("v")).alias("int_data"),
        F.when(F.col("h") == 3, F.when(F.col("k") % 7 == 6, float("nan")).otherwise(F.col("v") + 0.5)).alias("float_data"), F.when(F.col("h") == 4, "12").alias("str_data"),
    )


def _sql(codes: list[str], prefixes: list[str]) -> str:
    values = ", ".join(f"('{p}', {j}, '{c}', {k})" for j, p in enumerate(prefixes) for k, c in enumerate(codes))
    return f"""{SQL_REPORTS}, x AS (SELECT *, (bank * 7 + period * 3 + k * 5 + j) % 11 AS h FROM reports, (VALUES {values}) c (prefix, j, code, k)),
f AS (SELECT bank, period, j, code, CASE WHEN h > 4 THEN CAST(v AS DOUBLE) ELSE v + 0.5e0 END AS value FROM (SELECT *, n * 10 + h * (k % 4) - CASE WHEN k % 6 = 5 THEN 40 ELSE 0 END AS v FROM x WHERE h > 2 AND (j > 0 OR bank % 3 = 0)) WHERE h > 4 OR (h = 3 AND k % 7 <> 6))"""


_CELLS = ", ".join(f"('{c}', '{s}', '{code}')" for c, lists in S.PAST_DUE.items() for s, codes in zip(S.STATUSES, lists) for code in codes)
_ALL = ", ".join(f"('{c}', '{s}')" for c in [*S.PAST_DUE, "total", "other"] for s in S.STATUSES)
_TOTALS = ", ".join(f"('{s}', '{c}')" for s, c in zip(S.STATUSES, S.TOTALS))


@query(
    "past_due_matrix",
    f"""WITH {_sql(CODES, S.BALANCE)}, v AS (SELECT bank, period, code, max(value) AS value FROM f GROUP BY ALL), named AS (SELECT bank, period, category, status, sum(value) AS value FROM v JOIN (VALUES {_CELLS}) c (category, status, code) USING (code) GROUP BY ALL),
whole AS (SELECT bank, period, status, value FROM v JOIN (VALUES {_TOTALS}) c (status, code) USING (code)),
rest AS (SELECT w.*, w.value - coalesce((SELECT sum(value) FROM named x WHERE x.bank = w.bank AND x.period = w.period AND x.status = w.status AND category <> 'agricultural'), 0) AS r FROM whole w),
each AS (SELECT DISTINCT v.bank, v.period, category, status FROM v, (VALUES {_ALL}) a (category, status))
SELECT bank, period, category, status, round(1000 * CASE category WHEN 'total' THEN r.value WHEN 'other' THEN CASE WHEN r >= 0 THEN r END ELSE n.value END, 4) AS value, CASE WHEN category IN ('total', 'other') THEN r >= 0 END AS tied
FROM each LEFT JOIN named n USING (bank, period, category, status) LEFT JOIN rest r USING (bank, period, status)""",
)
def past_due_matrix(t: Tables) -> DataFrame:
    return S.past_due(_reports(t, CODES, S.BALANCE)).withColumn("value", F.round("value", 4))


_L = ", ".join(f"1000 * max(value) FILTER (WHERE code = '{c}') AS {n}" for n, c in LINES.items())


@query(
    "capital_schedule",
    f"""WITH {_sql(list(LINES.values()), S.CAPITAL)}, v AS (SELECT bank, period, code, arg_min(value, j) AS value FROM f GROUP BY ALL), l AS (SELECT bank, period, {_L} FROM v GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN goodwill IS NOT NULL OR other_intangibles IS NOT NULL THEN -coalesce(goodwill, 0) - coalesce(other_intangibles, 0) END AS intangibles FROM l)
SELECT *, cet1 - coalesce(common, 0) - coalesce(retained, 0) - coalesce(aoci, 0) - coalesce(intangibles, 0) AS other_adjustments FROM d""",
)
def capital_schedule(t: Tables) -> DataFrame:
    return S.capital_lines(_reports(t, list(LINES.values()), S.CAPITAL), LINES, DERIVED, RESIDUALS)


@query(
    "itemised_expense",
    f"""WITH {_sql([*ITEMS.values(), *WRITTEN], ['NONE', *S.INCOME])}, named AS (SELECT * FROM f JOIN (VALUES {', '.join(f"('{c}', '{n}')" for n, c in ITEMS.items())}) c (code, line) USING (code) WHERE j = 1)
SELECT bank, period, line, line AS label, 1000 * value AS value FROM named UNION ALL SELECT bank, period, 'written_in', CASE WHEN bank % 2 = 0 THEN 'Own line ' || code ELSE 'Write-in ' || code END, 1000 * value FROM f WHERE j = 1 AND code IN ({', '.join(f"'{c}'" for c in WRITTEN)})""",
)
def itemised_expense(t: Tables) -> DataFrame:
    codes = [*ITEMS.values(), *WRITTEN]
    own = _reports(t, codes, ["NONE", *S.INCOME]).withColumn("mdrm", F.upper("mdrm"))
    r = t.orders.groupBy(F.col("o_custkey").alias("bank"), F.year("o_orderdate").alias("period")).agg(F.count("*").alias("n"))
    texts = r.withColumn("code", F.explode(F.array(*map(F.lit, WRITTEN)))).select(
        "bank", "period", F.concat(F.lit("TEXT"), "code").alias("mdrm"), F.lit("str").alias("data_type"), F.lit(None).cast("long").alias("int_data"), F.lit(None).cast("double").alias("float_data"),
        F.when(F.col("bank") % 2 == 0, F.concat(F.lit(" Own line "), "code")).otherwise("  ").alias("str_data"),
    )
    return S.itemised(own.unionByName(texts), ITEMS, WRITTEN).drop("place")

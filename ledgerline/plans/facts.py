"""Figures picked out of filed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import facts as P

from .base import SQL_FILINGS, Tables, query

AS_OF = "2001-09-01"
#: Facts that a filing states, as (name, condition, concept, unit, value, span): all over bank, qi, revenue, ytd and k = bank * 31 + qi * 17.
KINDS = [
    ("k % 5 <> 0", "Revenues", "USD", "revenue", "quarter"),
    ("true", "Revenues", "USD", "ytd", "year"),
    ("k % 7 = 0", "SalesRevenueNet", "USD", "ytd * 12", "year"),
    ("k % 3 <> 0", "Dividends", "USD/shares", "1 + k % 9 / 8e0", "quarter"),
    ("qi % 4 = 3 AND k % 2 = 0", "Dividends", "USD/shares", "4 + k % 9 / 8e0", "year"),
    ("true", "Assets", "USD", "revenue * 10", "instant"),
    ("k % 4 = 0", "PreferredStock", "USD", "CASE WHEN k % 8 = 0 THEN 0e0 ELSE revenue / 8 END", "instant"),
    ("k % 6 = 0", "PreferredStockOld", "USD", "revenue / 16", "instant"),
    ("bank % 3 = 0", "SharesOutstanding", "shares", "1000e0 + k % 50", "instant"),
    ("k % 4 = 1", "Revenues", "EUR", "revenue * 0.9e0", "quarter"),
    ("k % 9 = 2", "Revenues", "EUR", "ytd * 0.9e0", "year"),
    ("k % 6 = 5", "Assets", "EUR", "revenue * 9", "instant"),
    ("k % 11 < 3", "Dividends", "USD", "2e0 + k % 5", "quarter"),
]
PLACE = "CASE unit WHEN 'USD' THEN 0 WHEN 'USD/shares' THEN 1 WHEN 'shares' THEN 2 WHEN 'pure' THEN 3 END"
_ROWS = """SELECT bank AS cik, '{concept}' AS concept, '{unit}' AS unit, {start} AS start, q_end AS "end", {value} + d.late * 0.5e0 AS val,
  CASE WHEN k % 29 = 0 THEN '8-K' WHEN qi % 4 = 3 THEN '10-K' ELSE '10-Q' END AS form, CAST(q_end + INTERVAL (40 + d.late * 365) DAY AS DATE) AS filed
  FROM based, (SELECT unnest([0, 1]) AS late) d WHERE ({cond}) AND (d.late = 0 OR k % 10 = 1)"""
_START = {"quarter": "q_start", "year": "y_start", "instant": "CAST(NULL AS DATE)"}
SQL_FACTS = f"""{SQL_FILINGS}, based AS (SELECT *, bank * 31 + qi * 17 AS k, sum(revenue) OVER (PARTITION BY bank, qi // 4 ORDER BY qi) AS ytd, make_date(qi // 4, 1, 1) AS y_start, make_date(qi // 4, qi % 4 * 3 + 1, 1) AS q_start,
  last_day(make_date(qi // 4, qi % 4 * 3 + 3, 1)) AS q_end FROM filings),
facts AS ({" UNION ALL ".join(_ROWS.format(cond=c, concept=n, unit=u, value=v, start=_START[s]) for c, n, u, v, s in KINDS)}),
spans AS (SELECT cik, concept, start, "end", arg_max(val, {{'f': filed, 'u': -({PLACE}), 'v': val}}) AS val, max(filed) AS filed, date_diff('day', start, "end") AS days FROM facts
  WHERE form IN ('10-K', '10-Q') AND start IS NOT NULL AND unit IN ('USD', 'USD/shares', 'pure') GROUP BY ALL)"""


def _facts(t: Tables) -> DataFrame:
    """(cik, concept, unit, start, end, val, form, filed): what filings state, some of it again a year later."""
    from pyspark.sql import Window

    w = Window.partitionBy("bank", F.floor(F.col("qi") / 4)).orderBy("qi").rowsBetween(Window.unboundedPreceding, 0)
    year, month = F.floor(F.col("qi") / 4).cast("int"), (F.col("qi") % 4 * 3).cast("int")
    b = t.filings().withColumns({"k": F.expr("bank * 31 + qi * 17"), "ytd": F.sum("revenue").over(w), "y": F.make_date(year, F.lit(1), F.lit(1)), "q": F.make_date(year, month + 1, F.lit(1)), "end": F.last_day(F.make_date(year, month + 3, F.lit(1)))})
    start = {"quarter": F.col("q"), "year": F.col("y"), "instant": F.lit(None).cast("date")}
    each = F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("concept"), F.lit(u).alias("unit"), start[s].alias("start"), F.expr(v).cast("double").alias("val"))) for c, n, u, v, s in KINDS))
    late = F.when(F.col("k") % 10 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = b.select("bank", "qi", "k", "end", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f"), late.alias("late")).withColumn("late", F.explode("late"))
    form = F.when(F.col("k") % 29 == 0, "8-K").when(F.col("qi") % 4 == 3, "10-K").otherwise("10-Q")
    return rows.select(F.col("bank").alias("cik"), "f.concept", "f.unit", "f.start", "end", (F.col("f.val") + F.col("late") * 0.5).alias("val"), form.alias("form"), F.date_add("end", 40 + F.col("late") * 365).alias("filed"))


def _day():
    return F.lit(AS_OF).cast("date")


def r(*names: str, digits: int = 8):
    return [F.round(n, digits).alias(n) for n in names]


SQL_LATEST = f"""{SQL_FACTS}, latest AS (SELECT cik, concept, unit, CASE WHEN e >= DATE '{AS_OF}' - 365 * 3 THEN val END AS value, CASE WHEN e >= DATE '{AS_OF}' - 365 * 3 THEN e END AS "end"
  FROM (SELECT *, "end" AS e, row_number() OVER (PARTITION BY cik, concept ORDER BY {PLACE}, form NOT IN ('10-K', '10-Q'), "end" DESC, filed DESC, val DESC) AS k FROM facts WHERE unit <> 'EUR') WHERE k = 1)"""


@query("latest_value_stale_guard", f'WITH {SQL_LATEST} SELECT cik, concept, unit, round(value, 8) AS value, "end" FROM latest', dates=["end"])
def latest_value_stale_guard(t: Tables) -> DataFrame:
    return P.latest(_facts(t), _day()).select("cik", "concept", "unit", *r("value"), "end")


SQL_QUARTERS = """quarters AS (SELECT cik, concept, "end", coalesce(max(direct), max(step)) AS val, max(direct) IS NULL AS derived FROM (SELECT a.cik, a.concept, a."end", CASE WHEN a.days BETWEEN 80 AND 100 THEN a.val END AS direct,
  CASE WHEN a.days > 100 THEN a.val - b.val END AS step FROM d a LEFT JOIN d b ON a.cik = b.cik AND a.concept = b.concept AND a.start = b.start AND date_diff('day', b."end", a."end") BETWEEN 80 AND 100) GROUP BY ALL HAVING coalesce(max(direct), max(step)) IS NOT NULL)"""


@query("quarters_direct_or_derived", f'WITH {SQL_FACTS}, d AS (SELECT * FROM spans), {SQL_QUARTERS} SELECT cik, concept, "end", round(val, 8) AS val, derived FROM quarters', dates=["end"])
def quarters_direct_or_derived(t: Tables) -> DataFrame:
    return P.quarters(P.spans(_facts(t))).select("cik", "concept", "end", *r("val"), "derived")


@query(
    "ttm_with_annual_fallback",
    f"""WITH {SQL_FACTS}, d AS (SELECT * FROM spans WHERE "end" >= DATE '{AS_OF}' - 365 * 2), {SQL_QUARTERS},
l AS (SELECT *, row_number() OVER w AS k, date_diff('day', "end", lag("end") OVER w) AS gap FROM quarters WINDOW w AS (PARTITION BY cik, concept ORDER BY "end" DESC)),
f AS (SELECT cik, concept, CASE WHEN count(*) = 4 AND count(*) FILTER (WHERE gap BETWEEN 80 AND 100) = 3 THEN sum(val) END AS q FROM l WHERE k <= 4 GROUP BY 1, 2),
a AS (SELECT cik, concept, arg_max(val, {{'e': "end", 'f': filed, 'v': val}}) AS a FROM d WHERE days BETWEEN 350 AND 380 GROUP BY 1, 2)
SELECT coalesce(f.cik, a.cik) AS cik, coalesce(f.concept, a.concept) AS concept, round(coalesce(q, a), 8) AS value, CASE WHEN q IS NOT NULL THEN 'quarters' WHEN a IS NOT NULL THEN 'annual' END AS path
FROM f FULL JOIN a ON f.cik = a.cik AND f.concept = a.concept""",
)
def ttm_with_annual_fallback(t: Tables) -> DataFrame:
    return P.trailing_year(_facts(t), _day()).select("cik", "concept", *r("value"), "path")


@query(
    "ttm_dividend",
    f"""WITH {SQL_FACTS}, divs AS (SELECT cik, concept, start, "end", arg_max(val, {{'f': filed, 'u': unit = 'USD/shares', 'v': val}}) AS val, max(filed) AS filed, date_diff('day', start, "end") AS days FROM facts
  WHERE form IN ('10-K', '10-Q') AND start IS NOT NULL AND unit IN ('USD/shares', 'USD') AND concept = 'Dividends' GROUP BY ALL),
e AS (SELECT *, max("end") OVER (PARTITION BY cik) AS e, row_number() OVER (PARTITION BY cik, "end", days BETWEEN 80 AND 100 ORDER BY filed DESC, val DESC) AS k FROM divs),
g AS (SELECT cik, arg_max(val, {{'f': filed, 'v': val}}) FILTER (WHERE days BETWEEN 350 AND 380 AND date_diff('day', "end", e) <= 15) AS a, sum(val) FILTER (WHERE days BETWEEN 80 AND 100 AND date_diff('day', "end", e) < 370 AND k = 1) AS q,
  arg_max(val, {{'e': "end", 'f': filed, 'v': val}}) FILTER (WHERE days > 100) AS y FROM e WHERE date_diff('day', e, DATE '{AS_OF}') <= 400 GROUP BY 1)
SELECT cik, round(coalesce(a, q, y), 8) AS value, CASE WHEN a IS NOT NULL THEN 'annual' WHEN q IS NOT NULL THEN 'quarters' WHEN y IS NOT NULL THEN 'to date' END AS path FROM g""",
)
def ttm_dividend(t: Tables) -> DataFrame:
    return P.trailing_dividend(_facts(t).where("concept = 'Dividends'"), _day()).select("cik", *r("value"), "path")


SQL_SERIES = f"""{SQL_FACTS}, series AS (SELECT cik, concept, "end", arg_max(val, {{'f': filed, 'u': {PLACE}, 'v': val}}) AS val FROM facts WHERE form IN ('10-K', '10-Q') AND unit <> 'EUR' GROUP BY ALL)"""
LADDER = ["PreferredStockOld", "PreferredStock"]


@query("concept_series", f"""WITH {SQL_SERIES} SELECT cik, concept, "end", round(val, 8) AS val FROM series WHERE concept IN ('Assets', 'PreferredStock')""", dates=["end"])
def concept_series(t: Tables) -> DataFrame:
    return P.series(_facts(t).where("concept in ('Assets', 'PreferredStock')")).select("cik", "concept", "end", *r("val"))


@query(
    "concept_ladder_per_date",
    f"""WITH {SQL_SERIES} SELECT cik, "end", round(arg_min(val, p), 8) AS val, arg_min(concept, p) AS concept FROM (SELECT *, CASE concept WHEN 'PreferredStockOld' THEN 0 WHEN 'PreferredStock' THEN 1 END AS p FROM series) WHERE p IS NOT NULL AND val <> 0 GROUP BY 1, 2""",
    dates=["end"],
)
def concept_ladder_per_date(t: Tables) -> DataFrame:
    return P.merged_ladder(P.series(_facts(t)), LADDER).select("cik", "end", *r("val"), "concept")


@query(
    "fundamentals_ladder",
    f"""WITH {SQL_LATEST}, p AS (SELECT *, CASE concept WHEN 'SalesRevenueNet' THEN 0 WHEN 'Revenues' THEN 1 END AS a, CASE concept WHEN 'PreferredStockOld' THEN 0 WHEN 'PreferredStock' THEN 1 END AS b FROM latest)
SELECT cik, round(arg_min(value, a) FILTER (WHERE value IS NOT NULL), 8) AS revenue, arg_min(concept, a) FILTER (WHERE value IS NOT NULL) AS revenue_source,
  round(arg_min(value, b) FILTER (WHERE value IS NOT NULL), 8) AS preferred, arg_min(concept, b) FILTER (WHERE value IS NOT NULL) AS preferred_source FROM p GROUP BY 1""",
)
def fundamentals_ladder(t: Tables) -> DataFrame:
    f = P.first_of_ladder(P.latest(_facts(t), _day()), {"revenue": ["SalesRevenueNet", "Revenues"], "preferred": LADDER})
    return f.select("cik", *r("revenue"), "revenue_source", *r("preferred"), "preferred_source")


SQL_FISCAL = f"""{SQL_FACTS}, own AS (SELECT *, CAST(year("end" - 14) AS INTEGER) AS year, CAST(quarter("end" - 14) AS INTEGER) AS quarter, date_diff('day', start, "end") AS days FROM facts WHERE form IN ('10-K', '10-Q') AND unit = CASE concept WHEN 'Dividends' THEN 'USD/shares' ELSE 'USD' END),
fiscal AS (SELECT cik, concept, year, quarter, arg_max(val, {{'f': filed, 'v': val}}) FILTER (WHERE abs(date_diff('day', make_date(year, 1, 1), start)) <= 20) AS ytd,
  arg_max(val, {{'f': filed, 'v': val}}) FILTER (WHERE days BETWEEN 80 AND 100) AS direct, arg_max(val, {{'f': filed, 'v': val}}) FILTER (WHERE start IS NULL) AS instant FROM own GROUP BY ALL),
flows AS (SELECT *, CASE WHEN quarter = 1 THEN ytd WHEN lag(quarter) OVER w = quarter - 1 THEN ytd - lag(ytd) OVER w END AS step FROM fiscal WINDOW w AS (PARTITION BY cik, concept, year ORDER BY quarter))"""


@query(
    "fiscal_flows",
    f"""WITH {SQL_FISCAL} SELECT cik, year, quarter, round(ytd, 2) AS ytd, round(direct, 2) AS direct, round(coalesce(step, direct), 2) AS flow, round(CASE WHEN quarter = 4 THEN ytd END, 2) AS annual FROM flows WHERE concept = 'Revenues'""",
)
def fiscal_flows(t: Tables) -> DataFrame:
    return P.flows(P.fiscal(_facts(t), ["Revenues"])).select("cik", "year", "quarter", *r("ytd", "direct", "flow", "annual", digits=2))


@query("fiscal_direct_first", f"WITH {SQL_FISCAL} SELECT cik, year, quarter, round(coalesce(direct, step), 2) AS flow FROM flows WHERE concept = 'Dividends'")
def fiscal_direct_first(t: Tables) -> DataFrame:
    return P.flows(P.fiscal(_facts(t), ["Dividends"], ("USD/shares",)), "direct").select("cik", "year", "quarter", *r("flow", digits=2))


@query("fiscal_instants", f"WITH {SQL_FISCAL} SELECT cik, year, quarter, round(instant, 8) AS instant FROM fiscal WHERE concept = 'Assets'")
def fiscal_instants(t: Tables) -> DataFrame:
    return P.fiscal(_facts(t), ["Assets"]).select("cik", "year", "quarter", *r("instant"))


@query(
    "corrupt_scale",
    f"""WITH {SQL_FACTS}, p AS (SELECT cik, start, "end", max(CASE WHEN concept = 'Revenues' THEN abs(val) END) AS x, max(CASE WHEN concept = 'SalesRevenueNet' THEN abs(val) END) AS y FROM spans WHERE date_diff('day', "end", DATE '{AS_OF}') <= 460 GROUP BY ALL)
SELECT cik, bool_or(greatest(x, y) / least(x, y) >= 10) AS corrupt FROM p WHERE x > 0 AND y > 0 GROUP BY 1""",
)
def corrupt_scale(t: Tables) -> DataFrame:
    return P.corrupt_scale(_facts(t), "Revenues", "SalesRevenueNet", _day())


@query("preferred_presence", f"""WITH {SQL_LATEST}, p AS (SELECT *, CASE WHEN value IS NOT NULL THEN CASE concept WHEN 'PreferredStockOld' THEN 0 WHEN 'PreferredStock' THEN 1 END END AS p FROM latest)
SELECT cik, round(arg_min(value, p), 8) AS value, bool_or(p IS NOT NULL) AS resolved FROM p GROUP BY 1""")
def preferred_presence(t: Tables) -> DataFrame:
    return P.presence(P.latest(_facts(t), _day()), LADDER).select("cik", *r("value"), "resolved")


@query(
    "newest_filing_per_year",
    f"""WITH {SQL_FACTS}, y AS (SELECT *, CAST(year("end") AS INTEGER) AS year FROM facts WHERE concept = 'Dividends'), l AS (SELECT *, max(filed) OVER (PARTITION BY cik, year) AS f FROM y)
SELECT cik, year, count(DISTINCT val) AS n, round(min(val), 8) AS low, round(max(val), 8) AS high FROM l WHERE filed = f GROUP BY 1, 2""",
)
def newest_filing_per_year(t: Tables) -> DataFrame:
    y = P.by_year(_facts(t).where("concept = 'Dividends'"))
    return y.select("cik", "year", F.size("values").cast("long").alias("n"), F.round(F.array_min("values"), 8).alias("low"), F.round(F.array_max("values"), 8).alias("high"))

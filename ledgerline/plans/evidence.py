"""Claims about whole documents, proven or refused; a sentence with a figure stands in the midst of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import evidence as E

from .base import Tables, query

BOUNDS = {"nim": (0.5, 8.0, r"net interest margin"), "roa": (0.05, 4.0, r"return on assets")}
#: Claims of each document: key, period, added to the figure, quote, where it starts behind the adjusted margin, its length in the text.
CLAIMS = [
    ("nim", "cur", 0.0, "NET interest  margin - was {} percent", 9, 37), ("nim", "cur", 0.0, "interest margin was {} percent", 13, 33), ("nim", "prior", 0.25, "net interest margin was {} percent", 9, 37),
    ("roa", "cur", 0.0, "net interest margin was {} percent", 9, 37), ("nim", "cur", 90.0, "net interest margin was {} percent", 9, 37), ("nim", "cur", 0.0, "interest margin", 13, 15),
    ("tier", "cur", 0.0, "net interest margin was {} percent", 9, 37), ("nim", "yoy", 0.0, "net interest margin was not {} percent", None, None), ("nim", "prior", 0.0, "adjusted net interest margin was {} percent", 0, 46),
]
STATUSES = ["kept", "label", "number", "label", "range", "quote", "unknown", "absent", "variant"]


@query(
    "claims_judged",
    f"""WITH d AS (SELECT doc_id, CAST(floor(length(coalesce(text, '')) / 2) AS BIGINT) + CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 3 END AS at, doc_id % 300 / 100e0 + 1 AS v FROM documents),
c (claim, key, period, more, start, size, status) AS (VALUES {", ".join(f"({k}, '{a}', '{b}', {add}, {'NULL' if start is None else start}, {'NULL' if size is None else size}, '{STATUSES[k]}')" for k, (a, b, add, _, start, size) in enumerate(CLAIMS))})
SELECT doc_id, CAST(claim AS BIGINT) AS claim, key, period, round(v + more, 6) AS value, CAST(d.at + start AS INTEGER) AS start, size AS length, status FROM d, c""",
)
def claims_judged(t: Tables) -> DataFrame:
    v = F.col("doc_id") % 300 / 100.0 + 1
    shown = F.format_number(v, 2)
    d = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("body"), v.alias("v"), shown.alias("shown"))
    half = F.floor(F.length("body") / 2).cast("int")
    told = F.concat(F.when(F.col("doc_id") % 4 == 0, "\n\n ").otherwise(". "), F.lit("Adjusted net interest margin, was\t"), "shown", F.lit(" percent; "))
    d = d.withColumn("text", F.concat(F.left("body", half), told, F.substr("body", half + 1)))
    each = F.array(*(F.struct(F.lit(k).cast("long").alias("claim"), F.lit(a).alias("key"), F.lit(b).alias("period"), F.lit(add).alias("add"), F.lit(x).alias("x")) for k, (a, b, add, x, *_) in enumerate(CLAIMS)))
    claims = d.select("doc_id", "v", "shown", F.explode(each).alias("c")).select("doc_id", "c.claim", "c.key", "c.period", (F.col("v") + F.col("c.add")).alias("value"), F.replace(F.col("c.x"), F.lit("{}"), F.col("shown")).alias("quote"))
    return E.judged(d, claims, "doc_id", "text", BOUNDS).withColumn("value", F.round("value", 6))

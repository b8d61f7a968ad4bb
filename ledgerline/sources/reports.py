"""Records of public reports as tables: quarterly call reports and filed facts.

Reports arrive as JSON; schemas are given, never inferred, and cells that are no numbers
become null. Everything is an expression over the scan, so pruning reaches the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import number

FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
COMPANY_FACTS = f"struct<cik:long,entityName:string,facts:map<string,map<string,struct<label:string,units:map<string,array<{FACT}>>>>>>"


def coerced(df: DataFrame, date: str, texts: list[str]) -> DataFrame:
    """Call-report records: ``date`` from yyyyMMdd, ``texts`` as they are, every other column a number or null."""
    kept = {date: F.try_to_date(F.col(date), "yyyyMMdd")}
    return df.select(*(kept[c].alias(c) if c in kept else F.col(c) if c in texts else number(F.col(c)).alias(c) for c in df.columns))


def newest(df: DataFrame, key: str, value, date: str, n: int) -> DataFrame:
    """The newest n records of one entity; the filter reaches the scan, the sort keeps n rows a task."""
    return df.where(F.col(key) == value).orderBy(F.desc(date)).limit(n)


def newest_each(df: DataFrame, key: str, date: str, tie: str, n: int) -> DataFrame:
    """The newest n records of every entity; each task keeps n rows a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date), tie))
    return df.withColumn("_k", place).where(F.col("_k") <= n).drop("_k")


def quarter_of(df: DataFrame, date: str, quarter, keys: DataFrame | None = None, key: str = "cert") -> DataFrame:
    """One quarter's records, of all entities or those in a table of keys."""
    own = df.where(F.col(date) == quarter)
    return own if keys is None else own.join(keys.select(key).distinct(), key, "left_semi")


def facts(documents: DataFrame, column: str) -> DataFrame:
    """Company-facts documents (JSON text) as rows: cik, taxonomy, concept, unit, start, end, val, form, filed, fp, fy. Broken documents give none."""
    d = documents.select(F.from_json(column, COMPANY_FACTS).alias("d"))
    t = d.select("d.cik", F.explode("d.facts").alias("taxonomy", "c"))
    c = t.select("cik", "taxonomy", F.explode("c").alias("concept", "u"))
    u = c.select("cik", "taxonomy", "concept", F.explode("u.units").alias("unit", "f"))
    f = u.select("cik", "taxonomy", "concept", "unit", F.explode("f").alias("f"))
    day = lambda x: F.try_to_date(F.col(f"f.{x}"), "yyyy-MM-dd").alias(x)
    return f.select("cik", "taxonomy", "concept", "unit", day("start"), day("end"), "f.val", "f.form", day("filed"), "f.fp", "f.fy")


def dimensional(member_map: Column, axis: str) -> Column:
    """The member of a fact on an axis, null where it isn't broken down by it."""
    return F.try_element_at(member_map, F.lit(axis))

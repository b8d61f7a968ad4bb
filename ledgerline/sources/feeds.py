"""News feeds and delimited files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<title:string,link:string,guid:string,pubDate:string,description:string>"


def published(text: Column) -> Column:
    """RFC-822 or ISO times as UTC timestamps; others null."""
    bare = F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), "(GMT|UTC)$", "+0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text))


def items(df: DataFrame, column: str) -> DataFrame:
    """Feed items, one XML element a row, as columns title, link, guid, published_at, description."""
    x = df.select(*[c for c in df.columns if c != column], F.from_xml(F.col(column), ITEM).alias("x"))
    return x.select(*[c for c in df.columns if c != column], "x.title", "x.link", "x.guid", published(F.col("x.pubDate")).alias("published_at"), "x.description")


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of XML feed files under a path, read in parallel by element."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string, description string").load(path)


def delimited(spark: SparkSession, path: str, schema, separator: str = ",") -> DataFrame:
    """Delimited files with a header; rows that don't fit the schema give nulls, never a failure."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').csv(path)

"""Registration of queries, and the bank-shaped views of the tables they share.

Role of the tables: customers are banks, nations their states, regions census regions;
orders by quarter are quarterly filings; line items are facts, parts securities, suppliers
branches of banks in markets; events are the event store, with users as tickers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.numbers import exact_mean
from ledgerline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, and views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._folder, name)

    def filings(self) -> DataFrame:
        """Quarterly filings: bank, qi (quarters since year 0), revenue, filings."""
        d = F.col("o_orderdate")
        return self.orders.groupBy(F.col("o_custkey").alias("bank"), (F.year(d) * 4 + F.quarter(d) - 1).cast("long").alias("qi")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("filings")
        )

    def daily(self) -> DataFrame:
        """Daily level of each event type: series, d, v, n."""
        return self.events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("d")).agg(exact_mean(F.col("value")).alias("v"), F.count("*").alias("n"))

    def holdings(self) -> DataFrame:
        """Shares and value by issuer (part brand), quarter and holder (supplier)."""
        d = F.col("l_shipdate")
        return (
            self.lineitem.join(self.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias("issuer"), F.col("l_suppkey").alias("holder"), (F.year(d) * 4 + F.quarter(d) - 1).cast("long").alias("qi"))
            .agg(F.sum("l_quantity").alias("shares"), F.round(F.sum("l_extendedprice"), 2).alias("value_usd"))
        )

    def branch_deposits(self) -> DataFrame:
        """Deposits by market (nation) and bank (supplier)."""
        return (
            self.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("deposits"))
            .join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("s_nationkey").alias("market"), F.col("s_suppkey").alias("bank"), "deposits")
        )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks by key, before work that costs much a row: a small file is a split or two, however long its rows take."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


SQL_FILINGS = """filings AS (SELECT o_custkey AS bank, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS qi,
  round(sum(o_totalprice), 2) AS revenue, count(*) AS filings FROM orders GROUP BY 1, 2)"""
SQL_DAILY = """daily AS (SELECT event_type AS series, CAST(ts AS DATE) AS d, CAST(sum(CAST(value AS DECIMAL(28, 4))) AS DOUBLE) / count(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)"""
SQL_HOLDINGS = """holdings AS (SELECT p_brand AS issuer, l_suppkey AS holder, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS BIGINT) AS qi,
  sum(l_quantity) AS shares, round(sum(l_extendedprice), 2) AS value_usd FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
SQL_BRANCHES = """branch_deposits AS (SELECT s_nationkey AS market, s_suppkey AS bank, d AS deposits
  FROM (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS d FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey)"""


def query(name: str, sql: str | None = None, dates: list[str] | None = None):
    """Registers a function of the tables under a name, with its SQL. Columns named in ``dates`` are given as text, year first."""

    def add(f: Callable[[Tables], DataFrame]):
        assert name not in QUERIES
        if dates:
            QUERIES[name] = lambda spark, folder: f(Tables(spark, folder)).withColumns({c: F.col(c).cast("string") for c in dates})
        else:
            QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            text = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in dates or [])
            ORACLES[name] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add

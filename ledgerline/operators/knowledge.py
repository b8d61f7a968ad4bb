"""What was known of a period on a day: as-of over two axes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_grid(facts: DataFrame, key: str, period: str, filed: str, values: list[str], days: list[str], first: str, last: str, max_age: int | None = None) -> DataFrame:
    """For each key, day of knowledge and quarter end from ``first`` to ``last``: the newest period at or before it that was known that day: key, known_on, quarter, period, filed, values.

    Of a period the newest filing by that day counts (ties: larger values), so a restatement
    takes effect on its day and never before; a filing whose values are all null retracts
    the period, and an older period answers. Periods over ``max_age`` days before the
    quarter's end don't. What nothing answers has no row.

    One shuffle, by key: filings of a period are folded per day where the key is, each
    known period holds for the quarters up to the next, and only those are made.
    """
    day = F.explode(F.array(*(F.to_date(F.lit(d)) for d in days)))
    rows = facts.where(F.col(key).isNotNull() & F.col(period).isNotNull() & F.col(filed).isNotNull()).repartition(key).withColumn("known_on", day).where(F.col(filed) <= F.col("known_on"))
    newest = rows.groupBy(key, "known_on", period).agg(F.max(F.struct(filed, *values)).alias("_b"))
    some = F.coalesce(*(F.col(f"_b.{v}").cast("string") for v in values)).isNotNull()
    held = newest.where(some).withColumn("_next", F.lead(period).over(Window.partitionBy(key, "known_on").orderBy(period)))
    # quarters are counted from year 0: the first not before the period, the last before the next one
    ceiling = lambda d: F.year(d) * 4 + F.quarter(d) - 1 + F.when(F.last_day(F.add_months(F.trunc(d, "quarter"), 2)) < d, 1).otherwise(0)
    floor = lambda d: F.year(d) * 4 + F.quarter(d) - 1 - F.when(F.last_day(F.add_months(F.trunc(d, "quarter"), 2)) > d, 1).otherwise(0)
    a, b = ceiling(F.to_date(F.lit(first))), floor(F.to_date(F.lit(last)))
    start = F.greatest(ceiling(F.col(period)), a)
    stop = F.least(F.coalesce(ceiling(F.col("_next")) - 1, b), b)
    out = held.withColumn("_q", F.explode(F.when(start <= stop, F.sequence(start, stop))))
    quarter: Column = F.last_day(F.make_date(F.floor(F.col("_q") / 4).cast("int"), (F.col("_q") % 4 * 3 + 3).cast("int"), F.lit(1)))
    out = out.withColumn("quarter", quarter)
    if max_age is not None:
        out = out.where(F.datediff("quarter", period) <= max_age)
    return out.select(key, "known_on", "quarter", period, F.col(f"_b.{filed}").alias(filed), *(F.col(f"_b.{v}").alias(v) for v in values))


def per_share(amounts: DataFrame, shares: DataFrame, key: str, amount: str, count: str) -> DataFrame:
    """Two grids of one key, day and quarter as a figure per share: key, known_on, quarter, value; null without both, or without shares."""
    on = [key, "known_on", "quarter"]
    both = amounts.select(*on, amount).join(shares.select(*on, count), on, "full")
    return both.select(*on, F.when(F.col(count) > 0, F.col(amount) / F.col(count)).alias("value"))


def revisions(grid: DataFrame, key: str, value: str) -> DataFrame:
    """How a quarter's figure changed from one day of knowledge to the next: the grid's rows with ``before`` and ``revised``; the first day's aren't revised."""
    w = Window.partitionBy(key, "quarter").orderBy("known_on")
    before = F.lag(value).over(w)
    return grid.withColumn("before", before).withColumn("revised", F.coalesce(F.lag(F.lit(1)).over(w) == 1, F.lit(False)) & ~before.eqNullSafe(F.col(value)))

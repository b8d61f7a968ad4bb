"""Holders of an issuer: turnover, concentration, matrices and common holdings. Tables have (issuer, holder, qi, shares, value_usd)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_two(df: DataFrame) -> DataFrame:
    """Rows of each issuer's two newest quarters, with ``age`` 1 for the newest."""
    w = Window.partitionBy("issuer").orderBy(F.desc("qi"))
    return df.withColumn("age", F.dense_rank().over(w)).where("age <= 2")


def classify(now: Column, before: Column) -> Column:
    """New, Exited, Unchanged (within 0.5 percent), Added or Trimmed."""
    move = (now - before) / before
    return (
        F.when(before.isNull() | (before == 0), "New").when(now.isNull() | (now == 0), "Exited")
        .when(F.abs(move) < 0.005, "Unchanged").when(move > 0, "Added").otherwise("Trimmed")
    )


def moves(df: DataFrame) -> DataFrame:
    """issuer, holder, now, before, move: the two newest quarters side by side, one grouping in place of a full join."""
    held = lambda age: F.sum(F.when(F.col("age") == age, F.col("shares")))
    out = latest_two(df).groupBy("issuer", "holder").agg(held(1).alias("now"), held(2).alias("before"))
    return out.withColumn("move", classify(F.col("now"), F.col("before")))


def turnover(df: DataFrame) -> DataFrame:
    """issuer, holder, quarters, turnover, category: mean change between stored quarters against the mean position, in percent.

    Null below two quarters or without a positive mean. The category is the quartile
    (exclusive, as p * (n + 1) places it) among the issuer's holders; null where fewer
    than two have a turnover.
    """
    w = Window.partitionBy("issuer", "holder").orderBy("qi")
    step = df.where("shares is not null").withColumn("_m", F.abs(F.col("shares") - F.lag("shares").over(w)))
    rate = (F.sum("_m") / F.count("_m")) / (F.sum("shares") / F.count("*")) * 100
    out = step.groupBy("issuer", "holder").agg(F.count("*").alias("quarters"), F.when((F.count("*") >= 2) & (F.sum("shares") > 0), rate).alias("turnover"))
    place = F.row_number().over(Window.partitionBy("issuer").orderBy("turnover"))
    known = out.where("turnover is not null").select("issuer", "turnover", place.alias("_k"))
    n = known.groupBy("issuer").agg(F.count("*").alias("_n")).where("_n >= 2")
    cuts = {i: F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.lit(i) * (F.col("_n") + 1) / 4))) for i in (1, 2, 3)}

    def quartile(i: int) -> Column:
        low, high = (F.max(F.when(F.col("_k") == cuts[i] + d, F.col("turnover"))) for d in (0, 1))
        over = F.lit(i) * (F.max("_n") + 1) - F.max(cuts[i]) * 4
        return (low * (4 - over) + high * over) / 4

    q = known.join(n, "issuer").groupBy("issuer").agg(*(quartile(i).alias(f"_q{i}") for i in (1, 2, 3)))
    t = F.col("turnover")
    category = F.when(t <= F.col("_q1"), "Very Low").when(t <= F.col("_q2"), "Low").when(t <= F.col("_q3"), "Moderate").when(t > F.col("_q3"), "High")
    return out.join(q, "issuer", "left").select("issuer", "holder", "quarters", "turnover", category.alias("category"))


def concentration(df: DataFrame) -> DataFrame:
    """issuer, n, total, top5, top10 (percent of shares), hhi over each issuer's newest quarter."""
    w = Window.partitionBy("issuer")
    new = df.withColumn("_q", F.max("qi").over(w)).where("qi = _q and shares > 0")
    rank = F.row_number().over(w.orderBy(F.desc("shares"), "holder"))
    top = lambda n: F.sum(F.when(F.col("_r") <= n, F.col("shares"))) / F.sum("shares") * 100
    return new.withColumn("_r", rank).groupBy("issuer").agg(
        F.count("*").alias("n"), F.sum("shares").alias("total"), top(5).alias("top5"), top(10).alias("top10"),
        (F.sum(F.col("shares") * F.col("shares")) / (F.sum("shares") * F.sum("shares")) * 10000).alias("hhi"),
    )


def common_holders(df: DataFrame, subject: str, least: int = 2) -> DataFrame:
    """Other issuers that share holders with the subject: other, shared, largest (holder of most value there); joined on holder, not pairwise over issuers."""
    own = df.where(F.col("issuer") == subject).select("holder").distinct()
    return (
        df.where(F.col("issuer") != subject).join(own, "holder", "left_semi").groupBy(F.col("issuer").alias("other"), "holder").agg(F.sum("value_usd").alias("v"))
        .groupBy("other").agg(F.count("*").alias("shared"), F.max_by("holder", F.struct("v", "holder")).alias("largest")).where(F.col("shared") >= least)
    )


def harmonic(df: DataFrame, key: str, weight: str, x: str, low: float, high: float) -> DataFrame:
    """Weighted harmonic mean of x over holdings with x within (low, high]: key, blend, n."""
    fine = (F.col(x) > low) & (F.col(x) <= high)
    w = F.when(fine, F.col(weight))
    total = F.sum(w / F.col(x))
    return df.groupBy(key).agg(F.when(total > 0, F.sum(w) / total).alias("blend"), F.count(w).alias("n"))

"""Market shares, concentration and merger screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import hhi_band, merger_flag


def shares(df: DataFrame) -> DataFrame:
    """(market, bank, deposits), one row per bank and market, with share in percent and rank; markets without deposits have null shares."""
    w = Window.partitionBy("market")
    total = F.sum("deposits").over(w)
    rank = F.rank().over(w.orderBy(F.desc("deposits")))
    return df.withColumn("share", F.when(total > 0, F.col("deposits") / total * 100)).withColumn("rank", rank)


def hhi(df: DataFrame) -> DataFrame:
    """market, n, total, hhi, band; hhi is null where any deposit is or none is positive. Two keyed sums, no window."""
    out = df.groupBy("market").agg(
        F.count("*").alias("n"), F.count("deposits").alias("_k"), F.sum("deposits").alias("total"), F.sum(F.col("deposits") * F.col("deposits")).alias("_q")
    )
    value = F.when((F.col("_k") == F.col("n")) & (F.col("total") > 0), F.col("_q") / (F.col("total") * F.col("total")) * 10000)
    return out.select("market", "n", "total", value.alias("hhi")).withColumn("band", hhi_band(F.col("hhi")))


def pro_forma(df: DataFrame, a: int, b: int) -> DataFrame:
    """Markets where both banks hold positive deposits: share_a, share_b, pre, post, delta, flagged. post = pre + 2ab in share points."""
    held = lambda k: F.sum(F.when(F.col("bank") == k, F.col("deposits")))
    m = df.groupBy("market").agg(
        F.sum("deposits").alias("_t"), F.sum(F.col("deposits") * F.col("deposits")).alias("_q"), held(a).alias("_a"), held(b).alias("_b")
    ).where("_a > 0 and _b > 0")
    m = m.select("market", (F.col("_a") / F.col("_t") * 100).alias("share_a"), (F.col("_b") / F.col("_t") * 100).alias("share_b"), (F.col("_q") / F.col("_t") / F.col("_t") * 10000).alias("pre"))
    m = m.withColumn("delta", 2 * F.col("share_a") * F.col("share_b")).withColumn("post", F.col("pre") + F.col("delta"))
    return m.withColumn("flagged", merger_flag(F.col("post"), F.col("delta")))


def participants(df: DataFrame, subject: int) -> DataFrame:
    """All banks of the markets where the subject operates."""
    own = df.where(F.col("bank") == subject).select("market").distinct()
    return df.join(own, "market", "left_semi")


def overlap(df: DataFrame, a: int, b: int) -> DataFrame:
    """Markets that hold both banks, with both deposits and their sum."""
    one = df.where(F.col("bank") == a).groupBy("market").agg(F.sum("deposits").alias("deposits_a"))
    two = df.where(F.col("bank") == b).groupBy("market").agg(F.sum("deposits").alias("deposits_b"))
    return one.join(two, "market").withColumn("combined", F.col("deposits_a") + F.col("deposits_b"))


def competitors(df: DataFrame) -> DataFrame:
    """(market, bank, deposits, share) with the largest other bank of the market and its share: the market's first, or for itself the second."""
    w = Window.partitionBy("market").orderBy(F.desc("deposits"), "bank")
    top = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("market").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("bank", "share"))).alias("_1"), F.max(F.when(F.col("_r") == 2, F.struct("bank", "share"))).alias("_2")
    )
    j = df.join(top, "market")
    other = F.when(F.col("_1.bank") == F.col("bank"), F.col("_2")).otherwise(F.col("_1"))
    return j.withColumn("_o", other).select(*df.columns, F.col("_o.bank").alias("top_competitor"), F.col("_o.share").alias("top_share"))


def skipped(df: DataFrame, a: int, b: int) -> DataFrame:
    """Markets where both banks are but one has no deposits, which the merger screen leaves out: market, reason."""
    held = lambda k: F.sum(F.when(F.col("bank") == k, F.coalesce("deposits", F.lit(0.0))))
    m = df.groupBy("market").agg(held(a).alias("_a"), held(b).alias("_b")).where("_a is not null and _b is not null and (_a <= 0 or _b <= 0)")
    return m.select("market", F.lit("zero deposits").alias("reason"))

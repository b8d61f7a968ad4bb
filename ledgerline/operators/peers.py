"""Percentiles and ranks within a scope.

All are windows partitioned by scope, so that scopes run side by side; missing values get
null and don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hazen(scope: list, value: str) -> Column:
    """(values below + half of the equal ones) / n * 100."""
    known = [*scope, F.col(value).isNull()]
    rank = F.rank().over(Window.partitionBy(*known).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*known, value))
    return F.when(F.col(value).isNotNull(), (rank - 1 + 0.5 * ties) / F.count(value).over(Window.partitionBy(*scope)) * 100)


def average_rank(scope: list, value: str, higher_better: bool = True) -> Column:
    """Average rank / n * 100 in the metric's direction; null with fewer than two values."""
    known = [*scope, F.col(value).isNull()]
    order = F.col(value).asc() if higher_better else F.col(value).desc()
    rank = F.rank().over(Window.partitionBy(*known).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*known, value))
    n = F.count(value).over(Window.partitionBy(*scope))
    return F.when(F.col(value).isNotNull() & (n >= 2), (rank + (ties - 1) / 2) / n * 100)


def context(df: DataFrame, scope: list[str], value: str, least: int = 5, higher_better: bool = True) -> DataFrame:
    """Adds percentile, goodness, median, min_rank and n of a value in its scope; null below ``least`` values."""
    every = Window.partitionBy(*scope)
    n = F.count(value).over(every)
    order = F.col(value).desc() if higher_better else F.col(value).asc()
    rank = F.rank().over(Window.partitionBy(*scope, F.col(value).isNull()).orderBy(order))
    gate = (n >= least) & F.col(value).isNotNull()
    pct = hazen(scope, value)
    return (
        df.withColumn("n", n)
        .withColumn("percentile", F.when(gate, pct))
        .withColumn("goodness", F.when(gate, pct if higher_better else 100 - pct))
        .withColumn("median", F.when(gate, F.median(value).over(every)))
        .withColumn("min_rank", F.when(gate, rank))
    )


def composite(df: DataFrame, key: str, scope: list[str], metrics: dict[str, bool]) -> DataFrame:
    """Mean percentile in the metrics' directions: key, scope, score, n_metrics, n_top (>= 80), n_bottom (< 20)."""
    pct = df.select(key, *scope, *(F.when(F.col(m).isNotNull(), hazen(scope, m) if up else 100 - hazen(scope, m)).alias(m) for m, up in metrics.items()))
    known = F.filter(F.array(*metrics), lambda x: x.isNotNull())
    out = pct.withColumn("_p", known)
    mean = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) / F.size("_p")
    return out.select(
        key, *scope, F.when(F.size("_p") > 0, mean).alias("score"), F.size("_p").alias("n_metrics"),
        F.size(F.filter("_p", lambda x: x >= 80)).alias("n_top"), F.size(F.filter("_p", lambda x: x < 20)).alias("n_bottom"),
    )


def nearest(df: DataFrame, scope: list[str], key: str, size: str, n: int = 5) -> DataFrame:
    """For each row the n others of its scope with the nearest size: scope, key, peer, distance, rank; ties by peer.

    The n nearest are among those of the same size and of the n next sizes each way, of
    each size the n + 1 smallest keys; rows of one size are looked up together, so no
    pairs of a scope are formed. Give sizes as decimals where distances should tie exactly.
    """
    known = df.where(F.col(size).isNotNull())
    place = F.row_number().over(Window.partitionBy(*scope, size).orderBy(key))
    few = known.select(*scope, size, key, place.alias("_k")).where(F.col("_k") <= n + 1)
    sizes = few.groupBy(*scope, size).agg(F.struct(F.col(size).alias("s"), F.sort_array(F.collect_list(key)).alias("keys")).alias("_g"))
    w = Window.partitionBy(*scope).orderBy(size)
    near = sizes.select(*scope, size, F.concat(F.collect_list("_g").over(w.rowsBetween(-n, 0)), F.collect_list("_g").over(w.rowsBetween(1, n))).alias("_near"))
    near = near.select(*scope, size, F.explode("_near").alias("_g")).select(*scope, size, F.abs(F.col(size) - F.col("_g.s")).alias("distance"), F.explode("_g.keys").alias("peer"))
    best = F.row_number().over(Window.partitionBy(*scope, size).orderBy("distance", "peer"))
    near = near.withColumn("_k", best).where(F.col("_k") <= n + 1).drop("_k")
    rank = F.row_number().over(Window.partitionBy(*scope, key).orderBy("distance", "peer"))
    pairs = known.select(*scope, size, key).join(near, [*scope, size]).where(F.col(key) != F.col("peer"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n).select(*scope, key, "peer", "distance", "rank")

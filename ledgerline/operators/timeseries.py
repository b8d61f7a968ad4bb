"""Quarterly and daily series: gaps, year-to-date flows, trailing windows, fills and runs.

Every operator is a window per entity (one shuffle by key, which operators over the same
key share); rows before the needed history, or across a gap, give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(key: str | list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def consecutive(w: WindowSpec, order: str, n: int) -> Column:
    """Whether the n rows up to this one are n consecutive periods."""
    return F.col(order) - F.lag(order, n - 1).over(w) == n - 1


def change(df: DataFrame, key, order: str, value: str, periods: int = 1) -> DataFrame:
    """Adds ``change``: the difference to the row ``periods`` back, null unless it lies exactly that many periods back."""
    w = by(key, order)
    gap = F.col(order) - F.lag(order, periods).over(w)
    return df.withColumn("change", F.when(gap == periods, F.col(value) - F.lag(value, periods).over(w)))


def year_to_date(df: DataFrame, key, order: str, value: str) -> DataFrame:
    """Adds ``ytd``: the running sum within the year of a quarter index."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key), F.floor(F.col(order) / 4)).orderBy(order)
    return df.withColumn("ytd", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def decumulated(df: DataFrame, key, order: str, ytd: str) -> DataFrame:
    """Adds ``flow``: the quarter's own flow from year-to-date values. First quarters are their own; others need the quarter before."""
    w = by(key, order)
    own = F.when(F.col(order) % 4 == 0, F.col(ytd)).when(F.lag(order).over(w) == F.col(order) - 1, F.col(ytd) - F.lag(ytd).over(w))
    return df.withColumn("flow", own)


def full_window_sum(df: DataFrame, key, order: str, value: str, n: int = 4, name: str = "ttm") -> DataFrame:
    """Adds the sum of n consecutive known values; a partial window is never summed."""
    w = by(key, order)
    rows = w.rowsBetween(1 - n, 0)
    return df.withColumn(name, F.when(consecutive(w, order, n) & (F.count(value).over(rows) == n), F.sum(value).over(rows)))


def scaled_window_sum(df: DataFrame, key, order: str, value: str, n: int = 4, least: int = 2) -> DataFrame:
    """Adds ``ttm_scaled``: the known values of the last n periods, scaled up to n; null below ``least``."""
    rows = Window.partitionBy(key).orderBy(order).rangeBetween(1 - n, 0)
    known = F.count(value).over(rows)
    return df.withColumn("ttm_scaled", F.when(known >= least, F.sum(value).over(rows) * n / known))


def filled(df: DataFrame, key, order: str, value: str) -> DataFrame:
    """Adds ``filled`` and ``origin``: the last known value and when it was known."""
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(order).alias("o"))), True)
    seen = last.over(by(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_seen", seen).withColumn("filled", F.col("_seen.v")).withColumn("origin", F.col("_seen.o")).drop("_seen")


def winsorised_factor(df: DataFrame, key, order: str, value: str, cap: float = 3.0) -> DataFrame:
    """Adds ``factor``: the last four values capped at ``cap`` times the median of eight, against the same uncapped, within 0.2 and 1."""
    w = by(key, order)
    eight = F.sort_array(F.collect_list(value).over(w.rowsBetween(-7, 0)))
    four = F.collect_list(value).over(w.rowsBetween(-3, 0))
    out = df.withColumn("_8", eight).withColumn("_4", four)
    n = F.size("_8")
    mid = (F.get("_8", F.floor((n - 1) / 2).cast("int")) + F.get("_8", F.floor(n / 2).cast("int"))) / 2
    out = out.withColumn("_cap", F.lit(cap) * mid)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    capped = F.aggregate("_4", F.lit(0.0), lambda a, x: a + F.least(x, F.col("_cap")))
    factor = F.when((F.size("_4") == 4) & (total("_4") > 0), F.greatest(F.lit(0.2), F.least(F.lit(1.0), capped / total(F.col("_4")))))
    return out.withColumn("factor", factor).drop("_8", "_4", "_cap")


def rolling_slope(df: DataFrame, key, order: str, y: str, x: str, n: int = 4, least: int = 3) -> DataFrame:
    """Adds ``slope`` and ``r2`` of y on x over the last n rows with both, null below ``least`` or without variance."""
    rows = by(key, order).rowsBetween(1 - n, 0)
    both = F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).over(rows)
    wide = F.var_pop(F.when(F.col(y).isNotNull(), F.col(x))).over(rows) > 1e-12
    fine = (both >= least) & wide
    return df.withColumn("slope", F.when(fine, F.regr_slope(y, x).over(rows))).withColumn("r2", F.when(fine, F.regr_r2(y, x).over(rows)))


def zscore(df: DataFrame, key, order: str, value: str, days: int, least: int = 12) -> DataFrame:
    """Adds ``z``: distance from the mean of the last ``days`` days in sample deviations; over all days so far where those hold fewer than ``least`` values, null where all do."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.unix_date(order))
    near, far = w.rangeBetween(-days, 0), w.rangeBetween(Window.unboundedPreceding, 0)
    enough = F.count(value).over(near) >= least
    pick = lambda f: F.when(enough, f(value).over(near)).when(F.count(value).over(far) >= least, f(value).over(far))
    return df.withColumn("_m", pick(F.avg)).withColumn("_s", pick(F.stddev_samp)).withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def runs(df: DataFrame, key, order: str, flag: str) -> DataFrame:
    """Runs of rows where ``flag`` holds: key, run_start, run_end, length."""
    keys = [key] if isinstance(key, str) else key
    w = by(key, order)
    starts = (F.col(flag) != F.coalesce(F.lag(flag).over(w), ~F.col(flag))).cast("int")
    marked = df.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(flag).groupBy(*keys, "_run").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("length")).drop("_run")


def cycle_beta(df: DataFrame, key, order: str, value: str, rate: str, noise: float = 0.03, least: float = 0.15) -> DataFrame:
    """The present one-way cycle of ``rate``: key, cycle_start, cycle_end, rows, rate_change, value_change, direction, beta.

    The last move beyond ``noise`` gives the direction; the cycle runs from the last move
    the other way (else the first row) to the last row. Keys whose rate changed by less
    than ``least``, or never moved, give none. Rows without rate or value don't count. One
    window and one grouping.
    """
    w = by(key, order)
    known = df.where(F.col(rate).isNotNull() & F.col(value).isNotNull())
    move = F.col(rate) - F.lag(rate).over(w)
    rows = known.select(key, order, F.struct(F.col(order).alias("at"), F.col(value).alias("v"), F.col(rate).alias("r"), F.row_number().over(w).alias("k")).alias("_x"), F.when(move > noise, 1).when(move < -noise, -1).alias("_d"))
    last = lambda d: F.max_by("_x", F.when(F.col("_d") == d, F.col(order)))
    ends = rows.groupBy(key).agg(F.min_by("_x", order).alias("_a"), F.max_by("_x", order).alias("_z"), last(1).alias("_up"), last(-1).alias("_down"), F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col(order))).alias("_d"))
    ends = ends.withColumn("_s", F.coalesce(F.when(F.col("_d") == 1, F.col("_down")).otherwise(F.col("_up")), F.col("_a")))
    change = F.col("_z.r") - F.col("_s.r")
    return ends.where(F.col("_d").isNotNull() & (F.col("_z.k") > F.col("_s.k")) & (F.abs(change) >= least)).select(
        key, F.col("_s.at").alias("cycle_start"), F.col("_z.at").alias("cycle_end"), (F.col("_z.k") - F.col("_s.k") + 1).cast("long").alias("rows"), change.alias("rate_change"),
        (F.col("_z.v") - F.col("_s.v")).alias("value_change"), F.when(F.col("_d") == 1, "up").otherwise("down").alias("direction"), ((F.col("_z.v") - F.col("_s.v")) / change).alias("beta"),
    )


def year_on_year(df: DataFrame, key, order: str, value: str, n: int = 4) -> DataFrame:
    """Adds ``growth_pct``: the last n rows' sum against that of the n rows before, whatever gaps lie between; null unless all are known and no sum is zero."""
    w = by(key, order)

    def total(a: int, b: int) -> Column:
        rows = w.rowsBetween(a, b)
        return F.when(F.count(value).over(rows) == n, F.nullif(F.sum(value).over(rows), F.lit(0.0)))

    return df.withColumn("growth_pct", (total(1 - n, 0) / total(1 - 2 * n, -n) - 1) * 100)


def anchors(df: DataFrame, key, order: str, value: str, n: int) -> DataFrame:
    """Adds the values 1, 5 and 21 rows back and the lowest and highest of the last n rows."""
    w = by(key, order)
    for k in (1, 5, 21):
        df = df.withColumn(f"back_{k}", F.lag(value, k).over(w))
    rows = w.rowsBetween(1 - n, 0)
    return df.withColumn("low", F.min(value).over(rows)).withColumn("high", F.max(value).over(rows))


def relative_volume(df: DataFrame, key, order: str, volume: str, spans: list[int], base: int) -> DataFrame:
    """Adds ``rv_<n>`` for each span: mean volume over n rows against ``base`` rows; each needs half its window."""
    w = by(key, order)

    def mean(n: int) -> Column:
        rows = w.rowsBetween(1 - n, 0)
        return F.when(F.count(volume).over(rows) >= n / 2, F.avg(volume).over(rows))

    for n in spans:
        df = df.withColumn(f"rv_{n}", F.when(mean(base) > 0, mean(n) / mean(base)))
    return df


def stats(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """First, last, lowest, highest and return in percent of each key."""
    out = df.groupBy(*key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.withColumn("return_pct", F.when(F.col("first") != 0, (F.col("last") / F.col("first") - 1) * 100))


def last_move(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The newest step of a level that mostly holds: key, direction (hike, cut, hold), bps (of percent), moved (its date; null on hold)."""
    step = df.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(by(key, order)))
    at = F.when(F.col("_d") != 0, F.col(order))
    last = step.groupBy(key).agg(F.max_by("_d", at).alias("_d"), F.max(at).alias("moved"))
    return last.select(key, F.when(F.col("_d") > 0, "hike").when(F.col("_d") < 0, "cut").otherwise("hold").alias("direction"), F.coalesce(F.round(F.col("_d") * 100), F.lit(0.0)).cast("long").alias("bps"), "moved")


def trend(df: DataFrame, key: str, order: str, value: str, n: int = 30, least: float = 0.05) -> DataFrame:
    """key, trend: up, down or flat from the first to the last of the newest n known values."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    near = df.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    change = F.max_by(value, order) - F.min_by(value, order)
    return near.groupBy(key).agg(F.when(change > least, "up").when(change < -least, "down").otherwise("flat").alias("trend"))


def zscore_latest(df: DataFrame, key: str, order: str, value: str, days: int, least: int = 12) -> DataFrame:
    """key, z of each key's newest value against its last ``days`` days, or all its history where those hold fewer than ``least`` values; null where all do, or without spread."""
    known = df.where(F.col(value).isNotNull()).withColumn("_last", F.max(order).over(Window.partitionBy(key)))
    x, near = F.col(value), F.when(F.datediff("_last", order) <= days, F.col(value))
    g = known.groupBy(key).agg(F.max_by(value, order).alias("_v"), F.count(near).alias("_k"), F.avg(near).alias("_m1"), F.stddev_samp(near).alias("_s1"), F.count(x).alias("_n"), F.avg(x).alias("_m2"), F.stddev_samp(x).alias("_s2"))
    z = lambda m, s: F.when(F.col(s) > 0, (F.col("_v") - F.col(m)) / F.col(s))
    return g.select(key, F.when(F.col("_k") >= least, z("_m1", "_s1")).when(F.col("_n") >= least, z("_m2", "_s2")).alias("z"))

"""Quarterly timelines of banks with their alerts: credit, deposits, capital and capital returns.

Timelines are windows per bank, one shuffle that all measures share; alerts come from the
newest rows of each bank, as one row per alert (key, code, severity, value). Credit and
deposit changes are to the row before, whatever its quarter; capital changes only to the
quarter before. What is unknown gives null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import by, decumulated, full_window_sum

# The regulatory minimum and the buffer's floor of the core capital ratio, in percent.
CET1_MINIMUM, CET1_BUFFER = 7.0, 8.0


def share(part: Column, whole: Column) -> Column:
    """Percent of a whole; a zero part is data, a missing or zero whole gives null."""
    return F.when(whole != 0, part / whole * 100)


def newest(df: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """Adds ``age``, 1 for each key's newest row, and keeps ages to n."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def newest_values(df: DataFrame, key: str, order: str, value: str, n: int, name: str) -> DataFrame:
    """key and the array of each key's n newest known values, newest first."""
    few = newest(df.where(F.col(value).isNotNull()).select(key, order, value), key, order, n)
    return few.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("age", value))), lambda x: x[value]).alias(name))


def falling(values: Column, n: int) -> Column:
    """Whether n values, newest first, each lie below the one before them in time."""
    steps = [F.get(values, k) < F.get(values, k + 1) for k in range(n - 1)]
    out = F.size(values) >= n
    for s in steps:
        out = out & s
    return out


def alerts(df: DataFrame, key: str, rules: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """One row per rule (code, severity, value, condition) that holds."""
    every = F.array(*(F.struct(F.lit(c).alias("code"), s.alias("severity"), v.cast("double").alias("value"), F.coalesce(cond, F.lit(False)).alias("_on")) for c, s, v, cond in rules))
    return df.select(key, F.explode(F.filter(every, lambda x: x["_on"])).alias("a")).select(key, "a.code", "a.severity", "a.value")


def graded(high: Column) -> Column:
    return F.when(high, "high").otherwise("medium")


def reserve_coverage(reserves: Column, npl: Column, filed: Column) -> Column:
    """Reserves against bad loans in percent from their two ratios; the filed figure where those don't give one."""
    return F.when(reserves.isNotNull() & (npl > 0), reserves / npl * 100).otherwise(filed)


CREDIT_CHANGES = ["nco", "npl", "past_due_30_pct", "past_due_90_pct", "coverage"]


def credit(df: DataFrame, key: str = "bank", order: str = "qi") -> DataFrame:
    """Adds past-due shares of loans, coverage and the changes of CREDIT_CHANGES to (nco, npl, loans, past_due_30, past_due_90, reserves, filed_coverage)."""
    w, c = by(key, order), F.col
    out = df.withColumn("past_due_30_pct", F.when(c("loans") > 0, c("past_due_30") / c("loans") * 100)).withColumn("past_due_90_pct", F.when(c("loans") > 0, c("past_due_90") / c("loans") * 100))
    out = out.withColumn("coverage", reserve_coverage(c("reserves"), c("npl"), c("filed_coverage")))
    return out.withColumns({f"{x}_qoq": c(x) - F.lag(x).over(w) for x in CREDIT_CHANGES})


def hotspots(segments: list[str], total: str = "npl", multiple: float = 3.0, least: float = 2.0) -> Column:
    """Segments whose bad-loan rate is ``multiple`` times the bank's or above ``least``, worst first: array of (segment, npl, multiple)."""
    t = F.col(total)
    every = F.array(*(F.struct((-F.col(s)).alias("n"), F.lit(k).alias("k"), F.lit(s).alias("segment"), F.col(s).alias("npl"), (F.col(s) / t).alias("multiple")) for k, s in enumerate(segments)))
    hot = F.filter(every, lambda x: (t > 0) & (x["npl"] > 0) & ((x["multiple"] >= multiple) | (x["npl"] > least)))
    return F.transform(F.sort_array(hot), lambda x: F.struct(x["segment"].alias("segment"), x["npl"].alias("npl"), x["multiple"].alias("multiple")))


def peer_coverage(latest: DataFrame) -> DataFrame:
    """One row: the median of the banks' newest positive coverages."""
    return latest.agg(F.median(F.when(F.col("coverage") > 0, F.col("coverage"))).alias("peer_coverage"))


def credit_alerts(timeline: DataFrame, segments: list[str], key: str = "bank", order: str = "qi") -> DataFrame:
    """Rising charge-offs, past-due migration, thin reserves (also against the peers' median) and segment hotspots of banks with two rows or more."""
    rows = timeline.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    last = newest(timeline, key, order).join(rows, key)
    last = last.join(newest_values(timeline, key, order, "nco", 4, "_nco"), key, "left").withColumn("peer_coverage", peer_coverage(last).scalar())
    hot, c = hotspots(segments), F.col
    nco, rise = c("_nco"), F.get("_nco", 0) - F.get("_nco", 3)
    rising = (F.size(nco) >= 4) & (F.get(nco, 0) > F.get(nco, 1)) & (F.get(nco, 1) > F.get(nco, 2)) & (F.get(nco, 2) > F.get(nco, 3))
    thin = (c("coverage") >= 100) & (c("coverage") < c("peer_coverage") * 0.75)
    rules = [
        ("nco_accelerating", graded(rise > 0.25), rise, rising & (rise > 0.05)),
        ("pd_migration", F.lit("medium"), c("past_due_30_pct_qoq"), (c("past_due_30_pct_qoq") > 0.10) & c("past_due_30_pct").isNotNull()),
        ("under_reserved", F.lit("high"), c("coverage"), c("coverage") < 100),
        ("thin_reserves_vs_peers", F.lit("medium"), c("coverage"), thin),
    ]
    for k in range(2):
        h = F.get(c("_hot"), k)
        rules.append(("segment_hotspot", F.lit("high"), h["npl"], h["multiple"] >= 3.0))
        rules.append(("segment_elevated", F.lit("medium"), h["npl"], (h["multiple"] < 3.0) & (h["npl"] > 3.0)))
    return alerts(last.withColumn("_hot", hot), key, rules)


def credit_screening(timeline: DataFrame, segments: list[str], key: str = "bank", order: str = "qi") -> DataFrame:
    """One row a bank: trends in basis points, coverage, worst segment."""
    w = by(key, order)
    rows = timeline.withColumn("_back", F.lag("nco", 4).over(w))
    last = newest(rows, key, order).withColumn("_hot", hotspots(segments))
    return last.select(
        key, ((F.col("nco") - F.col("_back")) * 100).alias("nco_4q_trend_bps"), (F.col("npl_qoq") * 100).alias("npl_trend_bps"), (F.col("past_due_30_pct_qoq") * 100).alias("pd_migration_bps"),
        F.col("coverage").alias("reserve_coverage_pct"), F.get("_hot", 0)["npl"].alias("worst_segment_npl"),
    )


def deposits(df: DataFrame, key: str = "bank", order: str = "qi") -> DataFrame:
    """Adds shares of deposits, growth and changes of cost and rate to (deposits, noninterest, uninsured, brokered, cost, rate)."""
    w, c = by(key, order), F.col
    out = df.withColumns({f"{x}_pct": share(c(x), c("deposits")) for x in ("noninterest", "uninsured", "brokered")})
    before = F.lag("deposits").over(w)
    return out.withColumns({"growth_qoq": F.when(before != 0, (c("deposits") / before - 1) * 100), "cost_qoq": c("cost") - F.lag("cost").over(w), "rate_qoq": c("rate") - F.lag("rate").over(w)})


def deposit_alerts(timeline: DataFrame, key: str = "bank", order: str = "qi") -> DataFrame:
    """Outflows, accelerating cost, a falling share without interest, and uninsured concentration."""
    w, c = by(key, order), F.col
    place = F.row_number().over(w)
    rows = timeline.withColumns({
        "_k": place, "_two": F.avg("cost_qoq").over(w.rowsBetween(-1, 0)), "_four": F.avg("cost_qoq").over(w.rowsBetween(-5, -2)), "_year": F.lag("noninterest_pct", 4).over(w),
    })
    fall = c("noninterest_pct") - c("_year")
    return alerts(newest(rows, key, order), key, [
        ("deposit_outflow", graded(c("growth_qoq") < -5), c("growth_qoq"), c("growth_qoq") < -2),
        ("cost_accelerating", F.lit("medium"), c("_two"), (c("_k") >= 6) & (c("_two") > 0.10) & (c("_two") > c("_four") * 1.5)),
        ("nii_declining", F.lit("medium"), fall, fall < -3),
        ("uninsured_high", graded(c("uninsured_pct") > 55), c("uninsured_pct"), c("uninsured_pct") > 40),
    ])


def capital(df: DataFrame, key: str = "bank", order: str = "qi", shares: str | None = None) -> DataFrame:
    """Adds tangible equity, the quarter's income, implied returns, retention and changes to (cet1, equity, intangibles, income_ytd, loans)."""
    w, c = by(key, order), F.col
    out = decumulated(df.withColumn("tbv", c("equity") - F.coalesce("intangibles", F.lit(0.0))), key, order, "income_ytd").withColumnRenamed("flow", "income")
    next_one = c(order) - F.lag(order).over(w) == 1
    change = lambda x: F.when(next_one, c(x) - F.lag(x).over(w))
    out = out.withColumns({"equity_qoq": change("equity"), "tbv_qoq": change("tbv"), "loans_qoq": change("loans"), "cet1_qoq": change("cet1"), "loans_qoq_pct": F.when(next_one & (F.lag("loans").over(w) != 0), (c("loans") / F.lag("loans").over(w) - 1) * 100)})
    out = out.withColumn("returned", c("income") - c("equity_qoq")).withColumn("retention", F.when(c("income") != 0, 1 - c("returned") / c("income")))
    return out.withColumn("tbv_per_share", F.when(c(shares) > 0, c("tbv") * 1000 / c(shares))) if shares else out


def organic_need(loan_growth: Column, target: float = 10.0) -> Column:
    """Capital that loan growth ties up at a target ratio in percent; none where loans don't grow or the growth is unknown."""
    return F.when(loan_growth > 0, loan_growth * (target / 100)).otherwise(0.0)


def buyback_capacity(income: Column, returned: Column, need: Column) -> Column:
    """What a quarter's income leaves after returns and organic need; null without income."""
    return income - F.coalesce(returned, F.lit(0.0)) - F.coalesce(need, F.lit(0.0))


def capital_alerts(timeline: DataFrame, key: str = "bank", order: str = "qi") -> DataFrame:
    """Low, eroding or below-peer capital ratio, eroding tangible value, high payout."""
    w, c = by(key, order), F.col
    near = w.rowsBetween(-3, 0)
    rows = timeline.withColumns({"_kept": F.avg("retention").over(near), "_known": F.count("retention").over(near), "_rows": F.row_number().over(w)} | {f"_c{k}": F.lag("cet1", k).over(w) for k in range(1, 5)})
    last = newest(rows, key, order)
    last = last.join(newest_values(timeline, key, order, "tbv_per_share", 5, "_tbv"), key, "left").withColumn("_peer", last.agg(F.median("cet1")).scalar())
    five = [c("cet1"), *(c(f"_c{k}") for k in range(1, 5))]
    eroding = (five[0] < five[1]) & (five[1] < five[2]) & (five[2] < five[3]) & (five[3] < five[4])
    fall, payout = five[4] - five[0], (1 - c("_kept")) * 100
    now, then = F.get("_tbv", 0), F.get("_tbv", 4)
    return alerts(last, key, [
        ("cet1_critical", F.lit("high"), c("cet1"), c("cet1") < CET1_MINIMUM),
        ("cet1_low", F.lit("medium"), c("cet1"), (c("cet1") >= CET1_MINIMUM) & (c("cet1") < CET1_BUFFER)),
        ("cet1_eroding", F.lit("high"), -fall, eroding & (fall > 0.25)),
        ("tbv_eroding", F.lit("medium"), F.when(then != 0, (now - then) / then * 100), now < then),
        ("high_payout", F.lit("medium"), payout, (c("_rows") >= 4) & (c("_known") >= 2) & (payout > 80)),
        ("cet1_below_peers", F.lit("medium"), c("cet1") - c("_peer"), c("cet1") < c("_peer") * 0.85),
    ])


def capital_screening(timeline: DataFrame, key: str = "bank", order: str = "qi") -> DataFrame:
    """One row a bank: ratio and its change, payout over four quarters (none below zero, null above 200), buyback capacity in dollars, yearly growth of tangible value."""
    w, c = by(key, order), F.col
    payout = (1 - F.avg("retention").over(w.rowsBetween(-3, 0))) * 100
    rows = timeline.withColumn("_payout", payout)
    last = newest(rows, key, order).join(newest_values(timeline, key, order, "tbv_per_share", 5, "_tbv"), key, "left")
    then, now = F.get("_tbv", 4), F.get("_tbv", 0)
    return last.select(
        key, c("cet1").alias("cet1_current"), c("cet1_qoq").alias("cet1_qoq_pp"), F.when(then > 0, (now / then - 1) * 100).alias("tbv_cagr_1y"),
        F.when(c("_payout") < 0, 0.0).when(c("_payout") <= 200, c("_payout")).alias("payout_ratio_4q"), (buyback_capacity(c("income"), c("returned"), organic_need(c("loans_qoq"))) * 1000).alias("buyback_capacity_usd"),
    )


def capital_return(df: DataFrame, key: str = "bank", order: str = "qi", keep: int = 20) -> DataFrame:
    """(dividends, buybacks, income, shares) by quarter: shares filled forward, totals that one known part makes, ratios to positive income, share changes; the newest ``keep`` rows."""
    w, c = by(key, order), F.col
    out = df.withColumn("shares", F.last("shares", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = c("dividends").isNotNull() | c("buybacks").isNotNull()
    out = out.withColumn("returned", F.when(known, F.coalesce("dividends", F.lit(0.0)) + F.coalesce("buybacks", F.lit(0.0))))
    safe, before = F.when(c("income") > 0, c("income")), F.lag("shares").over(w)
    out = out.withColumns({"payout_ratio": c("dividends") / safe, "buyback_ratio": c("buybacks") / safe, "return_ratio": c("returned") / safe, "share_change": c("shares") - before, "share_change_pct": F.when(before != 0, (c("shares") / before - 1) * 100)})
    return newest(out, key, order, keep).drop("age")


def capital_return_ttm(timeline: DataFrame, key: str = "bank", order: str = "qi") -> DataFrame:
    """Adds to each row its last four quarters: dividends, buybacks and income only as full windows, their total from what is known, ratios to positive income, share change."""
    c, w = F.col, by(key, order)
    out = timeline
    for name in ("dividends", "buybacks", "income"):
        out = full_window_sum(out, key, order, name, 4, f"{name}_ttm")
    known = c("dividends_ttm").isNotNull() | c("buybacks_ttm").isNotNull()
    out = out.withColumn("returned_ttm", F.when(known, F.coalesce("dividends_ttm", F.lit(0.0)) + F.coalesce("buybacks_ttm", F.lit(0.0))))
    safe = F.when(c("income_ttm") > 0, c("income_ttm"))
    first = F.first("shares").over(w.rowsBetween(-3, 0))
    return out.withColumns({"payout_ttm": F.nullif(c("dividends_ttm"), F.lit(0.0)) / safe, "total_return_ttm": c("returned_ttm") / safe, "share_change_ttm": F.when((first > 0) & (c("shares") != 0), (c("shares") / first - 1) * 100)})


def shareholder_yield(ttm: DataFrame, market_cap: str) -> DataFrame:
    """Adds dividend, buyback and shareholder yields in percent of a positive market value; unknown returns give null, not zero."""
    cap = F.when(F.col(market_cap) > 0, F.col(market_cap))
    return ttm.withColumns({"dividend_yield_pct": F.col("dividends_ttm") / cap * 100, "buyback_yield_pct": F.col("buybacks_ttm") / cap * 100, "shareholder_yield_pct": F.col("returned_ttm") / cap * 100})

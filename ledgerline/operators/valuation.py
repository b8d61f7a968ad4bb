"""Multiples, discounted cash flows and sensitivities as column expressions; missing or meaningless inputs give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.binding import once


def multiple(price: Column, base: Column) -> Column:
    """Price over a per-share base; null where the base isn't positive."""
    return F.when(base > 0, price / base)


def dividend_yield(dps: Column, price: Column) -> Column:
    """Percent; zero dividends are data."""
    return F.when((price > 0) & dps.isNotNull(), dps / price * 100)


def warranted(roatce: Column, coe: Column, growth: Column) -> Column:
    """Price to tangible book that a return warrants: (R - g) / (k - g); null unless positive and k > g."""
    m = (roatce - growth) / (coe - growth)
    return F.when((coe > growth) & (m > 0), m)


def blended(now: Column, average: Column) -> Column:
    """Three quarters the present return, one the average; either alone where the other is missing."""
    return F.coalesce(0.75 * now + 0.25 * average, now, average)


def upside(price: Column, fair: Column) -> Column:
    return F.when(price > 0, (fair - price) / price * 100)


def present_value(flows: Column, rate: Column) -> Column:
    """Of an array of yearly flows from the first year's end, at a rate in percent."""
    step = F.aggregate(flows, F.struct(F.lit(0.0).alias("v"), F.lit(1.0).alias("d")), lambda a, x: F.struct((a["v"] + x / (a["d"] * (1 + rate / 100))).alias("v"), (a["d"] * (1 + rate / 100)).alias("d")))
    return step["v"]


def terminal(flow: Column, rate: Column, growth: Column) -> Column:
    """Of a flow a year ahead; null where the rate doesn't exceed the growth."""
    return F.when(rate > growth, flow / ((rate - growth) / 100))


def dcf(eps: Column, growth: Column, payout: Column, coe: Column, last_growth: Column, years: int = 5) -> Column:
    """Value per share: payouts on earnings that grow at ``growth`` percent, then a terminal value on ``last_growth``."""
    value, factor = F.lit(0.0), F.lit(1.0)
    for k in range(1, years + 1):  # written out: by a function of arrays a search for a rate took many times as long
        factor = factor * (1 + coe / 100)
        value = value + eps * F.pow(1 + growth / 100, F.lit(k)) * payout / factor
    end = terminal(eps * F.pow(1 + growth / 100, F.lit(years)) * (1 + last_growth / 100) * payout, coe, last_growth)
    return F.when(eps > 0, value + end / F.pow(1 + coe / 100, F.lit(years)))


def implied_rate(price: Column, value, low: float = 3.5, high: float = 60.0, rounds: int = 60) -> Column:
    """The rate at which ``value(rate)`` is the price, by bisection inside one expression; null where the bracket doesn't hold it."""

    def halve(a, _):
        side = lambda mid, above: F.struct(F.when(above, mid).otherwise(a["lo"]).alias("lo"), F.when(above, a["hi"]).otherwise(mid).alias("hi"))
        return once((a["lo"] + a["hi"]) / 2, lambda mid: once(value(mid) > price, lambda above: side(mid, above)))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")), halve)
    return F.when((value(F.lit(low)) >= price) & (value(F.lit(high)) <= price), once(end, lambda e: (e["lo"] + e["hi"]) / 2))


def grid(df: DataFrame, name_a: str, a: list[float], name_b: str, b: list[float]) -> DataFrame:
    """Every row with every pair of two short parameter lists: arrays exploded in place, no join."""
    return df.withColumn(name_a, F.explode(F.lit(a))).withColumn(name_b, F.explode(F.lit(b)))


def tornado(df: DataFrame, key: str, value, params: dict[str, float]) -> DataFrame:
    """One-at-a-time perturbations: key, param, low, high, spread. ``value(shifts)`` gives the result with shifts by parameter name."""
    zero = {p: 0.0 for p in params}
    cases = F.array(*(F.struct(F.lit(p).alias("param"), value(zero | {p: -d}).alias("low"), value(zero | {p: d}).alias("high")) for p, d in params.items()))
    out = df.select(key, F.explode(cases).alias("c")).select(key, "c.param", "c.low", "c.high")
    return out.withColumn("spread", F.abs(F.col("high") - F.col("low")))


def fcfe(eps: Column, loan_growth: Column, loans: Column, target: float) -> Column:
    """Yearly flows to equity per share: earnings less the capital (``target`` percent) that the growth of loans per share ties up.

    ``eps`` and ``loan_growth`` (fractions) are arrays by year, ``loans`` the start.
    """
    step = F.aggregate(
        F.arrays_zip(eps.alias("e"), loan_growth.alias("g")), F.struct(F.array().cast("array<double>").alias("out"), loans.cast("double").alias("l")),
        lambda a, x: F.struct(F.concat(a["out"], F.array(x["e"] - a["l"] * x["g"] * (target / 100))).alias("out"), (a["l"] * (1 + x["g"])).alias("l")),
    )
    return step["out"]


def warranted_price(roatce: Column, coe: Column, growth: Column, tbvps: Column) -> Column:
    """The warranted multiple times tangible book per share; null where either is."""
    return warranted(roatce, coe, growth) * F.nullif(tbvps, F.lit(0.0))


def scenarios(df: DataFrame, key: str, value, shifts: dict[str, dict[str, float]]) -> DataFrame:
    """key, scenario, value: ``value(shifts)`` under the base and each named set of shifts of its parameters."""
    cases = F.array(*(F.struct(F.lit(name).alias("scenario"), value(s).alias("value")) for name, s in {"base": {}, **shifts}.items()))
    return df.select(key, F.explode(cases).alias("c")).select(key, "c.scenario", "c.value")


def per_year(period: Column) -> Column:
    """What brings a per-share figure of a period to a year: 4 for YYYYQn, 1 for YYYY, else null."""
    p = F.upper(F.trim(period))
    return F.when(p.rlike("^[0-9]{4}Q[1-4]$"), 4.0).when(p.rlike("^[0-9]{4}$"), 1.0)


def plausible_quarter(stated: Column, priors: Column, low: float = 0.2, high: float = 5.0) -> Column:
    """Whether a stated figure lies within multiples of the median of three prior quarters, in size; false where anything is missing."""
    known = F.filter(priors, lambda x: x.isNotNull())
    middle = F.abs(F.get(F.sort_array(known), 1))
    return F.coalesce((F.size(priors) == 3) & (F.size(known) == 3) & (middle > 0) & F.abs(stated).between(middle * low, middle * high), F.lit(False))


def ties_out(stated: Column, income: Column, shares: Column) -> Column:
    """Whether income over shares, at a scale of 1, a thousand or a million, gives the stated figure within 2 percent or 0.006; null without inputs."""
    tolerance = F.greatest(F.abs(stated) * 0.02, F.lit(0.006))
    out = F.lit(False)
    for scale in (1.0, 1e3, 1e6):
        out = out | (F.abs(income / (shares * scale) - stated) <= tolerance)
    return F.when((stated != 0) & income.isNotNull() & (shares != 0), out)


def chosen_figure(stated: Column, rebuilt: Column, band: float = 0.15) -> tuple[Column, Column, Column]:
    """A company's own figure or the rebuilt one: value, source, conflict. The stated one counts unless it is ``band`` or more away from the rebuilt one, which is then flagged."""
    off = F.coalesce(F.abs(stated - rebuilt) >= band * F.abs(rebuilt), F.lit(False))
    own = stated.isNotNull() & ~off
    return F.when(own, stated).otherwise(rebuilt), F.when(own, "reported").when(rebuilt.isNotNull(), "reconstructed"), off

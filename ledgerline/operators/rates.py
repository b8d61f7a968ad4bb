"""Rate sensitivity: betas, repricing pace, scenarios and back-tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blended_beta(weights: list[Column], betas: list[float]) -> Column:
    """Weighted mean of betas, held within 0 and 1.5; null without weight."""
    total = sum(weights[1:], weights[0])
    mean = sum((w * b for w, b in zip(weights[1:], betas[1:])), weights[0] * betas[0]) / total
    return F.when(total > 0, F.least(F.lit(1.5), F.greatest(F.lit(0.0), mean)))


def pace(duration: Column, years: int = 3) -> list[Column]:
    """Cumulative share repriced after each year of a book with the given duration."""
    return [F.when(duration > 0, F.least(F.lit(1.0), F.lit(float(n)) / duration)) for n in range(1, years + 1)]


def ladder_pace(buckets: list[Column], shares: list[list[float]]) -> list[Column]:
    """Cumulative shares by year of a maturity ladder; ``shares``: of each bucket, by year."""
    total = sum(buckets[1:], buckets[0])
    return [F.when(total > 0, sum((b * s[y] for b, s in zip(buckets[1:], shares[1:])), buckets[0] * shares[0][y]) / total) for y in range(len(shares[0]))]


def income_change(assets: Column, deposits: Column, floating: Column, beta: Column, shock_bps: Column, share: Column) -> Column:
    """Change in yearly interest income: floating assets reprice at once, the rest by ``share``; deposits by their beta."""
    move = shock_bps / 10000.0
    return assets * (floating + (1 - floating) * share) * move - deposits * beta * move


def phased(df: DataFrame, key: str, shocks: list[float], years: int, change) -> DataFrame:
    """Scenario by year: key, shock_bps, year, change. Short lists are exploded in place; ``change(shock, year)`` is an expression."""
    cases = df.withColumn("shock_bps", F.explode(F.lit(shocks))).withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    return cases.select(key, "shock_bps", "year", change(F.col("shock_bps"), F.col("year")).alias("change"))


def backtest(df: DataFrame, key: str, order: str, value: str, horizon: int = 4) -> DataFrame:
    """Walk-forward test of carrying the last growth on: key, order, predicted, actual; each prediction uses only rows ``horizon`` or more before."""
    w = Window.partitionBy(key).orderBy(order)
    base, before = F.lag(value, horizon).over(w), F.lag(value, 2 * horizon).over(w)
    return df.select(key, order, F.when(before > 0, base * base / before).alias("predicted"), F.col(value).alias("actual"), base.alias("base")).where("predicted is not null")


def errors(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n, rmse, bias, corr of changes, hit_rate (same direction)."""
    e = F.col("predicted") - F.col("actual")
    p, a = F.col("predicted") - F.col("base"), F.col("actual") - F.col("base")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.corr(p, a).alias("corr"), F.avg((F.signum(p) == F.signum(a)).cast("double")).alias("hit_rate")
    )


# Growth per 100 basis points of loans, deposits and securities; betas where history gives none.
VOLUME = {"loans": -0.02, "deposits": -0.01, "securities": 0.005}
TEXTBOOK_BETA = 0.50
# Maturity buckets in years.
BUCKETS = [("le_3mo", 0.0, 0.25), ("3mo_1y", 0.25, 1.0), ("1y_3y", 1.0, 3.0), ("3y_5y", 3.0, 5.0), ("5y_15y", 5.0, 15.0), ("gt_15y", 15.0, 20.0)]


def adjusted_growth(base: dict[str, Column], shock_bps: Column) -> dict[str, Column]:
    """Growth rates of loans, deposits, securities and earning assets (70 percent loans) after a change of rates."""
    step = shock_bps / 100.0
    out = {k: base[k] + step * v for k, v in VOLUME.items()}
    return out | {"earning_assets": base["earning_assets"] + step * (VOLUME["loans"] * 0.7 + VOLUME["securities"] * 0.3)}


def curve_scenario(margin: Column, earning_assets: Column, interest_bearing: Column, non_interest: Column, deposits: Column, short_bps: Column, long_bps: Column, beta: Column, asset_beta: float = 1.0, non_interest_beta: float = 0.0) -> tuple[Column, Column]:
    """Change of the margin in basis points and of yearly net interest income: yields follow the long rate, costs the short one by the deposits' betas and weights."""
    short, long = short_bps / 100.0, long_bps / 100.0
    cost = F.when(deposits > 0, (interest_bearing * short * beta + non_interest * short * non_interest_beta) / deposits).otherwise(short * beta)
    move = long * asset_beta - cost
    return move * 100, earning_assets * move / 100


def resolved_beta(custom: Column, historical: Column) -> tuple[Column, Column]:
    """The deposit beta and where it is from: a given one within 0 and 1, else history within -0.2 and 1.5, else the textbook's."""
    value = F.when(custom.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), custom))).when(historical.isNotNull(), F.greatest(F.lit(-0.2), F.least(F.lit(1.5), historical))).otherwise(TEXTBOOK_BETA)
    return value, F.when(custom.isNotNull(), "custom").when(historical.isNotNull(), "historical").otherwise("textbook_fallback")


def ladder(amounts: list[Column]) -> dict[str, Column]:
    """Of the amounts in BUCKETS: total, floating share, share within a year, weighted years (two digits); null without a positive total."""
    known = [F.coalesce(a, F.lit(0.0)) for a in amounts]
    total = sum(known[1:], known[0])
    part = lambda x: F.when(total > 0, x / total)
    years = sum((a * ((lo + hi) / 2) for a, (_, lo, hi) in zip(known, BUCKETS)), F.lit(0.0))
    return {"total": F.when(total > 0, total), "floating": part(known[0]), "within_year": part(known[0] + known[1]), "years": F.round(part(years), 2)}

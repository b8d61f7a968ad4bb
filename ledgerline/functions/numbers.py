"""Scalar rules: missing is null, never zero; ratios without a positive base are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """As a double; what is no number, or NaN, is null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def rounded(x: Column, digits: int) -> Column:
    """Rounded as the binary double is, halves away from zero, as SQL does it by round(x * 10^digits) / 10^digits."""
    return F.round(x * 10.0**digits) / 10.0**digits


def exact_mean(x: Column, digits: int = 4) -> Column:
    """Aggregate: the mean of values with at most ``digits`` decimals, from an exact sum, so that it doesn't hang on the order of rows."""
    return F.sum(x.cast(f"decimal(28,{digits})")).cast("double") / F.count(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is not positive."""
    return F.when(b > 0, a / b)


def annualised(ytd: Column, quarter: Column) -> Column:
    """A year-to-date flow scaled to a year."""
    return ytd * 4.0 / quarter


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / F.abs(before) * 100.0)


def size_tier(assets: Column) -> Column:
    """Four tiers by assets; null where not positive."""
    return (
        F.when(assets.isNull() | (assets <= 0), F.lit(None).cast("string"))
        .when(assets >= 250e9, "mega").when(assets >= 50e9, "large").when(assets >= 10e9, "regional").otherwise("community")
    )


def banded(x: Column, edges: list[float], names: list[str]) -> Column:
    """Half-open bands [edge, next); one name more than edges."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, names):
        out = out.when(x < edge, name)
    return out.otherwise(names[-1])


def hhi_band(hhi: Column) -> Column:
    return F.when(hhi < 1500, "unconcentrated").when(hhi <= 2500, "moderate").when(hhi > 2500, "high")


def merger_flag(post: Column, delta: Column) -> Column:
    """The screen for mergers: strictly above 1800 after, and strictly above 200 more."""
    return (post > 1800) & (delta > 200)


def accounting_number(text: Column) -> Column:
    """Numbers as printed: parentheses are negative; currency signs, percent and commas go; dashes are null."""
    t = F.trim(text)
    bare = F.regexp_replace(t, r"[$,%()\s]", "")
    value = bare.try_cast("double")
    return F.when(t.rlike(r"^\(.*\)"), -value).otherwise(value)


def period_label(text: Column) -> Column:
    """Period notations (2024Q1, Q1 2024, 1Q24, FY2024, 2024) as YYYYQn or YYYY; others null."""
    t = F.upper(F.trim(text))
    first = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    four, three, two = r"^(\d{4})[ -]?Q([1-4])$", r"^Q([1-4])[ -]?(\d{4})$", r"^([1-4])Q[ -]?(\d{2})$"
    return F.coalesce(
        F.concat(first(four, 1), F.lit("Q"), first(four, 2)),
        F.concat(first(three, 2), F.lit("Q"), first(three, 1)),
        F.concat(F.lit("20"), first(two, 2), F.lit("Q"), first(two, 1)),
        first(r"^(?:FY ?)?(\d{4})$", 1),
    )


def quarter_label(qi: Column) -> Column:
    """'Q1 2024' from a quarter index."""
    return F.concat(F.lit("Q"), (qi % 4 + 1).cast("string"), F.lit(" "), F.floor(qi / 4).cast("string"))

"""Rows of a financial statement by kind, compiled from a specification to one projection.

A specification is a list of (label, kind, arguments); :func:`statement` evaluates it over
one row a bank and quarter. Year-to-date fields give a quarter's flow by difference, flows
over balances are brought to a year, balances are means of this and the prior row (the
present one alone where there is none). What is missing gives null; zero is data.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .timeseries import by

# The statutory tax rate, and the bounds and default of an effective one.
STATUTORY, TAX_BOUNDS, TAX_DEFAULT = 0.21, (0.0, 0.40), 0.21

KINDS: dict[str, Callable] = {}


def kind(f: Callable) -> Callable:
    """Registers a row kind under its function's name, without a final underscore."""
    KINDS[f.__name__.rstrip("_")] = f
    return f


class Period:
    """What a row kind sees of a bank's period."""

    def __init__(self, w: WindowSpec, order: str):
        self.w, self.order = w, order

    def before(self, x: Column) -> Column:
        return F.lag(x).over(self.w)

    def flow(self, field: str) -> Column:
        """The quarter's own part of a year-to-date field; first quarters are their own, others need the quarter before."""
        x, q = F.col(field), F.col(self.order)
        return F.when(q % 4 == 0, x).when(self.before(q) == q - 1, x - self.before(x))

    def mean(self, field: str) -> Column:
        x = F.col(field)
        return F.coalesce((x + self.before(x)) / 2, x)

    def mean_sum(self, fields: list[str]) -> Column:
        """Mean of a sum of balances; missing ones count for nothing, null if all are."""
        return total([self.mean(f) for f in fields])


def total(parts: list[Column]) -> Column:
    some, out = F.lit(False), F.lit(0.0)
    for p in parts:
        some, out = some | p.isNotNull(), out + F.coalesce(p, F.lit(0.0))
    return F.when(some, out)


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def percent(a: Column, b: Column, positive: bool = False) -> Column:
    return F.when(b > 0 if positive else b != 0, a / b * 100)


def terms(expression: str) -> list[tuple[int, str]]:
    """'A+B-C' as signs and fields; the first is positive."""
    return [(-1 if s == "-" else 1, f) for s, f in re.findall(r"([+-]?)\s*([A-Za-z_]\w*)", expression)]


def numerator(expression: str) -> Column:
    """Known terms only; null if none is."""
    return total([F.lit(float(s)) * F.col(f) for s, f in terms(expression)])


def denominator(expression: str) -> Column:
    """Every positive term is needed, a missing negative one counts for nothing."""
    out = F.lit(0.0)
    for s, f in terms(expression):
        out = out + (F.col(f) if s > 0 else -zero(F.col(f)))
    return out


def effective_tax(tax: Column, pretax: Column) -> Column:
    low, high = TAX_BOUNDS
    return F.coalesce(F.when(pretax != 0, F.least(F.greatest(tax / pretax, F.lit(low)), F.lit(high))), F.lit(TAX_DEFAULT))


def core_income(tax: float | None = None) -> Column:
    """Net income without security gains, after tax, and extraordinary items."""
    t = effective_tax(F.col("taxes"), F.col("pretax"))
    return F.col("net_income") - zero(F.col("security_gains")) * (1 - t) - zero(F.col("extraordinary"))


@kind
def dollar(p: Period, field: str) -> Column:
    return F.col(field)


@kind
def pct(p: Period, field: str) -> Column:
    return F.col(field)


@kind
def diff(p: Period, a: str, b: str) -> Column:
    return F.col(a) - F.col(b)


@kind
def pctdiff(p: Period, a: str, b: str) -> Column:
    return F.col(a) - F.col(b)


@kind
def ratio(p: Period, a: str, b: str) -> Column:
    return percent(F.col(a), F.col(b))


@kind
def noniother(p: Period, whole: str, *parts: str) -> Column:
    """A total less its itemised lines; missing lines count for nothing."""
    return F.col(whole) - sum((zero(F.col(x)) for x in parts), F.lit(0.0))


@kind
def ppnr(p: Period, interest: str, expense: str, other: str, cost: str) -> Column:
    return F.col(interest) - F.col(expense) + F.col(other) - F.col(cost)


@kind
def etr(p: Period, tax: str, pretax: str) -> Column:
    return percent(F.col(tax), F.col(pretax))


@kind
def tce(p: Period, equity: str, intangibles: str) -> Column:
    return F.col(equity) - zero(F.col(intangibles))


@kind
def roatce(p: Period, income: str, equity: str, intangibles: str) -> Column:
    return percent(p.flow(income) * 4, p.mean(equity) - zero(p.mean(intangibles)), positive=True)


@kind
def roate(p: Period, income: str, equity: str, intangibles: str) -> Column:
    return roatce(p, income, equity, intangibles)


@kind
def roace(p: Period, income: str, equity: str, preferred: str) -> Column:
    """Null where preferred stock is outstanding, as its dividends aren't known."""
    return F.when(zero(F.col(preferred)) <= 0, percent(p.flow(income) * 4, p.mean(equity) - zero(p.mean(preferred)), positive=True))


@kind
def marginrev(p: Period, field: str, interest: str, expense: str, other: str) -> Column:
    return percent(F.col(field), F.col(interest) - F.col(expense) + F.col(other))


@kind
def netopex(p: Period, cost: str, other: str, assets: str) -> Column:
    return percent((p.flow(cost) - p.flow(other)) * 4, p.mean(assets))


@kind
def costfunds(p: Period, expense: str, *funding: str) -> Column:
    return percent(p.flow(expense) * 4, p.mean_sum(list(funding)))


@kind
def costdebt(p: Period, expense: str, deposit_expense: str, *borrowings: str) -> Column:
    """Null on borrowings below 1,000, where a rate says nothing."""
    b = p.mean_sum(list(borrowings))
    return F.when(b >= 1000, (p.flow(expense) - p.flow(deposit_expense)) * 4 / b * 100)


@kind
def yield_(p: Period, flow: str, balance: str) -> Column:
    return percent(p.flow(flow) * 4, p.mean(balance))


@kind
def yield2(p: Period, a: str, b: str, balance: str) -> Column:
    return percent((p.flow(a) - p.flow(b)) * 4, p.mean(balance))


def _grossed(parts: tuple[str, ...]) -> Column:
    return total([F.col(x) for x in parts]) * (STATUTORY / (1 - STATUTORY))


@kind
def fte_adj(p: Period, *exempt: str) -> Column:
    """What tax-exempt income is worth before tax; null if none is reported."""
    return _grossed(exempt)


@kind
def nii_fte(p: Period, interest: str, expense: str, *exempt: str) -> Column:
    return F.col(interest) - F.col(expense) + _grossed(exempt)


@kind
def ftenim(p: Period, margin: str, earning_assets: str, *exempt: str) -> Column:
    """Margin plus the adjustment, brought to a year by the quarter, over mean earning assets."""
    per_year = 4.0 / (F.col(p.order) % 4 + 1)
    return F.col(margin) + percent(_grossed(exempt) * per_year, p.mean(earning_assets))


@kind
def rie(p: Period, details: str, code: str) -> Column:
    """An itemised line from a map of codes; not itemised is null, a filed zero zero."""
    return F.try_element_at(F.col(details), F.lit(code))


@kind
def rie_wi(p: Period, writeins: str, label: str) -> Column:
    """A write-in from a map of labels."""
    return F.try_element_at(F.col(writeins), F.lit(label))


@kind
def dep_flow(p: Period, interest: str) -> Column:
    return p.flow(interest)


@kind
def dep_avg(p: Period, balance: str) -> Column:
    return F.col(balance)


@kind
def dep_rate(p: Period, interest: str, balance: str) -> Column:
    """A quarter's cost over that quarter's own average balance, brought to a year."""
    return percent(p.flow(interest) * 4, F.col(balance), positive=True)


@kind
def na(p: Period) -> Column:
    return F.lit(None).cast("double")


@kind
def sum_(p: Period, *fields: str) -> Column:
    return total([F.col(x) for x in fields])


@kind
def htm(p: Period, filed: str, securities: str, available: str, trading: str) -> Column:
    return F.coalesce(F.col(filed), F.col(securities) - F.col(available) - zero(F.col(trading)))


def _not_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


@kind
def otherint(p: Period, intangibles: str, goodwill: str, servicing: str) -> Column:
    """Null where the components exceed the total."""
    return _not_negative(F.col(intangibles) - F.col(goodwill) - zero(F.col(servicing)))


@kind
def residual(p: Period, whole: str, *parts: str) -> Column:
    return _not_negative(noniother(p, whole, *parts))


@kind
def growth(p: Period, field: str, periods_a_year: int = 4) -> Column:
    """From the row before, compounded to a year; null unless the ratio is positive."""
    r = F.col(field) / F.nullif(p.before(F.col(field)), F.lit(0.0))
    return F.when(r > 0, (F.pow(r, F.lit(periods_a_year)) - 1) * 100)


@kind
def flow(p: Period, ytd: str, filed: str | None = None) -> Column:
    return F.coalesce(F.col(filed), p.flow(ytd)) if filed else p.flow(ytd)


@kind
def fratio(p: Period, over: str, under: str) -> Column:
    return percent(numerator(over), denominator(under), positive=True)


@kind
def flowratio(p: Period, a: str, b: str) -> Column:
    """Of two flows of one quarter; null on a negative one."""
    x, y = p.flow(a), p.flow(b)
    return F.when((x >= 0) & (y > 0), x / y * 100)


@kind
def crit(p: Period, grades: str, which: str, loans: str) -> Column:
    """From a map of dollars by loan grade: a grade, 'classified', 'criticized' (both in thousands), or 'coverage' of gross loans in percent."""
    of = lambda *names: total([F.try_element_at(F.col(grades), F.lit(x)) for x in names])
    if which == "coverage":
        graded = F.aggregate(F.map_values(F.col(grades)), F.lit(0.0), lambda a, x: a + zero(x))
        return F.when(graded > 0, percent(graded / 1000, F.col(loans)))
    classified = ("substandard", "doubtful", "loss")
    return of(*{"classified": classified, "criticized": (*classified, "special_mention")}.get(which, (which,))) / 1000


@kind
def ps(p: Period, field: str) -> Column:
    return F.col(field)


@kind
def shares(p: Period, field: str) -> Column:
    return F.col(field)


@kind
def payout(p: Period, dividend: str, earnings: str) -> Column:
    return percent(F.col(dividend), F.col(earnings))


@kind
def core_income_(p: Period) -> Column:
    return core_income()


def _core_flow(p: Period) -> Column:
    q, c = F.col(p.order), core_income()
    return F.when(q % 4 == 0, c).when(p.before(q) == q - 1, c - p.before(c))


@kind
def core_roaa(p: Period, assets: str) -> Column:
    return percent(_core_flow(p) * 4, p.mean(assets))


@kind
def core_roae(p: Period, equity: str) -> Column:
    return percent(_core_flow(p) * 4, p.mean(equity))


@kind
def core_eps(p: Period, count: str) -> Column:
    return F.when(F.col(count) != 0, core_income() * 1000 / F.col(count))


@kind
def nonrecur(p: Period) -> Column:
    """Security gains and extraordinary items in percent of income before tax."""
    return percent(zero(F.col("security_gains")) + zero(F.col("extraordinary")), F.col("pretax"))


def statement(df: DataFrame, spec: list[tuple], key: str = "bank", order: str = "qi") -> DataFrame:
    """key, order and one column a row of the specification (label, kind, arguments...): one window, one projection."""
    p = Period(by(key, order), order)
    return df.select(key, order, *(KINDS[k](p, *args).alias(label) for label, k, *args in spec))

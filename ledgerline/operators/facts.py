"""Picking figures out of filed facts.

Facts have (cik, concept, unit, start, end, val, form, filed), dates as DATE; instants have
no start. Companies file a period again and again, under several concepts and spans: the
latest filing wins a period, direct quarters beat derived ones, and what is too old or
can't be told is null. Everything is a window or grouping by company (and concept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms that count, the order of units, and the tolerances around a fiscal date, in days.
FORMS = ["10-K", "10-Q"]
UNITS = ["USD", "USD/shares", "shares", "pure"]
FLOW_UNITS = ["USD", "USD/shares", "pure"]
DIVIDEND_UNITS = ["USD/shares", "USD"]
END_DAYS, START_DAYS = 14, 20


def place(x: Column, order: list[str]) -> Column:
    """The position of a value in a list; null outside it."""
    out = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(order))):
        out = F.when(x == name, k).otherwise(out)
    return out


def days() -> Column:
    return F.datediff("end", "start")


def latest(df: DataFrame, as_of: Column, years: int = 3) -> DataFrame:
    """The newest figure of each (cik, concept): value, end, unit. The first unit of UNITS with facts counts, of those FORMS if any; null where it ended over ``years`` years ago."""
    own = df.where("val is not null and end is not null").withColumn("_u", place(F.col("unit"), UNITS)).where("_u is not null")
    best = own.groupBy("cik", "concept").agg(F.min(F.struct("_u", (~F.col("form").isin(FORMS)).alias("o"), (-F.unix_date("end")).alias("e"), (-F.unix_date("filed")).alias("f"), (-F.col("val")).alias("v"), "unit")).alias("b"))
    end = F.date_from_unix_date((-F.col("b.e")).cast("int"))
    fresh = end >= F.date_sub(as_of, 365 * years)
    return best.select("cik", "concept", F.when(fresh, -F.col("b.v")).alias("value"), F.when(fresh, end).alias("end"), F.col("b.unit").alias("unit"))


def in_units(df: DataFrame, units: list[str]) -> DataFrame:
    """Facts in the units only, other currencies aside, with ``_u``: minus the unit's place, so that the earlier one is larger."""
    return df.withColumn("_u", -place(F.col("unit"), units)).where("_u is not null")


def spans(df: DataFrame, units: list[str] = FLOW_UNITS) -> DataFrame:
    """Facts with a duration in FORMS and ``units``, one per (cik, concept, start, end): the latest filed (ties: earlier unit, larger value)."""
    own = in_units(df, units).where(F.col("form").isin(FORMS) & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("val").isNotNull())
    return own.groupBy("cik", "concept", "start", "end").agg(F.max_by("val", F.struct("filed", "_u", "val")).alias("val"), F.max("filed").alias("filed"))


def quarters(durations: DataFrame) -> DataFrame:
    """(cik, concept, end, val, derived): quarters of 80 to 100 days, else the difference of a longer span and one with the same start that ends 80 to 100 days before."""
    w = Window.partitionBy("cik", "concept", "start").orderBy(F.unix_date("end")).rangeBetween(-100, -80)
    step = durations.withColumn("_step", F.when(days() > 100, F.col("val") - F.last("val").over(w))).withColumn("_direct", F.when(days().between(80, 100), F.col("val")))
    out = step.groupBy("cik", "concept", "end").agg(F.max("_direct").alias("_d"), F.max("_step").alias("_s"))
    return out.select("cik", "concept", "end", F.coalesce("_d", "_s").alias("val"), F.col("_d").isNull().alias("derived")).where("val is not null")


def trailing_year(df: DataFrame, as_of: Column, years: int = 2) -> DataFrame:
    """(cik, concept, value, path): the last four quarters if they are consecutive ('quarters'), else the newest annual figure ('annual'); facts over ``years`` years old don't count."""
    d = spans(df).where(F.col("end") >= F.date_sub(as_of, 365 * years))
    w = Window.partitionBy("cik", "concept").orderBy(F.desc("end"))
    last = quarters(d).withColumn("_k", F.row_number().over(w)).withColumn("_gap", F.datediff(F.lag("end").over(w), "end")).where("_k <= 4")
    four = last.groupBy("cik", "concept").agg(F.count("*").alias("_n"), F.count_if(F.col("_gap").between(80, 100)).alias("_fit"), F.sum("val").alias("_q"))
    year = d.where(days().between(350, 380)).groupBy("cik", "concept").agg(F.max_by("val", F.struct("end", "filed", "val")).alias("_a"))
    fine = (F.col("_n") == 4) & (F.col("_fit") == 3)
    return four.join(year, ["cik", "concept"], "full").select(
        "cik", "concept", F.coalesce(F.when(fine, F.col("_q")), F.col("_a")).alias("value"), F.when(fine, "quarters").when(F.col("_a").isNotNull(), "annual").alias("path")
    )


def trailing_dividend(df: DataFrame, as_of: Column) -> DataFrame:
    """(cik, concept, value, path), counted back from the newest reported end, which must lie within 400 days.

    An annual figure that ends there, else the sum of the quarters of the 370 days before,
    else the newest longer span: a skipped quarter is never made up by an older one.
    """
    d = spans(df, DIVIDEND_UNITS)
    anchored = d.withColumn("_e", F.max("end").over(Window.partitionBy("cik", "concept"))).where(F.datediff(as_of, "_e") <= 400)
    back = F.datediff("_e", "end")
    pick = lambda cond, key: F.max_by("val", F.when(cond, key))
    quarter = F.row_number().over(Window.partitionBy("cik", "concept", "end", days().between(80, 100)).orderBy(F.desc("filed"), F.desc("val")))
    out = anchored.withColumn("_r", quarter).groupBy("cik", "concept").agg(
        pick(days().between(350, 380) & (back <= 15), F.struct("filed", "val")).alias("_a"),
        F.sum(F.when(days().between(80, 100) & (back < 370) & (F.col("_r") == 1), F.col("val"))).alias("_q"),
        pick(days() > 100, F.struct("end", "filed", "val")).alias("_y"),
    )
    return out.select("cik", "concept", F.coalesce("_a", "_q", "_y").alias("value"), F.when(F.col("_a").isNotNull(), "annual").when(F.col("_q").isNotNull(), "quarters").when(F.col("_y").isNotNull(), "to date").alias("path"))


def series(df: DataFrame) -> DataFrame:
    """(cik, concept, end, val): every end once, as filed last in FORMS and UNITS (ties: later unit, larger value)."""
    own = in_units(df, UNITS).where(F.col("form").isin(FORMS) & F.col("end").isNotNull() & F.col("val").isNotNull())
    return own.groupBy("cik", "concept", "end").agg(F.max_by("val", F.struct("filed", -F.col("_u"), "val")).alias("val"))


def merged_ladder(series: DataFrame, ladder: list[str]) -> DataFrame:
    """(cik, end, val, concept): for each end the first concept of the ladder with a value that isn't zero; a concept given up years ago hides nothing newer."""
    known = series.withColumn("_p", place(F.col("concept"), ladder)).where("_p is not null and val != 0")
    return known.groupBy("cik", "end").agg(F.min_by(F.struct("val", "concept"), "_p").alias("b")).select("cik", "end", "b.val", "b.concept")


def first_of_ladder(latest: DataFrame, ladders: dict[str, list[str]]) -> DataFrame:
    """One row a company: for each name the first concept of its ladder with a value, and which it was (``<name>_source``)."""
    out = []
    for name, ladder in ladders.items():
        p = F.when(F.col("value").isNotNull(), place(F.col("concept"), ladder))
        out += [F.min_by("value", p).alias(name), F.min_by("concept", p).alias(f"{name}_source")]
    return latest.groupBy("cik").agg(*out)


def _near(c: str, target: Column, tolerance: int) -> Column:
    return F.abs(F.datediff(F.col(c), target)) <= tolerance


def fiscal(df: DataFrame, ladder: list[str], units: tuple[str, ...] = ("USD",)) -> DataFrame:
    """Figures by fiscal quarter: (cik, year, quarter, ytd, direct, instant), each from the first concept of the ladder that has it in ``units``, as filed last (ties: earlier unit, larger value).

    ytd starts within START_DAYS of the year's first day, direct spans 80 to 100 days; ends
    lie within END_DAYS of the quarter's.
    """
    own = in_units(df, list(units)).where(F.col("form").isin(FORMS) & F.col("val").isNotNull()).withColumn("_p", place(F.col("concept"), ladder)).where("_p is not null")
    middle = F.date_sub(F.col("end"), END_DAYS)  # within the quarter also for ends a few days late
    q_end = F.last_day(F.add_months(F.trunc(middle, "quarter"), 2))
    own = own.withColumn("year", F.year(middle)).withColumn("quarter", F.quarter(middle)).where(_near("end", q_end, END_DAYS))
    kind = (
        F.when(F.col("start").isNull(), "instant").when(_near("start", F.make_date("year", F.lit(1), F.lit(1)), START_DAYS), "ytd").when(days().between(80, 100), "direct")
    )
    first_quarter = own.withColumn("_k", F.explode(F.when((kind == "ytd") & days().between(80, 100), F.array(F.lit("ytd"), F.lit("direct"))).otherwise(F.array(kind))))
    best = lambda k: F.max_by("val", F.when(F.col("_k") == k, F.struct((-F.col("_p")).alias("p"), F.col("filed"), F.col("_u"), F.col("val")))).alias(k)
    return first_quarter.groupBy("cik", "year", "quarter").agg(best("ytd"), best("direct"), best("instant"))


def flows(fiscal: DataFrame, prefer: str = "difference") -> DataFrame:
    """Adds ``flow`` (the quarter's own: the difference of year-to-date figures, or the direct figure first with prefer='direct') and ``annual`` (the fourth quarter's year to date)."""
    w = Window.partitionBy("cik", "year").orderBy("quarter")
    before = F.when(F.lag("quarter").over(w) == F.col("quarter") - 1, F.lag("ytd").over(w))
    step = F.when(F.col("quarter") == 1, F.col("ytd")).otherwise(F.col("ytd") - before)
    pair = (step, F.col("direct")) if prefer == "difference" else (F.col("direct"), step)
    return fiscal.withColumn("flow", F.coalesce(*pair)).withColumn("annual", F.when(F.col("quarter") == 4, F.col("ytd")))


def corrupt_scale(df: DataFrame, a: str, b: str, as_of: Column, factor: float = 10.0, age: int = 460) -> DataFrame:
    """(cik, corrupt): whether two concepts that should agree differ by ``factor`` on one period of the last ``age`` days."""
    d = spans(df, ["USD"]).where(F.col("concept").isin(a, b) & (F.datediff(as_of, "end") <= age))
    pair = d.groupBy("cik", "start", "end").agg(F.max(F.when(F.col("concept") == a, F.abs("val"))).alias("x"), F.max(F.when(F.col("concept") == b, F.abs("val"))).alias("y")).where("x > 0 and y > 0")
    return pair.groupBy("cik").agg(F.max((F.greatest("x", "y") / F.least("x", "y") >= factor).cast("int")).cast("boolean").alias("corrupt"))


def presence(latest: DataFrame, concepts: list[str]) -> DataFrame:
    """(cik, value, resolved): the first known of the concepts; a company that files none is unresolved, which is not zero."""
    p = F.when(F.col("value").isNotNull(), place(F.col("concept"), concepts))
    return latest.groupBy("cik").agg(F.min_by("value", p).alias("value"), F.max(p.isNotNull()).alias("resolved"))


def by_year(df: DataFrame) -> DataFrame:
    """(cik, concept, year, values): the filing that came last owns a year; all its distinct values, ascending."""
    y = df.where("val is not null and end is not null").withColumn("year", F.year("end"))
    last = y.withColumn("_f", F.max("filed").over(Window.partitionBy("cik", "concept", "year"))).where("filed = _f")
    return last.groupBy("cik", "concept", "year").agg(F.array_sort(F.collect_set("val")).alias("values"))

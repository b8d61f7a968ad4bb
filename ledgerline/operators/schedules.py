"""Call-report schedules from rows of codes: (bank, period, mdrm, data_type, int_data, float_data, str_data).

A code is a prefix of four letters, which says whose figure it is, and four characters that
say what. A concept is read over its prefixes; a line that isn't filed is null, which is
not zero. A schedule is one grouping by report, whose aggregates are plain numbers: codes
are looked up in a small table of those that it wants, so a row is tested by a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes, codes of past-due loans by category (30 to 89 days, 90 and more, nonaccrual), their totals.
BALANCE = ["RCFD", "RCON"]
CAPITAL = ["RCFA", "RCOA", "RCFD", "RCON", "RCFW", "RCOW"]
INCOME = ["RIAD"]
STATUSES = ["pd30_89", "pd90_plus", "nonaccrual"]
PAST_DUE = {
    "construction": [["F172", "F173"], ["F174", "F175"], ["F176", "F177"]],
    "farmland": [["3493"], ["3494"], ["3495"]],
    "heloc": [["5398"], ["5399"], ["5400"]],
    "resi_1to4": [["C236", "C238"], ["C237", "C239"], ["C229", "C230"]],
    "multifamily": [["3499"], ["3500"], ["3501"]],
    "nonfarm_nonres": [["F178", "F179"], ["F180", "F181"], ["F182", "F183"]],
    "ci": [["1606"], ["1607"], ["1608"]],
    "agricultural": [["1594"], ["1597"], ["1583"]],
    "credit_cards": [["B575"], ["B576"], ["B577"]],
    "other_consumer": [["K213", "K216"], ["K214", "K217"], ["K215", "K218"]],
}
WITHIN_OTHER = ["agricultural"]  # filed as part of all other loans, so not taken off the total
TOTALS = ["1406", "1407", "1403"]
ON = ["bank", "period"]


def _value() -> Column:
    """The number of a row by its type; text, flags and NaN are none."""
    kind = F.lower("data_type")
    v = F.when(kind == "float", F.col("float_data")).when(kind == "int", F.col("int_data").cast("double"))
    return F.nanvl(v, F.lit(None).cast("double"))


def concepts(reports: DataFrame, prefixes: list[str], largest: bool = False) -> DataFrame:
    """(bank, period, code, value): of the prefixes that file a number the first, or with ``largest`` the larger figure.

    Consolidated figures hold the domestic ones, so balances take the larger; capital items
    can be negative, so they go by order. Codes are read in any case; of a code that is
    filed twice the first by value counts as one.
    """
    code = F.upper("mdrm")
    own = reports.select(*ON, F.substring(code, 1, 4).alias("prefix"), F.substring(code, 5, 8).alias("code"), _value().alias("value"))
    of = lambda p: F.when(F.col("prefix") == p, F.col("value"))
    best = F.max(F.when(F.col("prefix").isin(prefixes), F.col("value"))) if largest else F.coalesce(*(F.min(of(p)) for p in prefixes))
    return own.groupBy(*ON, "code").agg(best.alias("value")).where("value is not null")


def _wide(reports: DataFrame, prefixes: list[str], codes: list[str], largest: bool = False) -> DataFrame:
    """``concepts`` of some codes as one row a report, a column a code; a report that files none of them is left out."""
    places = 1 if largest else len(prefixes)
    wanted = [F.struct(F.lit(p + c).alias("wanted"), F.lit(k * places + j % places).alias("slot")) for k, c in enumerate(codes) for j, p in enumerate(prefixes)]
    slots = reports.sparkSession.range(1).select(F.explode(F.array(*wanted)).alias("w")).select("w.*")
    own = reports.select(*ON, F.upper("mdrm").alias("wanted"), _value().alias("value")).join(F.broadcast(slots), "wanted")
    best = F.max if largest else F.min
    filed = own.groupBy(*ON).agg(*(best(F.when(F.col("slot") == n, F.col("value"))).alias(f"_{n}") for n in range(len(codes) * places)))
    first = lambda k: F.coalesce(*(F.col(f"_{k * places + j}") for j in range(places)))
    out = filed.select(*ON, *(first(k).alias(c) for k, c in enumerate(codes)))
    return out.where(F.coalesce(*codes).isNotNull())


def past_due(reports: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Past-due loans of each report by category and status, long: bank, period, category, status, value (dollars), tied.

    A category sums the codes that are filed, null if none is. ``total`` is the filed total,
    ``other`` what it holds beyond the named categories (those WITHIN_OTHER aside); where
    that would be negative the mapping doesn't hold: ``other`` is null and ``tied`` false.
    Reports without any of the codes give nothing.
    """
    codes = [c for lists in PAST_DUE.values() for own in lists for c in own] + TOTALS
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = lambda own: F.when(F.coalesce(*own).isNotNull(), sum(map(zero, own[1:]), zero(own[0])))
    sums = {f"{c}_{s}": total(own) for c, lists in PAST_DUE.items() for s, own in zip(STATUSES, lists)} | {f"total_{s}": F.col(code) for s, code in zip(STATUSES, TOTALS)}
    wide = _wide(reports, BALANCE, codes, largest=True).select(*ON, *(x.alias(n) for n, x in sums.items()))
    named = [c for c in PAST_DUE if c not in WITHIN_OTHER]
    left = {f"other_{s}": sum((-zero(f"{c}_{s}") for c in named), F.col(f"total_{s}")) for s in STATUSES}
    wide = wide.select("*", *(x.alias(n) for n, x in left.items()))
    lines = [(c, s) for s in STATUSES for c in [*PAST_DUE, "total", "other"]]
    value = lambda c, s: F.when(F.col(f"other_{s}") >= 0, F.col(f"other_{s}")) if c == "other" else F.col(f"{c}_{s}")
    # values are one array of numbers, their names literals by place: a struct a line makes a method that the JVM doesn't compile
    each = wide.select(*ON, F.array(*(F.col(f"other_{s}") >= 0 for s in STATUSES)).alias("ties"), F.posexplode(F.array(*(value(*n) for n in lines))).alias("at", "v"))
    name = lambda k: F.get(F.array(*(F.lit(n[k]) for n in lines)), F.col("at"))
    at = F.get(F.array(*(F.lit(STATUSES.index(s) if c in ("total", "other") else None).cast("int") for c, s in lines)), F.col("at"))
    return each.select(*ON, name(0).alias("category"), name(1).alias("status"), (F.col("v") * scale).alias("value"), F.get("ties", at).alias("tied"))


def capital_lines(reports: DataFrame, lines: dict[str, str], derived: dict[str, list[tuple[int, str]]], residuals: dict[str, tuple[str, list[str]]], scale: float = 1000.0) -> DataFrame:
    """One row a report of its capital schedule in dollars: ``lines`` (name to code), ``derived`` (name to signed lines; null if none is filed), ``residuals`` (name to a line and those that it holds; null unless the line is filed)."""
    out = _wide(reports, CAPITAL, list(dict.fromkeys(lines.values()))).select(*ON, *((F.col(code) * scale).alias(name) for name, code in lines.items()))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    for name, terms in derived.items():
        filed = F.coalesce(*(F.col(n) for _, n in terms)).isNotNull()
        out = out.withColumn(name, F.when(filed, sum((zero(n) * s for s, n in terms), F.lit(0.0))))
    for name, (whole, parts) in residuals.items():
        out = out.withColumn(name, F.col(whole) - sum((zero(n) for n in parts), F.lit(0.0)))
    return out


def itemised(reports: DataFrame, lines: dict[str, str], written_in: list[str], scale: float = 1000.0) -> DataFrame:
    """Lines of an income schedule and the bank's own: bank, period, line, label, value, place; a written-in line is labelled by its filed text, else by its code, and is there only with an amount."""
    values = concepts(reports, INCOME).where(F.col("code").isin([*lines.values(), *written_in]))
    texts = reports.where(F.upper("mdrm").startswith("TEXT") & (F.trim("str_data") != "")).groupBy(*ON, F.substring(F.upper("mdrm"), 5, 8).alias("code")).agg(F.min(F.trim("str_data")).alias("text"))
    names = {code: (name, k) for k, (name, code) in enumerate(lines.items())} | {code: ("written_in", len(lines) + k) for k, code in enumerate(written_in)}
    of = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for code, n in names.items() for x in (code, n[i]))), F.col("code"))
    own = values.join(texts, [*ON, "code"], "left").withColumns({"line": of(0), "place": of(1)})
    label = F.when(F.col("line") == "written_in", F.coalesce("text", F.concat(F.lit("Write-in "), "code"))).otherwise(F.col("line"))
    return own.select(*ON, "line", label.alias("label"), (F.col("value") * scale).alias("value"), "place")

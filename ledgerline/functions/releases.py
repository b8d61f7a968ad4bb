"""Figures printed in releases and filings: periods of header cells, cells of tables, quotes, whose capital a fact is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of periods and cells, words of members.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ORDINALS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4}
SHORT_QUARTER = r"(?i)\b([1-4])Q\s?['’]?(\d{2}|\d{4})\b"
WORD_QUARTER = r"(?i)\b(first|1st|second|2nd|third|3rd|fourth|4th)\s+(?:quarter|qtr\.?),?\s+(\d{4})"
FULL_DATE = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})"
MONTH_YEAR = r"\b([A-Za-z]{3,9})\.?\s+(20\d{2})\b"
CELL_NUMBER = r"\(?\$?\s?(?:\d{1,3}(?:,\d{3})*\.?\d{0,4}|\.\d{1,4})\)?"
FOOTNOTE = r"^\(\d\)$"
ENTITY_AXES = ["ConsolidatedEntitiesAxis", "LegalEntityAxis", "RegulatoryCapitalRequirementsForBanksAxis"]
PARENT = r"(?i)Holding|Bancorp|Bancshares|Bankshares|Corporation|Incorporated|\bInc\b|Parent|Consolidated|Group|Financial"
BANK = r"(?i)Bank|NationalAssociation|\bNA\b|Subsidiar|Trust"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def period_end(cell: Column) -> Column:
    """The period of a header cell as a date: 1Q26, First Quarter 2026, a full date, or a quarter's last month and year; else null."""
    year = _part(cell, SHORT_QUARTER, 2).cast("int")
    short = _quarter_end(F.when(year < 100, year + 2000).otherwise(year), _part(cell, SHORT_QUARTER, 1).cast("int"))
    ordinal = F.lower(_part(cell, WORD_QUARTER, 1))
    q = F.lit(None).cast("int")
    for word, n in ORDINALS.items():
        q = F.when(ordinal == word, n).otherwise(q)
    worded = _quarter_end(_part(cell, WORD_QUARTER, 2).cast("int"), q)

    def month(pattern: str) -> Column:
        return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(_part(cell, pattern, 1), 1, 3))), F.lit(0).cast("long")).cast("int")

    day = F.concat_ws("-", _part(cell, FULL_DATE, 3), F.lpad(month(FULL_DATE).cast("string"), 2, "0"), F.lpad(_part(cell, FULL_DATE, 2), 2, "0"))
    dated = F.when(month(FULL_DATE).isNotNull(), F.try_to_date(day, "yyyy-MM-dd"))
    m = month(MONTH_YEAR)
    monthly = F.when(m % 3 == 0, F.last_day(F.make_date(_part(cell, MONTH_YEAR, 2).cast("int"), m, F.lit(1))))
    # a full date that is none isn't read as month and year
    return F.coalesce(short, worded, F.when(month(FULL_DATE).isNotNull(), dated).otherwise(monthly))


def table_rows(html: Column) -> Column:
    """Rows of a page's tables as arrays of cell texts, tags stripped and white space collapsed."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    tidy = lambda c: F.trim(F.regexp_replace(F.replace(F.replace(F.regexp_replace(c, "(?s)<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), "[\\s \u200b\u200c\ufeff]+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), tidy))


def row_values(cells: Column) -> Column:
    """Numbers of a row behind its label: footnote marks and bare signs go, a decimal in parentheses is negative."""
    rest = F.filter(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda c: (c != "") & ~c.rlike(FOOTNOTE) & ~c.isin("%", "$"))
    found = F.flatten(F.transform(rest, lambda c: F.regexp_extract_all(c, F.lit(CELL_NUMBER), F.lit(0))))
    kept = F.filter(found, lambda x: ~x.rlike(FOOTNOTE))
    bare = lambda x: F.regexp_replace(x, r"[(),$\s]", "").try_cast("double")
    return F.transform(kept, lambda x: F.when(x.startswith("(") & x.contains("."), -bare(x)).otherwise(bare(x)))


def number_in_quote(quote: Column, value: Column) -> Column:
    """Whether a quote prints a value with two, one or no decimals (only where that is within 0.006 of it); a point-first form doesn't end a longer number."""
    size = F.abs(value)
    out = F.lit(False)
    for digits in (2, 1, 0):
        form = F.format_number(size, digits)
        near = F.abs(F.replace(form, F.lit(","), F.lit("")).cast("double") - size) < 0.006
        sign = F.when(value < 0, F.contains(quote, F.concat(F.lit("-"), form)) | F.contains(quote, F.concat(F.lit("("), form, F.lit(")")))).otherwise(F.contains(quote, form))
        pointed = F.substring(form, 2, 9)
        shown = F.filter(F.regexp_extract_all(quote, F.lit(r"(?<![\d.])\.\d+"), F.lit(0)), lambda x: x.startswith(pointed))
        first = (value >= 0) & form.startswith("0.") & (F.size(shown) > 0)
        out = out | (near & (sign | first))
    return F.coalesce(out, F.lit(False))


def entity_basis(dims: Column) -> Column:
    """Struct of basis (holdco or bank) and confidence (default, parent, fuzzy; null for a bank) from a fact's dimensions; the first entity axis counts."""
    local = lambda x: F.regexp_replace(x, "^.*:", "")
    own = F.filter(F.map_entries(dims), lambda e: local(e["key"]).isin(ENTITY_AXES))
    member = local(F.try_element_at(own, F.lit(1)).value)
    basis = F.when(member.isNull() | member.rlike(PARENT) | ~member.rlike(BANK), "holdco").otherwise("bank")
    confidence = F.when(member.isNull(), "default").when(member.rlike(PARENT), "parent").when(~member.rlike(BANK), "fuzzy")
    return F.struct(basis.alias("basis"), confidence.alias("confidence"))

"""Claims about a text that must be proven by it: a quote that is there, and a figure that the quote prints.

A claim names a source, a key, a period, a value and a quote. Nothing is trusted in part:
the first guard that a claim fails is its status, and claims of one key and period that
differ refuse each other. Quotes are found word for word, whatever stands between the
words, and their place in the source as it is written is given. The claims of a source meet
its text once, as one row, so that a long text isn't carried for each claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.releases import number_in_quote

FEWEST, MOST = 3, 60  # words of a quote
AGREE = 0.011
# Words of variants and of parts of a company.
VARIANTS = r"(?i)\b(?:adjusted|core|operating|normalized|underlying|pro forma|excluding)\b"
SEGMENTS = r"(?i)\bsegments?\b|\bbusiness line\b"


def words(quote: Column) -> Column:
    """The words of a quote: runs of letters and digits."""
    return F.filter(F.split(quote, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pattern(quote: Column) -> Column:
    """A pattern of the quote's words with anything but letters and digits between, in any case; no word goes on before or behind."""
    body = F.array_join(words(quote), r"[^\p{L}\p{N}]+")
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), body, F.lit(r"(?![\p{L}\p{N}])"))


def _placed(text: Column, p: Column) -> Column:
    """Struct of start (from 1) and length of a pattern's first match, null without one. The text is searched once: what stands before and behind tells both."""
    of = lambda a: F.struct((F.char_length(F.get(a, F.lit(0))) + 1).alias("start"), (F.char_length(text) - F.char_length(F.get(a, F.lit(0))) - F.char_length(F.get(a, F.lit(1)))).alias("length"))
    return F.get(F.transform(F.array(F.split(text, p, 2)), lambda a: F.when(F.size(a) == 2, of(a))), F.lit(0))


def located(text: Column, quote: Column) -> Column:
    """Struct of start (from 1) and length of a quote in a text as it is written; null where it isn't there or has no words."""
    return F.when(F.size(words(quote)) > 0, _placed(text, pattern(quote)))


def judged(sources: DataFrame, claims: DataFrame, source: str, text: str, bounds: dict[str, tuple[float, float, str]]) -> DataFrame:
    """Each claim with what the guards say: source, claim, key, period, value, start, length, status.

    ``claims``: source, claim (unique), key, period, value, quote. ``bounds``: key to least,
    most and a pattern that the quote's words must have. status, the first that holds: ``unknown``
    (key), ``range``, ``quote`` (fewer than FEWEST or more than MOST words), ``absent`` (not
    in the source, or no source), ``number`` (the quote doesn't print the value), ``label``,
    ``variant`` (adjusted and the like, or a segment's), ``conflict`` (another claim that
    passed has the key and period with a value more than AGREE away), ``kept``.
    """
    per = claims.groupBy(source).agg(F.collect_list(F.struct("claim", "key", "period", "value", "quote")).alias("_c"))
    own = per.join(sources.select(source, F.col(text).alias("_text")).dropDuplicates([source]).hint("merge"), source, "left")
    # a quote of several claims is searched once, and the text is left behind before claims are rows
    own = own.withColumn("_q", F.array_distinct(F.transform("_c", lambda c: c.quote)))
    own = own.select(source, "_c", "_q", F.transform("_q", lambda q: located(F.col("_text"), q)).alias("_at"))
    quoted = own.select(source, F.explode("_c").alias("c"), "_q", "_at")
    rows = quoted.select(source, "c.*", F.get("_at", F.array_position("_q", F.col("c.quote")).cast("int") - 1).alias("at"))
    n, spoken = F.size(words(F.col("quote"))), F.array_join(words(F.col("quote")), " ")
    known, fits, named = F.lit(False), F.lit(False), F.lit(False)
    for key, (low, high, label) in bounds.items():
        mine = F.col("key") == key
        known, fits, named = known | mine, fits | (mine & F.col("value").between(low, high)), named | (mine & spoken.rlike(f"(?i){label}"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    first = (
        F.when(no(known), "unknown").when(no(fits), "range").when(no(n.between(FEWEST, MOST)), "quote").when(F.col("at").isNull(), "absent").when(no(number_in_quote(F.col("quote"), F.col("value"))), "number")
        .when(no(named), "label").when(spoken.rlike(VARIANTS) | spoken.rlike(SEGMENTS), "variant")
    )
    rows = rows.withColumn("_first", first)
    w = Window.partitionBy(source, "key", "period")
    passed = F.when(F.col("_first").isNull(), F.col("value"))
    apart = F.max(passed).over(w) - F.min(passed).over(w) > AGREE
    status = F.coalesce("_first", F.when(apart, "conflict").otherwise("kept"))
    return rows.withColumn("status", status).select(source, "claim", "key", "period", "value", "at.start", "at.length", "status")


def settled(judged: DataFrame, source: str) -> DataFrame:
    """One figure a source, key and period of the claims that were kept: the first by claim."""
    kept = judged.where("status = 'kept'")
    return kept.groupBy(source, "key", "period").agg(F.min_by("value", "claim").alias("value"), F.count("*").alias("claims"))

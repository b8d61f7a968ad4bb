"""Companies named in headlines: word runs meet a table of names in equi-joins, so neither side has to be small.

Headlines are short; a row becomes at most ``longest`` runs a word. A null or empty headline names nobody.
A few names and words stand in most headlines, so rows of one name are dealt over SALTS
tasks, each with its copy of the names. The names' side is hashed: it is the smaller by
far, whatever the files say, and the runs need no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
# Word lists and patterns of names.
SUFFIXES = "INC INCORPORATED CORP CORPORATION BANCORPORATION CO LTD LLC LP LLP NA HOLDINGS HOLDING GROUP COMPANY & AND".split()
COMMON = (
    "FREEDOM POPULAR CITIZENS INDEPENDENT COMMERCE COMMUNITY HERITAGE PEOPLES PREMIER PROSPERITY PACIFIC COLUMBIA "
    "CENTRAL LIBERTY PROVIDENT GENESIS SUMMIT PINNACLE BUSINESS AMERICAN SOUTHERN NORTHERN HORIZON ALLIANCE CAPITAL "
    "PARTNERS PROGRESS PREFERRED EQUITY GUARANTY HOMETOWN PATRIOT SERVICE SELECT MERIDIAN"
).split()
TRAPS = {
    "UNITED": "STATES KINGDOM ARAB NATIONS AIRLINES AIRWAYS HEALTHCARE HEALTH PARCEL METHODIST WAY TECHNOLOGIES RENTALS NATURAL".split(),
    "BANNER": "CAPITAL HEALTH HEALTHCARE ENGINEERING LIFE INDUSTRIAL SOLAR".split(),
}
STATE_MARK = r"/[A-Z]{2,3}/?$"
EXCHANGE = r"(?:NYSE\s*AMERICAN|NYSE|NASDAQ|AMEX|OTCQX|OTCQB|OTCMKTS|OTC|CBOE|BATS|ARCA)"


def normalised(name: Column) -> Column:
    """Upper case, without a state mark, punctuation (& stays) and trailing legal words."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.upper(name)), STATE_MARK, ""), r"[^\w\s&]", " ")
    ending = "|".join(SUFFIXES)
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), rf"(?:(?:^|\s)(?:{ending}))+$", ""))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " ")), F.lit(" "))


def _runs(headlines: DataFrame, key: str, text: str, context: str, longest: int) -> DataFrame:
    """Runs of up to ``longest`` words, each with its place, the words around it and the whole texts."""
    words = headlines.select(key, F.split(normalised(F.col(text)), " ").alias("w"), F.concat_ws(" ", text, context).alias("all"))
    at = words.where(F.size("w") > 0).select(key, "w", "all", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    long = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("i") + 1))
    runs = at.select(key, "w", "all", "i", F.explode(long).alias("n"))
    word = lambda k: F.when(k > 0, F.try_element_at("w", F.greatest(k, F.lit(1))))
    return runs.select(key, "all", "i", "n", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("name"), word(F.col("i") - 1).alias("before"), word(F.col("i") + F.col("n")).alias("after"))


def _met(rows: DataFrame, names: DataFrame, on: list[str], key: str, how: str = "inner") -> DataFrame:
    """Rows joined to a table of names, rows of one name dealt over SALTS tasks by their key."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    copies = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies.hint("shuffle_hash"), [*on, "salt"], how).drop("salt")


def _first_real(runs: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The first occurrence of each name (name, ticker, shared) that isn't part of a larger proper noun.

    ``kind`` repeats shared as an aggregate: a filter on it stays above the grouping, which is then done once for both kinds.
    """
    trapped = F.lit(False)
    for word, following in TRAPS.items():
        trapped = trapped | ((F.col("last") == word) & F.coalesce(F.col("after").isin(following), F.lit(False)))
    # the last word is the name's column, so that it is cut from names and not from every run
    met = _met(runs, names.withColumn("last", F.regexp_extract("name", r"(\S+)$", 1)), ["name"], key).where(~trapped)
    rest = [c for c in met.columns if c not in (key, "name", "ticker", "shared", "last")]
    return met.groupBy(key, "name", "ticker", "shared").agg(F.min(F.struct("i", *[c for c in rest if c != "i"])).alias("o"), F.max("shared").alias("kind")).select(key, "name", "ticker", "kind", "o.*")


def subjects(headlines: DataFrame, key: str, text: str, context: str, names: DataFrame, ambiguous: DataFrame, longest: int = 6) -> DataFrame:
    """Companies a headline names: key, ticker.

    ``names`` has (name, ticker), each name once, ``ambiguous`` (name, ticker, cues), both
    normalised. Longer names go first (ties by name); one that overlaps or touches a taken
    one is none. Nor is one whose preceding word begins a longer name of the table, or a
    single word that is common or of at most four letters, unless a legal word follows or
    headline and context print its ticker behind an exchange. A name of several companies
    names the one with the single best score: 2 for its ticker as a word, 1 for each cue.
    """
    runs = _runs(headlines, key, text, context, longest)
    both = names.select("name", "ticker", F.lit(False).alias("shared")).unionByName(ambiguous.select("name", "ticker", F.lit(True).alias("shared")))
    met = _first_real(runs, both, key)
    seen = met.where(~F.col("kind"))
    leading = names.where(F.col("name").contains(" ")).select(F.regexp_extract("name", r"^(\S+)", 1).alias("before")).distinct()
    free = _met(seen, leading, ["before"], key, "left_anti")
    risky = ~F.col("name").contains(" ") & (F.col("name").isin(COMMON) | (F.length("name") <= 4))
    listed = F.regexp_extract_all(F.upper("all"), F.lit(EXCHANGE + r"\s*:?\s*([A-Z][A-Z0-9.]*)\b"), F.lit(1))
    sure = F.coalesce(F.col("after").isin(SUFFIXES), F.lit(False)) | F.array_contains(listed, F.upper("ticker"))
    good = free.where(~risky | sure)
    spans = good.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("o"), "name", "ticker", "i", (F.col("i") + F.col("n")).alias("e")))).alias("s"))
    none = F.filter("s", lambda x: F.lit(False))
    taken = F.reduce("s", none, lambda kept, x: F.when(F.exists(kept, lambda k: (k["i"] <= x["e"]) & (x["i"] <= k["e"])), kept).otherwise(F.concat(kept, F.array(x))))
    plain = spans.select(key, F.explode(taken).alias("s")).select(key, "s.ticker")

    hay = _padded(F.col("all"))
    word = lambda w: hay.contains(F.concat(F.lit(" "), F.upper(w), F.lit(" ")))
    shared = _met(met.where("kind"), ambiguous, ["name", "ticker"], key)
    scored = shared.select(key, "name", "ticker", (F.when(word(F.col("ticker")), 2).otherwise(0) + F.size(F.filter(F.coalesce("cues", F.array().cast("array<string>")), word))).alias("score")).where("score > 0")
    best = scored.groupBy(key, "name").agg(F.max("score").alias("top"), F.collect_list(F.struct("score", "ticker")).alias("c"))
    first = F.filter("c", lambda x: x["score"] == F.col("top"))
    told = best.where(F.size(first) == 1).select(key, F.try_element_at(first, F.lit(1)).ticker.alias("ticker"))
    return plain.unionByName(told).distinct()

"""Deals and offerings found in the prose of filings: values, exchange ratios, kinds of prospectus, states of a deal.

Everything is strict: a figure that is stated twice with different amounts is null, never
a guess. Texts are plain (tags stripped); a null text gives nulls. All of it is
expressions and keyed aggregates; stock values come by as-of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.binding import once
from ledgerline.sources.workspace import written

from . import asof

# Word lists and patterns of the filings' phrasings.
GENERIC = (
    "bank banks bancorp bancshares banc banco financial holdings holding group corporation corp company co "
    "incorporated inc trust savings loan association national federal state first community citizens "
    "united american pacific valley the of and new"
).split()
VALUED = ["valued at", "aggregate value of", "aggregate transaction value of", "total transaction value of", "total deal value of", "purchase price of", "aggregate consideration of"]
ROUGHLY = ["us", "approximately", "about"]  # from the amount backwards
EXCHANGES = ["NYSE", "NASDAQ", "AMERICAN"]
ANNOUNCED = [
    "definitive agreement", "definitive merger agreement", "signed a definitive", "agreement and plan of merger", "agreement and plan of reorganization", "agreed to acquire", "agreed to merge", "agreed to be acquired",
    "agreement to acquire", "agreement to merge", "agreement to be acquired", "agreed to combine", "will acquire", "to be acquired by",
]
COMPLETED = [f"{w} completed" for w in ("has", "have", "had", "today", "successfully")] + [f"{w} the completion" for w in ("announce", "announces", "announced")]
COMPLETED += [f"completed {w} {what}" for w in ("its", "the") for what in ("previously announced", "acquisition", "merger", "purchase", "combination")]
TERMINATED = ["terminate", "terminated", "terminating", "termination"]
MERGER_COVER = ["agreement and plan of merger", "proxy statement prospectus", "proxy statement and prospectus", "merger of", "to be voted"]
PRELIMINARY = ["subject to completion"]
RESALE = ["will not receive any proceeds", "will not receive any of proceeds", "will not receive any of the proceeds"]
DEBTS = [f"{rank} {what}" for rank in ("subordinated", "senior") for what in ("notes", "debentures")]
EQUITIES = ["depositary shares", "common stock"] + [f"{first}preferred stock" for first in ("non-cumulative perpetual ", "noncumulative perpetual ", "non-cumulative ", "noncumulative ", "perpetual ", "")]
ANNOUNCING_ITEMS = ["1.01", "7.01", "8.01"]
PRICE_AGE, SHARES_AGE = 10, 200  # days


#: Letters that are looked at before an amount, and after a word that announces one.
NEAR = 80


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _plain(text: Column) -> Column:
    """Lower-case words between single spaces, a space at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def _says(text: Column, phrases: list[str]) -> Column:
    """Whether a text has one of the phrases, word for word."""
    return once(_plain(text), lambda words: _holds(words, phrases))


def _holds(words: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(words, F.lit(f" {p} "))
    return found


def _ends(words: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.endswith(words, F.lit(f" {p} "))
    return found


def _only(values: Column) -> Column:
    """The one distinct value of an array, null where there are none or several."""
    return once(F.array_distinct(F.array_compact(values)), lambda d: F.when(F.size(d) == 1, F.try_element_at(d, F.lit(1))))


def money(text: Column) -> Column:
    """The dollar amounts of a text in order: array of before (words since the amount before, NEAR letters at most), amount, unit (million, billion or empty), after (words that follow)."""
    figure, unit = r"^\s?(\d[\d,]*(?:\.\d+)?)", r"^\s?\d[\d,]*(?:\.\d+)?\s*(million|billion)\b"

    def one(last: Column, own: Column) -> Column:
        number, word = F.regexp_extract(own, figure, 1), F.regexp_extract(F.lower(own), unit, 1)
        rest = F.regexp_replace(own, r"(?i)^\s?\d[\d,]*(?:\.\d+)?\s*(?:million\b|billion\b)?", "")
        tail = F.right(last, F.lit(NEAR))
        return F.struct(_plain(F.regexp_replace(tail, r"^.*\.\s", "")).alias("before"), F.replace(number, F.lit(","), F.lit("")).try_cast("double").alias("amount"), word.alias("unit"), _plain(F.left(rest, F.lit(NEAR))).alias("after"), (F.trim(tail) == F.regexp_extract(F.trim(tail), figure, 1)).alias("next"))

    none = F.array().cast("array<struct<before:string,amount:double,unit:string,after:string,next:boolean>>")
    every = once(F.split(text, r"\$"), lambda parts: F.when(F.size(parts) > 1, _neighbours(parts, one)).otherwise(none))
    return F.filter(every, lambda m: m.amount.isNotNull())


def _neighbours(parts: Column, one) -> Column:
    """``one(part, next)`` of each part but the last of two parts or more."""
    return F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), one)


def stated_value(text: Column) -> Column:
    """The deal's value in dollars from phrases that state one, in millions or billions; several amounts give null.

    A phrase of VALUED stands right before the amount, words of ROUGHLY aside, or "in the
    aggregate" right after it.
    """
    def valued(m: Column) -> Column:
        def bare(words: Column, rest: list[str]) -> Column:
            if not rest:
                return _ends(words, VALUED)
            size = len(rest[0]) + 1
            return once(F.when(F.endswith(words, F.lit(f" {rest[0]} ")), F.left(words, F.length(words) - size)).otherwise(words), lambda w: bare(w, rest[1:]))

        return (m.unit != "") & (bare(m.before, ROUGHLY) | m.after.startswith(" in the aggregate ") | m.after.startswith(" in aggregate "))

    dollars = lambda m: (m.amount * F.when(m.unit == "billion", 1e9).otherwise(1e6)).cast("long")
    return F.when(text.isNotNull(), _only(F.transform(F.filter(money(text), valued), dollars)))


def _name(text: Column) -> Column:
    """A company's name at the start of a text that goes on with its stock or shares: what stands before, empty if no capital begins it."""
    own = F.regexp_replace(_tidy(text), r"^(?:of a share of|shares? of) ", "")
    return F.trim(F.regexp_extract(own, r"^([A-Z].*?) (?:common stock|stock|shares?)\b", 1))


def exchange_ratio(text: Column) -> Column:
    """Struct of ratio, acquirer and target from sentences on the exchange of shares; the first if all have one ratio, else null.

    Either shares are received ``for each`` share: the ratio and the acquirer stand before
    these words and the target behind; or ``each share of`` the target is converted into
    the ratio in shares of the acquirer.
    """
    number, side = r"^(\d{1,2}(?:\.\d{1,4})?) ", "struct<ratio:double,acquirer:string,target:string>"

    def told(offer: Column, target: Column) -> Column:
        ratio = F.nullif(F.regexp_extract(offer, number, 1), F.lit("")).cast("double")
        acquirer = _name(F.regexp_replace(offer, number, ""))
        whole = lambda z: z.ratio.isNotNull() & (z.acquirer != "") & (z.target != "") & (F.length(z.acquirer) <= 62) & (F.length(z.target) <= 62)
        return once(F.struct(ratio.alias("ratio"), acquirer.alias("acquirer"), target.alias("target")), lambda z: F.when(whole(z), z))

    def received(piece: Column) -> Column:
        return once(F.split(F.left(piece, F.lit(4 * NEAR)), " for each ", 2), lambda halves: F.when(F.size(halves) == 2, told(F.get(halves, F.lit(0)), _name(F.get(halves, F.lit(1))))))

    def converted(piece: Column) -> Column:
        def read(halves: Column) -> Column:
            name, offer = F.get(halves, F.lit(0)), F.get(halves, F.lit(1))
            owned = F.regexp_extract(name, r"^([A-Z].*?) (?:common )?stock (?:will be|shall be|is)$", 1)
            return F.when(F.size(halves) == 2, told(F.regexp_replace(offer, "^the right to receive ", ""), F.trim(owned)))

        return once(F.split(F.left(piece, F.lit(4 * NEAR)), " converted into ", 2), read)

    def offers(tidy: Column) -> Column:
        behind = lambda word: F.slice(F.split(tidy, word), 2, 1 << 20)
        return F.array_compact(F.concat(F.transform(behind(r"\breceive "), received), F.transform(behind(r"\b[Ee]ach share of "), converted)).cast(f"array<{side}>"))

    return once(once(_tidy(text), offers), lambda every: F.when(F.size(F.array_distinct(F.transform(every, lambda z: z.ratio))) == 1, F.try_element_at(every, F.lit(1))))


def brand(name: Column) -> Column:
    """The first distinctive word of a company's name, lower case, null where all are generic."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9&']+"), F.lit(0))
    return F.try_element_at(F.filter(words, lambda w: ~w.isin(GENERIC) & (F.length(w) >= 2)), F.lit(1))


def listed_ticker(text: Column, side: Column) -> Column:
    """The ticker printed in parentheses beside the name that holds the side's brand as a word; null where none or several do."""
    def one(last: Column, own: Column) -> Column:
        def read(inside: Column) -> Column:
            halves = F.split(F.get(inside, F.lit(0)), ":", 2)
            market, ticker = F.upper(F.regexp_extract(F.trim(F.get(halves, F.lit(0))), r"(\w+)$", 1)), F.trim(F.get(halves, F.lit(1)))
            name = F.element_at(F.split(F.right(last, F.lit(NEAR)), r"[();]"), -1)
            return F.when((F.size(inside) == 2) & market.isin(EXCHANGES) & ticker.rlike("^[A-Z]{1,6}$"), F.struct(F.split(F.lower(name), "[^a-z0-9&']+").alias("words"), ticker.alias("ticker")))

        return once(F.split(own, r"\)", 2), read)

    pairs = once(F.split(text, r"\("), lambda parts: F.when(F.size(parts) > 1, F.array_compact(_neighbours(parts, one))))
    named = lambda b: F.filter(pairs, lambda p: F.array_contains(p["words"], b))
    return once(brand(side), lambda b: F.when(b.isNotNull(), _only(F.transform(named(b), lambda p: p["ticker"]))))


def deal_state(text: Column) -> Column:
    """completed, terminated, announced, or null; completion is told from boilerplate on the future closing by its tense."""
    return once(_plain(text), lambda words: F.when(_holds(words, COMPLETED), "completed").when(_holds(words, TERMINATED), "terminated").when(_holds(words, ANNOUNCED), "announced"))


def merger_groups(df: DataFrame, filing: str, filed: str, items: str, kind: str, document: str) -> DataFrame:
    """One row a filing with merger phrases: filing, filed, document (an exhibit 99 first, else the smallest), side.

    Items of all its documents count: 1.02 makes it a termination; else 1.01, 7.01 or 8.01
    an announcement; others go, and so do rows without filing or date.
    """
    exhibit = F.coalesce(F.upper(F.col(kind)).startswith("EX-99"), F.lit(False))
    has = lambda codes: F.max(F.coalesce(F.arrays_overlap(items, F.array(*map(F.lit, codes))), F.lit(False)))
    g = df.where(F.col(filing).isNotNull() & F.col(filed).isNotNull()).groupBy(filing).agg(
        F.min(filed).alias(filed), F.min(F.struct((~exhibit).alias("_rest"), F.col(document).alias("d"))).alias("_d"), has(["1.02"]).alias("_ended"), has(ANNOUNCING_ITEMS).alias("_said"),
    )
    side = F.when(F.col("_ended"), "termination").when(F.col("_said"), "announcement")
    return g.select(filing, filed, F.col("_d.d").alias(document), side.alias("side")).where("side is not null")


def stock_values(deals: DataFrame, text: str, announced: str, shares: DataFrame, closes: DataFrame) -> DataFrame:
    """Deals with the value their exchange ratio gives: ratio, acquirer and target (tickers), value_usd.

    ratio x acquirer's last close before the day (at most 10 days old) x target's shares as
    of the day (at most 200 days old). ``shares`` has (ticker, d, shares), ``closes`` (ticker, d, close).
    Null where a side has no single ticker, both have the same, or a figure is missing or stale.
    """
    r = deals.withColumn("_x", exchange_ratio(F.col(text)))
    r = r.withColumns({"acquirer": listed_ticker(F.col(text), F.col("_x.acquirer")), "target": listed_ticker(F.col(text), F.col("_x.target"))})
    sure = F.col("acquirer") != F.col("target")
    r = r.withColumns({"ratio": F.col("_x.ratio"), "acquirer": F.when(sure, F.col("acquirer")), "target": F.when(sure, F.col("target"))}).drop("_x")
    r = written(r, "ratios")  # texts are read once, for the days and for the deals
    priced = asof.backward_repeated(r.withColumns({"ticker": F.col("acquirer"), "d": F.date_sub(F.to_date(announced), 1)}), closes.select("ticker", "d", "close"), "ticker", "d")
    priced = priced.withColumn("_price", F.when(F.datediff(F.to_date(announced), "fact_at") <= PRICE_AGE, F.col("close"))).drop("fact_at", "close", "ticker", "d")
    counted = asof.backward_repeated(priced.withColumns({"ticker": F.col("target"), "d": F.to_date(announced)}), shares.select("ticker", "d", "shares"), "ticker", "d")
    fresh = F.when(F.datediff("d", "fact_at") <= SHARES_AGE, F.col("shares"))
    return counted.withColumn("value_usd", F.round(fresh * F.col("ratio") * F.col("_price")).cast("long")).drop("_price", "fact_at", "shares", "ticker", "d")


def _first_phrase(text: Column, phrases: list[str]) -> Column:
    """Where the first of the phrases stands in a lower-case text, and which: struct of at (from 1) and phrase; of those at one place the longest."""
    found = F.array(*(F.when(F.instr(text, p) > 0, F.struct(F.instr(text, p).alias("at"), F.lit(-len(p)).alias("size"), F.lit(p).alias("phrase"))) for p in phrases))
    return F.array_min(F.array_compact(found))


def debt_security(cover: Column) -> Column:
    """The debt that a cover names first, as printed: with its rate and kind of interest before and its year after; null without any."""
    def named(tidy: Column, hit: Column) -> Column:
        before, core = F.left(tidy, hit.at - 1), F.substr(tidy, hit.at, -hit["size"])
        due = F.regexp_extract(F.substr(tidy, hit.at - hit["size"]), r"(?i)^( due \d{4})", 1)
        kind = F.regexp_extract(before, r"(?i)(fixed[- ]to[- ]floating (?:rate )?)$", 1)
        rate = F.regexp_extract(F.left(before, F.length(before) - F.length(kind)), r"(\d+\.\d+% )$", 1)
        return F.when(hit.isNotNull(), F.concat(rate, kind, core, due))

    return once(_tidy(cover), lambda tidy: once(_first_phrase(F.lower(tidy), DEBTS), lambda hit: named(tidy, hit)))


def equity_security(cover: Column) -> Column:
    """The equity that a cover names first, as a title; null without any."""
    return once(F.lower(_tidy(cover)), lambda text: F.initcap(_first_phrase(text, EQUITIES).phrase))


def prospectus(cover: Column) -> Column:
    """Struct of kind, security, gross_usd and price_per_share of a prospectus cover; what isn't plainly stated is null.

    Gross of debt is an amount called principal; of equity the total in a table of the
    offering price, or shares offered times the price they are offered at.
    """
    parts = F.struct(money(cover).alias("amounts"), debt_security(cover).alias("debt"), equity_security(cover).alias("equity"))
    return once(parts, lambda x: _prospectus(cover, x.amounts, x.debt, x.equity))


def _prospectus(cover: Column, amounts: Column, debt: Column, equity: Column) -> Column:
    first = lambda cond: F.try_element_at(F.filter(amounts, cond), F.lit(1)).amount
    principal = first(lambda m: m.after.startswith(" principal amount ") | m.after.startswith(" aggregate principal amount "))
    pairs = F.zip_with(amounts, F.slice(amounts, 2, 1 << 20), lambda m, n: F.when(n["next"] & _ends(m.before, ["public offering price", "price to public", "price to the public"]), F.struct(m.amount.alias("each"), n.amount.alias("total"))))
    priced = F.try_element_at(F.array_compact(pairs), F.lit(1))
    table = (priced.each > 0) & (priced.total > priced.each * 1000)
    price = first(lambda m: _ends(m.before, ["at a price of", "at a public offering price of"]))
    count = F.replace(F.regexp_extract(_tidy(cover), r"(?i)offering (?:of )?(\d[\d,]{4,}) shares", 1), F.lit(","), F.lit("")).try_cast("double")
    plain = (price > 0) & (count > 0)

    def told(kind: str, security: Column | None = None, gross: Column | None = None, share: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"), (none if security is None else security).cast("string").alias("security"),
            (none if gross is None else gross).cast("long").alias("gross_usd"), (none if share is None else share).cast("double").alias("price_per_share"),
        )

    offered = told("ECM", equity, F.when(table, priced.total).when(plain, price * count), F.when(table, priced.each).when(plain, price))
    return F.when(cover.isNotNull(), F.when(_says(cover, MERGER_COVER), told("Merger prospectus")).when(_says(cover, PRELIMINARY), told("Preliminary"))
        .when(_says(cover, RESALE), told("Resale (selling holder)", F.coalesce(equity, F.initcap(debt))))
        .when(debt.isNotNull(), told("DCM", debt, F.when(principal > 100_000, principal))).when(equity.isNotNull(), offered).otherwise(told("Unclassified")))


def placement_gross(text: Column) -> Column:
    """Gross of a private placement above 500,000 dollars: amounts after words of sale in their sentence, with no other amount between; several give null."""
    sale = lambda m: F.contains(m.before, F.lit(" gross proceeds of ")) | F.contains(m.before, F.lit(" sold ")) | F.contains(m.before, F.lit(" issued "))
    dollars = F.transform(F.filter(money(text), lambda m: sale(m) & (m.unit != "billion")), lambda m: m.amount * F.when(m.unit == "million", 1e6).otherwise(1.0))
    return _only(F.transform(F.filter(dollars, lambda x: x > 500_000), lambda x: x.cast("long")))

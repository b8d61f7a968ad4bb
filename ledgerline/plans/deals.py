"""Deals and offerings in prose, and filed XML documents; texts are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import deals as D
from ledgerline.sources import forms

from .base import Tables, query, spread
from .rules import _chosen, _pick

#: Announcements; {n} is a number of the row, {r} a ratio.
ANNOUNCEMENTS = [
    "Alpha Bank Corp (NASDAQ: ALFA) and Beta Bancorp (NYSE: BETA) signed a definitive agreement. Holders receive {r} shares of Alpha common stock for each share of Beta common stock in a transaction valued at approximately ${n}.5 million.",
    "Gamma has completed its acquisition of Delta for an aggregate consideration of $1.25 billion, or $1.25 billion in aggregate.",
    "Upon completion of the merger each share of Beta common stock will be converted into the right to receive {r} shares of Alpha common stock. Alpha Bank Corp (NASDAQ: ALFA), Beta Bancorp (NYSE American: BETA) agreed to merge.",
    "Alpha Bank terminated the merger valued at ${n} million, below a purchase price of $77 million.",
    "Epsilon opens a branch and pays a fee of ${n} million.",
    "Holders receive {r} Alpha shares for each Beta share, or receive 9.75 Alpha shares for each Beta share. To be acquired by Alpha Bank (NASDAQ: ALFA).",
    "",
]
VALUES = ["n500", "1250000000", None, None, None, None, None]
COVERS = [
    "$100,000,000 aggregate principal amount 4.25% fixed-to-floating rate subordinated notes due 2030",
    "Common  Stock. Public offering price $ 2.00 $ 150,000,000", "We are offering 75,000 shares of preferred stock at a price of $10.50", "This proxy statement/prospectus", "Subject to completion. Senior notes",
    "We will not receive any of the proceeds from the sale of the depositary shares", "An offer of warrants", "5,000 senior notes and $50,000 principal amount", "",
]
COVER_KINDS = ["DCM", "ECM", "ECM", "Merger prospectus", "Preliminary", "Resale (selling holder)", "Unclassified", "DCM", "Unclassified"]
COVER_SECURITIES = ["4.25% fixed-to-floating rate subordinated notes due 2030", "Common Stock", "Preferred Stock", "", "", "Depositary Shares", "", "senior notes", ""]
COVER_GROSS = ["100000000", "150000000", "787500", "", "", "", "", "", ""]
COVER_PRICES = ["", "2", "10.5", "", "", "", "", "", ""]
PLACEMENTS = ["The company sold notes for $25 million.", "It issued 5 shares for $2.50 and sold $600,000 of notes.", "Gross proceeds of $1,000,000. It sold $2 million.", "It sold $400,000 of notes.", "Nothing."]
PLACED = ["25000000", "600000", "", "", ""]
NAMES = ["First Umpqua Bank", "TD Bank Group", "First National Bank", "U.S. Bancorp", "The Bank of New Amsterdam", "", "a b Columbia"]
BRANDS = ["umpqua", "td", "", "", "amsterdam", "", "columbia"]


def _announcement(key: str):
    text = F.replace(_pick(ANNOUNCEMENTS, key), F.lit("{n}"), (F.col(key) % 90 + 10).cast("string"))
    return F.replace(text, F.lit("{r}"), F.concat(F.lit("0."), (F.col(key) % 90 + 10).cast("string")))


SQL_RATIO = "CASE WHEN k % 7 IN (0, 2) THEN (k % 90 + 10) / 100e0 END"
SQL_NUMBER = "(k % 90 + 10)"


@query("deal_stated_value", f"SELECT k, CASE k % 7 WHEN 0 THEN CAST({SQL_NUMBER} * 1000000 + 500000 AS BIGINT) WHEN 1 THEN 1250000000 WHEN 3 THEN CASE WHEN {SQL_NUMBER} = 77 THEN 77000000 END END AS value_usd, CASE k % 7 WHEN 0 THEN 'announced' WHEN 1 THEN 'completed' WHEN 2 THEN 'announced' WHEN 3 THEN 'terminated' WHEN 5 THEN 'announced' END AS state FROM (SELECT o_orderkey AS k FROM orders)")
def deal_stated_value(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("k")).withColumn("text", _announcement("k"))
    return o.select("k", D.stated_value(F.col("text")).alias("value_usd"), D.deal_state(F.col("text")).alias("state"))


@query("deal_exchange_ratio", f"SELECT k, {SQL_RATIO} AS ratio, CASE WHEN k % 7 IN (0, 2) THEN 'Alpha' END AS acquirer, CASE WHEN k % 7 IN (0, 2) THEN 'Beta' END AS target, CASE WHEN k % 7 IN (0, 2) THEN 'ALFA' END AS acquirer_ticker, CASE WHEN k % 7 IN (0, 2) THEN 'BETA' END AS target_ticker FROM (SELECT o_orderkey AS k FROM orders)")
def deal_exchange_ratio(t: Tables) -> DataFrame:
    x = t.orders.select(F.col("o_orderkey").alias("k")).withColumn("text", _announcement("k")).withColumn("x", D.exchange_ratio(F.col("text")))
    ticker = lambda side: D.listed_ticker(F.col("text"), F.col(f"x.{side}")).alias(f"{side}_ticker")
    return x.select("k", "x.ratio", "x.acquirer", "x.target", ticker("acquirer"), ticker("target"))


@query(
    "deal_stock_value",
    f"""WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS close, max(o_orderkey) % 7 AS gap FROM orders GROUP BY 1), closes AS (SELECT d, close FROM days WHERE gap > 1), counts AS (SELECT CAST(date_trunc('quarter', d) AS DATE) AS d, CAST(count(*) * 1000 AS DOUBLE) AS shares FROM days GROUP BY 1),
deals AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT deals.*, c.close, c.d AS priced FROM deals ASOF LEFT JOIN closes c ON c.d < deals.d), s AS (SELECT p.*, c.shares, c.d AS counted FROM p ASOF LEFT JOIN counts c ON p.d >= c.d)
SELECT k, CASE WHEN d - priced <= 10 AND d - counted <= 200 THEN CAST(round(shares * ({SQL_RATIO}) * close) AS BIGINT) END AS value_usd FROM s""",
)
def deal_stock_value(t: Tables) -> DataFrame:
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("close"), (F.max("o_orderkey") % 7).alias("gap"))
    closes = days.where("gap > 1").select(F.lit("ALFA").alias("ticker"), "d", "close")
    shares = days.groupBy(F.to_date(F.date_trunc("quarter", "d")).alias("d")).agg((F.count("*") * 1000.0).alias("shares")).withColumn("ticker", F.lit("BETA"))
    deals = spread(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("announced")), "k").withColumn("text", _announcement("k"))
    return D.stock_values(deals, "text", "announced", shares, closes).select("k", "value_usd")


@query(
    "deal_groups",
    """WITH d AS (SELECT l_orderkey AS filing, l_linenumber AS n, CAST(l_shipdate AS DATE) AS filed, CASE l_linenumber % 5 WHEN 0 THEN '1.02' WHEN 1 THEN '9.01' WHEN 2 THEN '8.01' WHEN 3 THEN '5.02' ELSE '1.01' END AS item FROM lineitem),
g AS (SELECT filing, min(filed) AS filed, coalesce(min(n) FILTER (WHERE n % 2 = 0), min(n)) AS document, bool_or(item = '1.02') AS ended, bool_or(item IN ('1.01', '7.01', '8.01')) AS said FROM d GROUP BY 1)
SELECT filing, filed, CAST(document AS BIGINT) AS document, CASE WHEN ended THEN 'termination' ELSE 'announcement' END AS side FROM g WHERE ended OR said""",
    dates=["filed"],
)
def deal_groups(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    item = F.when(n % 5 == 0, "1.02").when(n % 5 == 1, "9.01").when(n % 5 == 2, "8.01").when(n % 5 == 3, "5.02").otherwise("1.01")
    d = t.lineitem.select(F.col("l_orderkey").alias("filing"), F.to_date("l_shipdate").alias("filed"), F.array(item).alias("items"), F.when(n % 2 == 0, "EX-99.1").otherwise("8-K").alias("kind"), n.cast("long").alias("document"))
    return D.merger_groups(d, "filing", "filed", "items", "kind", "document")


SQL_SPOKEN = """d AS (SELECT doc_id, text, coalesce(n_chars, 0) % 4 AS kind, 'Al' || coalesce(lang, 'n') || 'a' AS a, 'Be' || coalesce(lang, 'n') || 'a' AS b, doc_id % 900 + 1 AS n, doc_id % 90 + 10 AS r FROM documents)"""


@query(
    "document_deals",
    f"""WITH {SQL_SPOKEN} SELECT doc_id, CASE kind WHEN 0 THEN n * 1000000 + 500000 WHEN 2 THEN n * 1000000000 END AS value_usd, CASE WHEN kind IN (0, 2) THEN r / 100e0 END AS ratio, CASE WHEN kind IN (0, 2) THEN a END AS acquirer, CASE WHEN kind IN (0, 2) THEN b END AS target,
  CASE WHEN kind IN (0, 2) THEN 'AL' END AS acquirer_ticker, CASE WHEN kind = 0 THEN 'BE' END AS target_ticker, CASE kind WHEN 0 THEN 'announced' WHEN 1 THEN 'terminated' WHEN 2 THEN 'completed' END AS state FROM d""",
)
def document_deals(t: Tables) -> DataFrame:
    """Deals told in the midst of whole documents; whose deal it is and its figures follow from the document's language, length and id."""
    d = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("body"), (F.coalesce("n_chars", F.lit(0)) % 4).alias("kind"), F.concat(F.lit("Al"), F.coalesce("lang", F.lit("n")), F.lit("a")).alias("a"), F.concat(F.lit("Be"), F.coalesce("lang", F.lit("n")), F.lit("a")).alias("b"))
    n, r = (F.col("doc_id") % 900 + 1).cast("string"), F.concat(F.lit("0."), (F.col("doc_id") % 90 + 10).cast("string"))
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) and x not in "ab" else F.col(x) if isinstance(x, str) else x for x in parts))
    told = (
        F.when(F.col("kind") == 0, say("a", " Bancorp (NASDAQ: AL) will acquire ", "b", " Bank (NYSE: BE) in a deal valued at\n approximately US$ ", n, ".5 million. Holders will receive ", r, " shares of ", "a", " common stock for each share of ", "b", " common stock, and a fee of $3 million."))
        .when(F.col("kind") == 1, say("The merger of ", "a", " and ", "b", " valued at $", n, " million, at a purchase price of $", n, ".1 million, was terminated; holders were to receive ", r, " ", "a", " shares for each ", "b", " share or receive 9.5 ", "a", " shares for each ", "b", " share."))
        .when(F.col("kind") == 2, say("a", " Bancorp (NYSE American: AL) has completed its purchase for $", n, " billion in the aggregate. Each share of ", "b", " stock is converted into the right to receive ", r, " of a share of ", "a", " common stock."))
        .otherwise(F.lit("A branch opens at a cost of $7 million."))
    )
    half = F.floor(F.length("body") / 2).cast("int")
    x = d.withColumn("text", F.concat(F.left("body", half), F.lit(". "), told, F.lit(" "), F.substr("body", half + 1))).withColumn("x", D.exchange_ratio(F.col("text")))
    ticker = lambda side: D.listed_ticker(F.col("text"), F.col(f"x.{side}")).alias(f"{side}_ticker")
    return x.select("doc_id", D.stated_value(F.col("text")).alias("value_usd"), "x.ratio", "x.acquirer", "x.target", ticker("acquirer"), ticker("target"), D.deal_state(F.col("text")).alias("state"))


@query("prospectus_covers", f"SELECT c_custkey AS k, {_chosen(COVER_KINDS, 'c_custkey')} AS kind, nullif({_chosen(COVER_SECURITIES, 'c_custkey')}, '') AS security, TRY_CAST({_chosen(COVER_GROSS, 'c_custkey')} AS BIGINT) AS gross_usd, TRY_CAST({_chosen(COVER_PRICES, 'c_custkey')} AS DOUBLE) AS price_per_share FROM customer")
def prospectus_covers(t: Tables) -> DataFrame:
    covers = spread(t.customer.select(F.col("c_custkey").alias("k")), "k")
    return covers.select("k", D.prospectus(_pick(COVERS, "k")).alias("p")).select("k", "p.*")


@query("placement_gross", f"SELECT c_custkey AS k, TRY_CAST({_chosen(PLACED, 'c_custkey')} AS BIGINT) AS gross_usd FROM customer")
def placement_gross(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), D.placement_gross(_pick(PLACEMENTS, "c_custkey")).alias("gross_usd"))


@query("brand_tokens", f"SELECT c_custkey AS k, nullif({_chosen(BRANDS, 'c_custkey')}, '') AS brand FROM customer")
def brand_tokens(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), D.brand(_pick(NAMES, "c_custkey")).alias("brand"))


def _tag(name: str, *inner, attributes: str = ""):
    parts = [i if not isinstance(i, str) else F.lit(i) for i in inner]
    return F.concat(F.lit(f"<{name}{attributes}>"), *parts, F.lit(f"</{name}>"))


SQL_ROLE = "CASE o_orderkey % 4 WHEN 0 THEN 'Chief' WHEN 1 THEN 'Officer, Director' WHEN 2 THEN 'Director' ELSE 'Insider' END"


@query(
    "ownership_forms",
    f"""WITH o AS (SELECT *, {SQL_ROLE} AS role, round(o_totalprice) AS p FROM orders)
SELECT o_orderkey AS k, 'T' || o_custkey AS ticker, 'Owner ' || o_custkey AS insider, role, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE 'S' END AS code, 100e0 AS shares, CASE WHEN o_orderkey % 5 > 0 THEN p END AS price, CASE WHEN o_orderkey % 5 > 0 THEN 100 * p END AS value_usd, 500e0 AS shares_after, CASE WHEN o_orderkey % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS direction, false AS derivative FROM o WHERE o_orderkey % 11 > 0
UNION ALL SELECT o_orderkey, 'T' || o_custkey, 'Owner ' || o_custkey, role, CAST(o_orderdate AS DATE), CASE WHEN o_orderkey % 3 = 0 THEN 'M' ELSE 'A' END, 10e0, p, CASE WHEN o_orderkey % 3 > 0 THEN 10 * p END, NULL, CASE WHEN o_orderkey % 3 = 0 THEN 'Exercise' ELSE 'A' END, true FROM o""",
    dates=["d"],
)
def ownership_forms(t: Tables) -> DataFrame:
    k, price = F.col("o_orderkey"), F.round("o_totalprice").cast("long").cast("string")
    who = F.col("o_custkey").cast("string")
    value = lambda name, x: _tag(name, _tag("value", x))
    day = value("transactionDate", F.date_format("o_orderdate", "yyyy-MM-dd"))

    def trade(name, code, shares, price, acquired, after):
        amounts = _tag("transactionAmounts", value("transactionShares", shares), value("transactionPricePerShare", price), value("transactionAcquiredDisposedCode", acquired))
        return _tag(name, day, _tag("transactionCoding", _tag("transactionCode", code)), amounts, _tag("postTransactionAmounts", value("sharesOwnedFollowingTransaction", after)))

    plain = trade("nonDerivativeTransaction", F.when(k % 2 == 0, "P").otherwise("S"), F.when(k % 11 == 0, "some").otherwise("100"), F.when(k % 5 == 0, "").otherwise(price), F.when(k % 2 == 0, "A").otherwise("D"), "500")
    option = trade("derivativeTransaction", F.when(k % 3 == 0, "M").otherwise("A"), "10", price, "A", "7")
    links = _tag("reportingOwnerRelationship", _tag("isDirector", F.when((k % 4).isin(1, 2), "1").otherwise("0")), _tag("isOfficer", F.when(k % 4 < 2, "1").otherwise("0")), _tag("officerTitle", F.when(k % 4 == 0, "Chief").otherwise("")))
    owner = _tag("reportingOwner", _tag("reportingOwnerId", _tag("rptOwnerName", F.concat(F.lit("Owner "), who))), links)
    doc = _tag("ownershipDocument", _tag("issuer", _tag("issuerTradingSymbol", F.concat(F.lit("T"), who))), owner, _tag("nonDerivativeTable", plain), _tag("derivativeTable", option))
    return forms.trades(spread(t.orders, "o_orderkey").select(k.alias("k"), doc.alias("doc")), "k", "doc")


@query(
    "holdings_tables",
    """SELECT l_orderkey AS filing, 'Issuer ' || l_partkey AS issuer, 'COM' AS title, CAST(l_partkey AS VARCHAR) AS cusip, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS shares,
round(l_extendedprice) * CASE WHEN l_orderkey % 2 = 0 THEN 1000 ELSE 1 END AS value_usd FROM lineitem""",
)
def holdings_tables(t: Tables) -> DataFrame:
    def one(r):
        part = r.l_partkey.cast("string")
        return _tag(
            "n1:infoTable", _tag("n1:nameOfIssuer", F.concat(F.lit(" Issuer "), part)), _tag("n1:titleOfClass", "COM"), _tag("n1:cusip", part), _tag("n1:value", F.round(r.l_extendedprice).cast("long").cast("string")),
            _tag("n1:shrsOrPrnAmt", _tag("n1:sshPrnamt", F.when(r.l_linenumber == 7, "none").otherwise(r.l_quantity.cast("string")))),
        )

    # rows are dealt and grouped as numbers, texts are made of whole filings
    lines = F.collect_list(F.struct("l_partkey", "l_extendedprice", "l_linenumber", "l_quantity"))
    per = spread(t.lineitem, "l_orderkey").groupBy(F.col("l_orderkey").alias("filing")).agg(F.array_join(F.transform(lines, one), "").alias("x"))
    filed = F.when(F.col("filing") % 2 == 0, F.lit("2022-11-14")).otherwise("2023-02-14").cast("date")
    return forms.holdings(per.select("filing", filed.alias("filed"), _tag("n1:informationTable", F.col("x"), attributes=' xmlns:n1="urn:x"').alias("doc")), "filing", "doc", "filed")


SQL_SHAPE = """o_custkey AS filing, CASE WHEN o_orderkey % 2 = 0 THEN 'us:Loans' ELSE 'own:Fees' END AS concept"""
SQL_PERIOD = """CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS "start", CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 > 0 THEN 90 ELSE 0 END AS "end" """


def _context(prefix: str):
    k, day = F.col("o_orderkey"), lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    period = F.when(k % 3 == 0, _tag(f"{prefix}instant", day(0))).otherwise(F.concat(_tag(f"{prefix}startDate", day(0)), _tag(f"{prefix}endDate", day(90))))
    member = F.when(k % 5 == 0, F.concat(F.lit('<d:explicitMember dimension="us:SegmentAxis"> us:Member'), (k % 4).cast("string"), F.lit("</d:explicitMember>")))
    typed = F.when(k % 5 == 1, F.concat(F.lit('<d:typedMember dimension="own:KeyAxis"><own:key>'), k.cast("string"), F.lit("</own:key></d:typedMember>")))
    inner = F.concat(_tag(f"{prefix}entity", _tag(f"{prefix}segment", F.coalesce(member, typed, F.lit("")))), _tag(f"{prefix}period", period))
    return F.concat(F.lit(f'<{prefix}context id="c'), k.cast("string"), F.lit('">'), inner, F.lit(f"</{prefix}context>"))


def _seen(facts: DataFrame) -> DataFrame:
    """Facts with their first dimension as two columns."""
    axis = F.try_element_at(F.map_keys("dims"), F.lit(1))
    return facts.select("filing", "concept", "value", "unit", "start", "end", axis.alias("axis"), F.try_element_at("dims", axis).alias("member"))


SQL_AXES = """CASE o_orderkey % 5 WHEN 0 THEN 'us:SegmentAxis' WHEN 1 THEN 'own:KeyAxis' END AS axis, CASE o_orderkey % 5 WHEN 0 THEN 'us:Member' || (o_orderkey % 4) WHEN 1 THEN 'typed:key=' || o_orderkey END AS member"""


@query("instance_facts", f"SELECT {SQL_SHAPE}, round(o_totalprice) AS value, 'USD/shares' AS unit, {SQL_PERIOD}, {SQL_AXES} FROM orders WHERE o_orderkey % 7 > 0", dates=["start", "end"])
def instance_facts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 2 == 0, "us:Loans").otherwise("own:Fees")
    told = F.when(k % 7 == 0, "text").otherwise(F.round("o_totalprice").cast("long").cast("string"))
    fact = F.concat(F.lit("<"), name, F.lit(' unitRef="u1" contextRef="c'), k.cast("string"), F.lit('">'), told, F.lit("</"), name, F.lit(">"))
    lost = F.lit('<us:Loans contextRef="gone" unitRef="u1">5</us:Loans>')
    unit = F.lit('<x:unit id="u1"><x:divide><x:unitNumerator><x:measure>iso4217:USD</x:measure></x:unitNumerator><x:unitDenominator><x:measure>x:shares</x:measure></x:unitDenominator></x:divide></x:unit>')
    per = t.orders.groupBy(F.col("o_custkey").alias("filing")).agg(F.concat(F.lit("<x:xbrl>"), unit, lost, F.array_join(F.collect_list(F.concat(_context("x:"), fact)), "\n"), F.lit("</x:xbrl>")).alias("doc"))
    return _seen(forms.instance_facts(per, "filing", "doc"))


@query("inline_facts", f"SELECT {SQL_SHAPE}, CASE WHEN o_orderkey % 4 IN (1, 2) THEN -1 ELSE 1 END * round(o_totalprice) * 1000 AS value, 'USD' AS unit, {SQL_PERIOD}, {SQL_AXES} FROM orders WHERE o_orderkey % 7 > 0", dates=["start", "end"])
def inline_facts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.format_number(F.round("o_totalprice"), 0)
    told = F.when(k % 7 == 0, "&#8212;").when(k % 4 == 1, F.concat(F.lit("("), number, F.lit(")"))).otherwise(F.concat(F.lit("<b>"), number, F.lit("</b> ")))
    tag = F.concat(
        F.lit('<ix:nonFraction name="'), F.when(k % 2 == 0, "us:Loans").otherwise("own:Fees"), F.lit('" scale="3" contextRef="c'), k.cast("string"),
        F.lit('" unitRef="u1"'), F.when(k % 4 == 2, ' sign="-"').otherwise(""), F.lit(">"), told, F.lit("</ix:nonFraction>"),
    )
    unit = F.lit('<xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>')
    # both documents of a filing come from one grouping
    per = t.orders.groupBy(F.col("o_custkey").alias("filing")).agg(F.collect_list(tag).alias("tags"), F.collect_list(_context("xbrli:")).alias("contexts"))
    facts = F.concat(F.lit("<html><p>"), F.array_join("tags", "</p><p>"), F.lit("</p></html>"))
    heads = F.concat(F.lit("<html><ix:resources>"), unit, F.array_join("contexts", ""), F.lit("</ix:resources></html>"))
    docs = per.select("filing", F.explode(F.array(facts, heads)).alias("doc"))
    return _seen(forms.inline_facts(docs, "filing", "doc"))

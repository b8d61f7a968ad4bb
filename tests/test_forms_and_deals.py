"""Readers of filed documents and rules of deals: broken, empty and repeated input, hand-written cases."""

import datetime

from pyspark.sql import functions as F

from ledgerline.operators import deals
from ledgerline.sources import forms

OWNERSHIP = """<?xml version="1.0"?><ownershipDocument><issuer><issuerTradingSymbol>ABC</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerName>Roe</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerName>Second</rptOwnerName></reportingOwnerId></reportingOwner>
<nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-03-01</value></transactionDate><transactionAmounts><transactionShares><value>3</value></transactionShares></transactionAmounts></nonDerivativeTransaction>
<nonDerivativeTransaction><transactionAmounts><transactionShares><value>x</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_ownership_forms(spark):
    df = spark.createDataFrame([(1, OWNERSHIP), (2, None), (3, ""), (4, "<ownershipDocument><issuer>"), (5, "no markup")], "k int, doc string")
    (r,) = forms.trades(df, "k", "doc").collect()
    assert (r.k, r.ticker, r.insider, r.role, r.d, r.code, r.shares, r.price, r.value_usd, r.shares_after, r.direction, r.derivative) == (
        1, "ABC", "Roe", "Director", datetime.date(2024, 3, 1), None, 3.0, None, None, None, "Sell", False
    )


CONTEXT = '<context id="{}"><entity><segment>{}</segment></entity><period><instant>{}</instant></period></context>'
MEMBER = '<xbrldi:explicitMember dimension="a:Axis">a:{}</xbrldi:explicitMember>'


def test_facts_meet_the_contexts_of_their_filing(spark):
    twice = CONTEXT.format("c", MEMBER.format("Old") + MEMBER.format("New"), "2024-03-31")
    fact = "<us-gaap:Assets contextRef='c' unitRef='usd' decimals='-3'>\n 12.5 </us-gaap:Assets><us-gaap:Note contextRef='c'>words</us-gaap:Note>"
    again = CONTEXT.format("d", "", "2023-03-31") + CONTEXT.format("d", "", "2023-06-30") + '<us-gaap:Assets contextRef="d">7</us-gaap:Assets>'
    docs = [(1, twice), (1, fact), (2, fact), (3, again), (4, None), (5, ""), (6, "<x><y>")]
    got = {r.filing: r for r in forms.instance_facts(spark.createDataFrame(docs, "filing int, doc string"), "filing", "doc").collect()}
    assert set(got) == {1, 3}  # the context of filing 2 is nowhere
    assert (got[1].concept, got[1].value, got[1].unit, str(got[1].end), got[1].dims) == ("us-gaap:Assets", 12.5, None, "2024-03-31", {"a:Axis": "a:New"})
    assert (got[3].value, str(got[3].end), got[3].dims) == (7.0, "2023-06-30", {})


def test_inline_values(spark):
    cases = [("1,234", 'scale="3"', 1234000.0), ("(5)", "", -5.0), ("5", "sign='-'", -5.0), ("-5", 'sign="-"', -5.0), ("<span>7</span>", 'scale="x"', 7.0), ("—", "", None), ("", "", None), ("12%", "", None), ("( 1 2 )", "", -12.0)]
    tags = [(k, CONTEXT.format("c", "", "2024-03-31") + f'<ix:nonFraction name="n:x" contextRef="c" {a}>{t}</ix:nonFraction>') for k, (t, a, _) in enumerate(cases)]
    got = {r.filing: r.value for r in forms.inline_facts(spark.createDataFrame(tags, "filing int, doc string"), "filing", "doc").collect()}
    assert got == {k: v for k, (_, _, v) in enumerate(cases) if v is not None}


def test_deal_texts(spark):
    def of(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x

    assert of(deals.stated_value, "valued at $1.2 billion; a purchase price of US$1,200 million") == 1_200_000_000
    assert of(deals.stated_value, "valued at $5 million or $6 million in the aggregate") is None
    assert of(deals.stated_value, "a fee of $5 million") is None and of(deals.stated_value, None) is None
    assert of(deals.exchange_ratio, "receive 2.095 First Hawaiian, Inc. shares for each TriCo share") == (2.095, "First Hawaiian, Inc.", "TriCo")
    assert of(deals.exchange_ratio, "") is None and of(deals.exchange_ratio, None) is None
    assert of(deals.prospectus, None) is None and of(deals.prospectus, "").kind == "Unclassified"
    assert of(deals.deal_state, "Upon completion of the merger, X will acquire Y") == "announced"
    assert of(deals.brand, "LTD of TD Bank") == "ltd" and of(deals.brand, None) is None


def test_filings_of_mergers(spark):
    rows = [("a", "2024-01-02", ["8.01"], "8-K", "x.htm"), ("a", "2024-01-02", ["9.01"], "ex-99.1", "z.htm"), ("b", "2024-01-03", ["1.01", "1.02"], None, "b.htm"), ("c", "2024-01-04", ["5.02"], "8-K", "c.htm"), ("d", None, ["1.01"], "8-K", "d.htm"), (None, "2024-01-04", ["1.01"], "8-K", "e.htm"), ("f", "2024-01-05", None, "8-K", "f.htm")]
    df = spark.createDataFrame(rows, "filing string, filed string, items array<string>, kind string, document string")
    got = {r.filing: (r.document, r.side) for r in deals.merger_groups(df, "filing", "filed", "items", "kind", "document").collect()}
    assert got == {"a": ("z.htm", "announcement"), "b": ("b.htm", "termination")}


def test_money_and_its_surroundings(spark):
    def of(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x

    got = of(deals.money, "A fee of $1,000.50. Then valued at about $ 2 million in the aggregate, $ n/a")
    assert [(m.amount, m.unit) for m in got] == [(1000.5, ""), (2.0, "million")] and got[1].before.endswith(" valued at about ") and got[1].after.startswith(" in the aggregate ")
    assert of(deals.money, "") == [] and of(deals.stated_value, "valued at $5") is None  # no unit
    assert of(deals.stated_value, "devalued at $5 million") is None
    assert of(deals.exchange_ratio, "Each share of Beta stock is converted into 1.5 shares of Alpha Corp. common stock") == (1.5, "Alpha Corp.", "Beta")
    assert of(deals.exchange_ratio, "receive 1.5 Alpha shares for each Beta share, or receive 2 Alpha shares for each Beta share") is None
    cover = "The 4.125% Fixed-to-Floating Rate  Subordinated Notes due 2031 rank below senior notes. $50,000,000 aggregate principal amount"
    assert tuple(of(deals.prospectus, cover)) == ("DCM", "4.125% Fixed-to-Floating Rate Subordinated Notes due 2031", 50_000_000, None)
    assert tuple(of(deals.prospectus, "Perpetual Preferred Stock, price to public $25 $ 75,000,000")) == ("ECM", "Perpetual Preferred Stock", 75_000_000, 25.0)
    assert tuple(of(deals.prospectus, "We are offering 2,000,000 shares of common stock at a public offering price of $10")) == ("ECM", "Common Stock", 20_000_000, 10.0)
    assert of(deals.placement_gross, "It sold notes for $25 million. It sold notes for $25,000,000.") == 25_000_000 and of(deals.placement_gross, None) is None
    assert of(lambda t: deals.listed_ticker(t, F.lit("Alpha Bank")), "Alpha Bancorp (NYSE American: ALF) met Beta (NASDAQ: BET)") == "ALF"
    assert of(lambda t: deals.listed_ticker(t, F.lit("Alpha Bank")), "Alpha (NASDAQ: A) or Alpha (NYSE: B)") is None


def test_deals_mention_their_text_a_few_times(spark):
    """Each mention inside a branch or a function of arrays is computed anew, so costs must not multiply."""
    df = spark.range(1).select(F.lit("x").alias("marked"), F.lit("y").alias("side"))
    text = F.col("marked")
    made = {"money": deals.money(text), "value": deals.stated_value(text), "ratio": deals.exchange_ratio(text), "ticker": deals.listed_ticker(text, F.col("side")), "state": deals.deal_state(text), "cover": deals.prospectus(text)}
    counted = {name: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().splitlines()[0].count("marked#") for name, c in made.items()}
    assert {k: n for k, n in counted.items() if n > (10 if k == "cover" else 3)} == {}


def test_asof_of_repeated_probes_equals_asof(spark):
    from ledgerline.operators import asof

    facts = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 1, 10)], "key string, at int, v int")
    probes = spark.createDataFrame([(k, at, n) for n in range(3) for k in ("a", "b", "c", None) for at in (1, 2, 4, 5, None)], "key string, at int, n int")
    shown = lambda df: sorted(map(str, df.select("key", "at", "n", "fact_at", "v").collect()))
    assert shown(asof.backward_repeated(probes, facts, "key", "at")) == shown(asof.backward(probes, facts, "key", "at"))


def test_contexts_are_parsed_behind_their_grouping(spark):
    """Of an id that is used twice only the text that counts is parsed, and no parsed parts are sorted or shuffled."""
    doc = '<a><context id="c"><startDate>2020-01-01</startDate><endDate>2020-03-31</endDate></context><context id="c"><instant>2021-02-03</instant><explicitMember dimension="x:A">m</explicitMember></context></a>'
    out = forms.contexts(spark.createDataFrame([(1, doc)], "filing int, doc string"), "filing", "doc")
    assert [(r.filing, r.context, r.start, str(r.end), r.dims) for r in out.collect()] == [(1, "c", None, "2021-02-03", {"x:A": "m"})]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explicitMember" not in plan[plan.index("Aggregate") :]


def _position(prefix, gap="", **given):
    tag = lambda name, *inner: f"<{prefix}{name}>{gap if inner[0][:1] == '<' else ''}{''.join(inner)}</{prefix}{name}>{gap}"
    told = {"nameOfIssuer": "A", "titleOfClass": "COM", "cusip": "1", "value": "5", "sshPrnamt": "7"} | given
    head = [tag(n, told[n]) for n in ("nameOfIssuer", "titleOfClass", "cusip", "value") if told[n] is not None]
    return tag("infoTable", *head, tag("shrsOrPrnAmt", tag("sshPrnamt", told["sshPrnamt"]), tag("sshPrnamtType", "SH")), tag("votingAuthority", tag("Sole", "7"), tag("None", "0")))


def _table(prefix, body, head="", attributes=""):
    return f"{head}<{prefix}informationTable{attributes}>{body}</{prefix}informationTable>"


def test_holdings_cut_by_a_pattern_equal_the_reader(spark):
    head, one = '<?xml version="1.0" encoding="UTF-8"?>\n', _position("n:")
    plain = [_table(p, gap + _position(p, gap) + _position(p, gap, nameOfIssuer=" \u00c9 b ", value=" 2.5 ", sshPrnamt="none"), h, a) for p in ("", "n:") for gap in ("", "\r\n  ") for h in ("", head) for a in ("", ' xmlns="u" xmlns:n="v"')]
    whole = _table("n:", one * 2)
    inner = ["", " ", "\n", "x\ny", "a&amp;b", "&bad;", "<!-- c -->x", "<![CDATA[z]]>", "<b>c</b>", "\x01", "\x02", "a>b", "]]>", None]
    odd = [_table("n:", _position("n:", **{f: x}) + one) for f in ("nameOfIssuer", "value") for x in inner]
    odd += [whole[:at] + x + whole[at:] for at in (0, whole.index(">") + 1, whole.index(">") + 1 + len(one), len(whole)) for x in ("text", "<!-- c -->", "<x/>", "</x>", "\x02", "\x03", "\x02a\x01b\x01c\x01d\x01e\x01\x03", "<n:infoTable/>")]
    odd += [whole.replace("<n:cusip>", '<n:cusip a="1">', 1), whole.replace("</n:cusip>", "</m:cusip>"), whole.replace("cusip", "CUSIP"), whole.replace("Sole>", "value>"), whole.replace("votingAuthority", "Value"), whole[:-5], one, one * 2, None, ""]
    odd += [_table("n:", one, "", a) for a in (' a="1" a="2"', " a='1'", ' a="<"', ' a="&"', ' a="1"b="2"', " a")] + [_table("n:", f"<n:x>{one}</n:x>"), _table("n:", one, " " + head)]
    odd.append(whole.replace("<n:votingAuthority>", "<n:votingAuthority>" + " " * 100_000 + "<!-- c -->", 1))  # takes minutes where blanks are gone over again
    df = spark.createDataFrame([(k, d, datetime.date(2022 + k % 2, 6, 1)) for k, d in enumerate(plain + odd)], "k int, doc string, filed date")
    read = df.select("k", "filed", F.explode_outer(F.from_xml("doc", forms.HOLDINGS, forms.PLAIN).infoTable).alias("i")).where("i is not null")
    text = lambda c: F.trim(c)
    number = lambda c: F.col(c).try_cast("double")
    expected = read.select("k", text("i.nameOfIssuer"), text("i.titleOfClass"), text("i.cusip"), number("i.shrsOrPrnAmt.sshPrnamt"), number("i.value") * F.when(F.year("filed") < 2023, 1000.0).otherwise(1.0))
    got = forms.holdings(df, "k", "doc", "filed")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, expected.collect())))
    # and of all of them, the plain ones are those that need no reader
    cut = df.select("k", F.regexp_replace("doc", forms.PLAIN_POSITION, "\x02$2\x01$3\x01$4\x01$7\x01$8\x01\x03").rlike(forms.PLAIN_TABLE).alias("plain")).where("plain")
    assert sorted(r.k for r in cut.collect()) == list(range(len(plain)))


def test_holdings_are_grouped_as_numbers(spark):
    """A filing's text is made behind its grouping, and rows meet in one shuffle."""
    from ledgerline.plans import catalogue

    plan = catalogue.QUERIES["holdings_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "infoTable" not in plan[plan.index("Exchange ") :]


def test_ownership_forms_are_dealt_over_all_tasks(spark):
    """A small file is a split or two, and the reader takes long for each of its rows."""
    from ledgerline.plans import catalogue

    plan = catalogue.QUERIES["ownership_forms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ownershipDocument" not in plan[plan.index("Exchange ") :]

"""Filed XML documents as tables: ownership forms, holdings tables, instance and inline facts.

Documents are a column of text, one a row; schemas are given. A broken document, a null
and an empty text give no rows. All of it is expressions over the scan; only facts meet
their contexts in a join, on (filing, context), for a filing may split them over documents.
Arrays are exploded outer, nulls dropped after: of an inner explode Spark infers a filter
below it that parses every document once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numbers import number

AMOUNTS = "struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>,transactionAcquiredDisposedCode:struct<value:string>>"
TRADE = (
    "array<struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,"
    f"transactionAmounts:{AMOUNTS},postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:string>>>>"
)
OWNERSHIP = (
    "struct<issuer:struct<issuerTradingSymbol:string>,reportingOwner:array<struct<reportingOwnerId:struct<rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,officerTitle:string>>>,"
    f"nonDerivativeTable:struct<nonDerivativeTransaction:{TRADE}>,derivativeTable:struct<derivativeTransaction:{TRADE}>>"
)
HOLDINGS = "struct<infoTable:array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string>>>>"
PLAIN = {"ignoreNamespace": "true"}

SPACE = r"[ \t\r\n]*"
CONTROL = "".join(rf"\x{c:02x}" for c in range(32))
TEXT = f"[^<>&{CONTROL}]*"


def _leaf(name: str) -> str:
    """An element of one prefix, with a text that is not blank."""
    return rf"<\1{name}>( *[^<>& {CONTROL}]{TEXT})</\1{name}>{SPACE}"


def _others(group: int) -> str:
    """Elements of other names, with a text or with elements that have one."""
    tag = rf"<\1(?!(?i:value|nameOfIssuer|titleOfClass|cusip|shrsOrPrnAmt|sshPrnamt|infoTable)>)([A-Za-z][\w.-]*)>(?>{TEXT})"
    return rf"(?:{tag}(?:{SPACE}{tag}</\1\{group + 1}>)*+{SPACE}</\1\{group}>{SPACE})*+"


#: A position of a holdings table in the order of its schema, without attributes, entities, comments and what else needs a reader.
#: Or the control character that opens a cut position: where a document has one itself, it opens a position without fields.
PLAIN_POSITION = (
    rf"<((?:[A-Za-z][\w.-]*:)?)infoTable>{SPACE}" + _leaf("nameOfIssuer") + _leaf("titleOfClass") + _leaf("cusip") + _others(5) + _leaf("value")
    + rf"<\1shrsOrPrnAmt>{SPACE}" + _leaf("sshPrnamt") + _others(9) + rf"</\1shrsOrPrnAmt>{SPACE}" + _others(11) + rf"</\1infoTable>{SPACE}|\x02"
)
#: A table that has only such positions, once they are cut.
NAME = r"[A-Za-z][\w.-]*(?::[A-Za-z][\w.-]*)?"
PLAIN_TABLE = (
    rf"""^(?:<\?xml version="1\.0"(?: encoding="[Uu][Tt][Ff]-8")?\?>{SPACE})?<({NAME})(?:[ \t\r\n]+({NAME})="[^"<>&{CONTROL}]*"(?![^<>]*\s\2=))*+{SPACE}>{SPACE}"""
    r"(?:\x02[^\x01\x03][^\x03]*\x03)*+" + rf"</\1>{SPACE}\z"
)


def trades(df: DataFrame, key: str, column: str) -> DataFrame:
    """Transactions of ownership forms: key, ticker, insider, role, d, code, shares, price, value_usd, shares_after, direction, derivative.

    The first owner counts. Role is title (Officer without one), then Director; Insider if
    neither. Shares or price that are given but are no number drop the transaction; a value
    needs both, neither 0, and exercises (derivative, code M) have none: their price is the
    strike. Direction is Buy where acquired and Sell otherwise; of derivatives, Exercise or the code.
    """
    x = df.select(key, F.from_xml(column, OWNERSHIP, PLAIN).alias("x"))
    owner = F.try_element_at("x.reportingOwner", F.lit(1))
    link = owner.reportingOwnerRelationship
    title = F.nullif(F.trim(link.officerTitle), F.lit(""))
    role = F.concat_ws(", ", F.when(link.isOfficer == "1", F.coalesce(title, F.lit("Officer"))), F.when(link.isDirector == "1", "Director"))
    head = x.select(
        key, F.col("x.issuer.issuerTradingSymbol").alias("ticker"), owner.reportingOwnerId.rptOwnerName.alias("insider"),
        F.coalesce(F.nullif(role, F.lit("")), F.lit("Insider")).alias("role"),
        F.array(
            F.struct(F.lit(False).alias("derivative"), F.col("x.nonDerivativeTable.nonDerivativeTransaction").alias("t")),
            F.struct(F.lit(True).alias("derivative"), F.col("x.derivativeTable.derivativeTransaction").alias("t")),
        ).alias("parts"),
    )
    rows = head.select(key, "ticker", "insider", "role", F.explode_outer("parts").alias("p")).select(key, "ticker", "insider", "role", "p.derivative", F.explode_outer("p.t").alias("t")).where("t is not null")
    given = {"shares": F.col("t.transactionAmounts.transactionShares.value"), "price": F.col("t.transactionAmounts.transactionPricePerShare.value")}
    code = F.col("t.transactionCoding.transactionCode")
    out = rows
    for text in given.values():
        out = out.where(F.coalesce(text, F.lit("")).eqNullSafe("") | number(text).isNotNull())
    exercise = F.col("derivative") & code.eqNullSafe("M")
    shares, price = number(given["shares"]), number(given["price"])
    bought = F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value").eqNullSafe("A")
    return out.select(
        key, "ticker", "insider", "role", F.try_to_date(F.substring("t.transactionDate.value", 1, 10), "yyyy-MM-dd").alias("d"), code.alias("code"),
        shares.alias("shares"), price.alias("price"), F.when((shares != 0) & (price != 0) & ~exercise, shares * price).alias("value_usd"),
        F.when(~F.col("derivative"), number(F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value"))).alias("shares_after"),
        F.when(~F.col("derivative"), F.when(bought, "Buy").otherwise("Sell")).when(exercise, "Exercise").otherwise(code).alias("direction"), "derivative",
    )


def holdings(df: DataFrame, key: str, column: str, filed: str) -> DataFrame:
    """Positions of quarterly holdings tables: key, issuer, title, cusip, shares, value_usd. Values filed before 2023 are in thousands.

    Tables that are plain throughout are cut by one pattern, the XML reader has the rest, with
    the same rows. A position is a text of its fields, closed by control characters, which no
    document may have.
    """
    cut = df.select(key, filed, column, F.regexp_replace(column, PLAIN_POSITION, "\x02$2\x01$3\x01$4\x01$7\x01$8\x01\x03").alias("cut"))
    read = F.filter(F.from_xml(column, HOLDINGS, PLAIN).infoTable, lambda i: i.isNotNull())
    missing = lambda x: F.coalesce(x, F.lit("\0"))
    told = F.transform(read, lambda i: F.concat(*(F.concat(missing(x), F.lit("\x01")) for x in (i.nameOfIssuer, i.titleOfClass, i.cusip, i.value, i.shrsOrPrnAmt.sshPrnamt))))
    positions = F.when(F.col("cut").rlike(PLAIN_TABLE), F.slice(F.split("cut", "\x02"), 2, 2**30)).otherwise(told)
    i = cut.select(key, filed, F.explode_outer(positions).alias("i")).where("i is not null").select(key, filed, F.split("i", "\x01").alias("i"))
    issuer, title, cusip, value, shares = (F.nullif(F.get("i", F.lit(k)), F.lit("\0")) for k in range(5))
    scale = F.when(F.col(filed) < F.lit("2023-01-01").cast("date"), 1000.0).otherwise(1.0)
    return i.select(
        key, F.trim(issuer).alias("issuer"), F.trim(title).alias("title"), F.trim(cusip).alias("cusip"),
        number(shares).alias("shares"), (number(value) * scale).alias("value_usd"),
    )


def _element(name: str) -> str:
    """A whole element of a local name, with any prefix."""
    return rf"(?is)<(?:[\w.-]+:)?{name}\b[^>]*>.*?</(?:[\w.-]+:)?{name}\s*>"


def _inner(text: Column, name: str) -> Column:
    """The trimmed text of the first element of a local name, null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?is)<(?:[\w.-]+:)?{name}\b[^>]*>([^<]*)<", 1)), F.lit(""))


def _attribute(text: Column, name: str) -> Column:
    """An attribute of the first tag of a text, null without one."""
    return F.nullif(F.regexp_extract(text, rf"""(?i)^<[^>]*?\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def contexts(df: DataFrame, filing: str, column: str) -> DataFrame:
    """Contexts: filing, context, start, end (of an instant: that day), dims (axis to member; a typed one as typed:name=text).

    An id used twice takes its last use within a document and the greatest text across documents; so does an axis.
    """
    c = df.select(filing, F.posexplode_outer(_all(F.col(column), _element("context"))).alias("at", "c")).where("c is not null")
    named = c.select(filing, _attribute(F.col("c"), "id").alias("context"), "at", "c").where("context is not null")
    # texts are grouped first and the one that counts is parsed, for all else follows from it
    best = named.groupBy(filing, "context").agg(F.max(F.struct("at", "c")).alias("b")).select(filing, "context", F.col("b.c").alias("c"))
    member = F.col("m")
    explicit = F.transform(_all(F.col("c"), _element("explicitMember")), lambda m: F.struct(_attribute(m, "dimension").alias("axis"), F.trim(F.regexp_extract(m, ">([^<]*)<", 1)).alias("member")))
    typed = F.transform(
        _all(F.col("c"), _element("typedMember")),
        lambda m: F.struct(
            _attribute(m, "dimension").alias("axis"),
            F.concat(F.lit("typed:"), F.regexp_replace(F.regexp_extract(m, r"(?s)^<[^>]*>\s*(<(?:[\w.-]+:)?[\w.-]+[^>]*>[^<]*)<", 1), r"(?s)^<(?:[\w.-]+:)?([\w.-]+)[^>]*>\s*(.*?)\s*$", "$1=$2")).alias("member"),
        ),
    )
    parsed = best.select(filing, "context", "c", F.filter(F.concat(explicit, typed), lambda m: m.axis.isNotNull()).alias("m"))
    last = F.filter(member, lambda m, i: ~F.array_contains(F.transform(F.slice(member, i + 2, F.size(member)), lambda n: n.axis), m.axis))
    day = lambda x: F.try_to_date(x, "yyyy-MM-dd")
    end = F.coalesce(_inner(F.col("c"), "instant"), _inner(F.col("c"), "endDate"))
    return parsed.select(filing, "context", day(_inner(F.col("c"), "startDate")).alias("start"), day(end).alias("end"), F.map_from_entries(F.array_sort(last)).alias("dims"))


def units(df: DataFrame, filing: str, column: str) -> DataFrame:
    """Units: filing, unit_id, unit, the local names of its measures joined by a slash."""
    u = df.select(filing, F.explode_outer(_all(F.col(column), _element("unit"))).alias("u")).where("u is not null")
    measures = F.transform(_all(F.col("u"), _element("measure")), lambda m: F.regexp_replace(F.trim(F.regexp_extract(m, ">([^<]*)<", 1)), "^.*:", ""))
    named = u.select(filing, _attribute(F.col("u"), "id").alias("unit_id"), F.nullif(F.array_join(measures, "/"), F.lit("")).alias("unit"))
    return named.where("unit_id is not null").groupBy(filing, "unit_id").agg(F.max("unit").alias("unit"))


def _resolved(facts: DataFrame, df: DataFrame, filing: str, column: str) -> DataFrame:
    """Facts of known contexts, with period, dimensions and unit. A fact whose context is missing goes."""
    f = facts.join(contexts(df, filing, column), [filing, "context"]).join(units(df, filing, column), [filing, "unit_id"], "left")
    return f.select(filing, "concept", "value", "unit", "start", "end", "dims")


def instance_facts(df: DataFrame, filing: str, column: str) -> DataFrame:
    """Numeric facts of instance documents: filing, concept (with its prefix), value, unit, start, end, dims."""
    pattern = r"""(?s)<[\w.-]+:[\w.-]+\s[^>]*?\bcontextRef\s*=\s*["'][^"']*["'][^>]*>[^<]*</"""
    f = df.select(filing, F.explode_outer(_all(F.col(column), pattern)).alias("f")).where("f is not null")
    value = number(F.trim(F.regexp_extract("f", ">([^<]*)<", 1)))
    facts = f.select(filing, F.regexp_extract("f", r"^<([\w.:-]+)", 1).alias("concept"), _attribute(F.col("f"), "contextRef").alias("context"), _attribute(F.col("f"), "unitRef").alias("unit_id"), value.alias("value"))
    return _resolved(facts.where("value is not null"), df, filing, column)


def inline_facts(df: DataFrame, filing: str, column: str) -> DataFrame:
    """Numeric facts inside pages: as ``instance_facts``. A minus sign attribute or parentheses make a value negative; scale is a power of ten."""
    f = df.select(filing, F.explode_outer(_all(F.col(column), _element("nonFraction"))).alias("f")).where("f is not null")
    raw = F.trim(F.regexp_replace("f", "(?s)<[^>]*>", ""))
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[()]+|[()]+$", ""), "[, ]", "")
    scale = F.coalesce(_attribute(F.col("f"), "scale").try_cast("int"), F.lit(0))
    value = F.when(bare.rlike(r"^-?\d"), number(bare)) * F.pow(F.lit(10.0), scale)
    negative = raw.startswith("(") | _attribute(F.col("f"), "sign").eqNullSafe("-")
    facts = f.select(
        filing, _attribute(F.col("f"), "name").alias("concept"), _attribute(F.col("f"), "contextRef").alias("context"),
        _attribute(F.col("f"), "unitRef").alias("unit_id"), F.when(negative, -F.abs(value)).otherwise(value).alias("value"),
    )
    return _resolved(facts.where("value is not null and concept is not null"), df, filing, column)

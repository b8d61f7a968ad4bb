"""Classification rules as column expressions: headlines, filings, regimes, quotes and figures.

Keyword rules look at the lower-cased text in the order given and take the first that
matches; predicates on text are false for null, regimes and bands null or 'na'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a release's kind, in order.
RELEASE_KINDS = {
    "earnings": ["earnings", "quarterly results", "fourth quarter", "first quarter", "second quarter", "third quarter", "reports results", "q1 ", "q2 ", "q3 ", "q4 ", "fiscal"],
    "m_and_a": ["acquir", "merger", "to merge", "to acquire", "combining with", "definitive agreement"],
    "capital_return": ["dividend", "declares quarterly", "share repurchase", "buyback"],
    "executive_change": ["appoint", "named", "joins", "resignation", "steps down", "chief executive", "ceo", "chairman", "board of directors"],
    "capital_raise": ["offering", "prices", "underwritten", "senior notes", "debt"],
}
# Verbs of a company's own releases, and marks of commentary by others (patterns).
OWN_VERBS = [
    r"announc\w+", r"report\w+", r"declar\w+", r"complet\w+", "names?", r"appoint\w+", r"provid\w+", "sets? ", r"schedul\w+", r"pric\w+", r"clos\w+", r"authoriz\w+", r"increas\w+", r"reduc\w+", r"present\w*",
    r"participat\w+", "to host", "hosts?", r"acquir\w+", r"launch\w+", r"introduc\w+", r"post\w+", r"releas\w+", r"issu\w+", r"elect\w+", r"approv\w+", r"rais\w+", r"adopt\w+", r"expand\w+", "to report",
    "earnings release", "conference call", "business update", "to merge", "enters? into", "to be acquired", "prices? offering", "commences?",
]
COMMENTARY = [
    "analyst", "price target", r"upgrad\w+", r"downgrad\w+", "rating", "buy", "sell", "hold", "should you", "how ", "why ", r"\d+\s+reasons", r"vs\.?", "compared to", "best place to work", "motley fool", "zacks",
    "seeking alpha", "simply ?wall", "insider monkey", "benzinga", "the globe and mail", "market cap of", "stock to", "is it a", "here's (what|why)", "what to know", "outperform", "underperform", r"top \d+", r"best \d+",
    "moving average", "short interest", "hedge fund",
]
# Structured notes, and enforcement by regulators (patterns).
NOTES = [
    "buffered", r"auto-?call\w*", "autocallable", r"contingent[\s-]?interest", "barrier", "uncapped", r"capped\s+\w*\s*notes?", r"leveraged\s+notes?", r"digital\s+notes?", r"review\s+notes?", r"market[\s-]?linked",
    r"dual\s+directional", r"trigger\s+\w+\s+notes?", r"principal\s+at\s+risk", r"callable\s+\w*\s*notes?", r"step[\s-]?up\s+notes?", r"range\s+accrual", r"phoenix\s+notes?", r"buffer\s+notes?", r"return\s+notes?",
    r"index[\s-]?linked\s+notes?", r"notes?\s+linked\s+to", r"notes?\s+tied\s+to", r"structured\s+notes?", r"fixed\s+to\s+floating", r"exchange[\s-]?traded\s+notes?", "etns?",
]
ENFORCEMENT = [
    r"consent\s+order", r"cease[\s-]and[\s-]desist", r"enforcement\s+action", r"civil\s+money\s+penalt\w+", r"deferred\s+prosecution", r"matter\s+requiring\s+attention", "mra", r"written\s+agreement\s+with\s+(the\s+)?(fed|occ|fdic)",
    r"(fined|fines|penaliz\w+|sanction\w+|charg\w+|sued|lawsuit|settl\w+|indict\w+|prob\w+)\s+\w*\s*(by\s+)?(the\s+)?(occ|fdic|federal\s+reserve|cfpb|sec|doj|justice\s+department|regulators?|prosecutors?)",
    r"(occ|fdic|federal\s+reserve|cfpb|doj)\s+(fines?|orders?|charges?|sanctions?|penaliz\w+|sues?|issues?\s+\w+\s+order)\w*",
]
# Hosts that no release lives on.
BLOCKED_HOSTS = [
    "whatsapp.com", "chat.whatsapp.com", "wa.me", "t.me", "telegram.me", "telegram.org", "telegram.dog", "facebook.com", "fb.com", "fb.me", "fb.watch", "m.facebook.com", "instagram.com", "tiktok.com", "twitter.com", "x.com",
    "youtube.com", "youtu.be", "reddit.com", "discord.gg", "discord.com", "linktr.ee", "linktree.com", "medium.com", "bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "buff.ly", "is.gd", "cutt.ly", "rebrand.ly", "shorturl.at",
    "lnkd.in", "t.co", "rb.gy",
]
# Core economic releases, and what only sounds like one.
CORE_RELEASES = [
    "cpi", "pce", "ppi", "nonfarm payroll", "non-farm payroll", "non farm payroll", "unemployment rate", "jobless claims", "adp employment", "jolts", "job openings", "hourly earnings", "gdp", "retail sales", "personal income",
    "personal spending", "durable goods", "factory orders", "industrial production", "capacity utilization", "ism ", "pmi", "empire state", "philadelphia fed", "philly fed", "chicago pmi", "dallas fed", "richmond fed",
    "kansas city fed", "housing starts", "building permits", "new home sales", "existing home sales", "pending home", "case-shiller", "case shiller", "house price", "nahb", "construction spending", "consumer confidence",
    "consumer sentiment", "michigan", "interest rate decision", "fomc", "fed interest rate", "fed press conference", "fed economic projection", "trade balance", "goods trade",
]
LESSER_RELEASES = [
    "cftc", "api ", "crude oil", "eia ", "auction", "redbook", "gdpnow", "rig count", "baker hughes", "mba mortgage", "money supply", "import prices", "export prices", "fed balance sheet", "speculative net positions",
]
# Census regions.
REGIONS = {
    "Northeast": "CT ME MA NH RI VT NJ NY PA".split(),
    "Midwest": "IL IN MI OH WI IA KS MN MO NE ND SD".split(),
    "South": "DE FL GA MD NC SC VA DC WV AL KY MS TN AR LA OK TX".split(),
    "West": "AZ CO ID MT NV NM UT WY AK CA HI OR WA".split(),
}
# Forms by panel, shelf registrations, exhibits by family.
PANELS = {
    "annuals": ["10-K", "10-K/A", "10-Q", "10-Q/A", "11-K", "ARS"],
    "current": ["8-K", "8-K/A"],
    "mergers": ["S-4", "S-4/A", "425", "DEFM14A"],
    "proxies": ["DEF 14A", "DEFA14A", "PRE 14A"],
    "regulatory": ["SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A", "S-1", "S-1/A", "S-3", "S-3/A", "25", "25-NSE", "15-12B", "15-12G"],
}
SHELF_FORMS = ["S-1", "S-1/A", "S-3", "S-3/A", "S-3ASR", "S-3D", "S-3DPOS", "S-3MEF", "S-1MEF"]
EXHIBITS = {"21": "Subsidiaries", "3": "Charter / Bylaws", "4": "Capital Stock / Debt", "10": "Material Agreement", "99": "Press Release / Presentation"}


def any_of(patterns: list[str]) -> str:
    """One case-blind pattern of whole words."""
    return rf"(?i)\b({'|'.join(patterns)})\b"


def has(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike(any_of(patterns)), F.lit(False))


def names_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains one of the words, anywhere."""
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def release_kind(headline: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, words in RELEASE_KINDS.items():
        out = out.when(names_any(headline, words), kind)
    return out.otherwise("press_release")


def own_release(headline: Column) -> Column:
    """A company's own voice: a release's verb and no mark of commentary."""
    return ~has(headline, COMMENTARY) & has(headline, OWN_VERBS)


def routine_noise(headline: Column) -> Column:
    return has(headline, NOTES)


def material_regulatory(headline: Column) -> Column:
    return has(headline, ENFORCEMENT)


def safe_url(url: Column) -> Column:
    """False on a blocked host or below one; true without a host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/:?#]+)", 1)), "^www[.]", "")
    out = host.isin(BLOCKED_HOSTS)
    for b in BLOCKED_HOSTS:
        out = out | host.endswith(f".{b}")
    return ~F.coalesce(out, F.lit(False))


def core_release(name: Column) -> Column:
    return names_any(name, CORE_RELEASES) & ~names_any(name, LESSER_RELEASES)


def items_kind(items: Column) -> Column:
    """The kind of a current report by its array of item codes."""
    holds = lambda *codes: F.arrays_overlap(items, F.array(*map(F.lit, codes)))
    only = (F.size(items) > 0) & (F.size(F.array_except(items, F.array(F.lit("9.01")))) == 0)
    return (
        F.when(holds("2.02"), "earnings").when(only, "exhibit_only").when(holds("1.01", "2.01"), "m_and_a").when(holds("5.02"), "executive_change")
        .when(holds("7.01", "8.01"), "press_release").when(holds("5.07"), "shareholder_vote").otherwise("regulatory")
    )


def panel(form: Column, earnings: Column) -> Column:
    """The one panel of a filing; an earnings report counts as an interim; null for forms without one."""
    out = F.when(earnings, "annuals")
    for name, forms in PANELS.items():
        out = out.when(form.isin(forms), name)
    return out


def offering_bucket(form: Column) -> Column:
    f = F.upper(F.trim(form))
    return F.when(f.isin(SHELF_FORMS), "shelf").when(f.startswith("424B"), "offerings")


def exhibit_family(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for number, name in EXHIBITS.items():
        out = out.when(kind.rlike(rf"^EX-{number}([.]|$)"), name)
    return out


def region(state: Column) -> Column:
    s = F.upper(F.trim(state))
    out = F.when(F.coalesce(state, F.lit("")) == "", "Unknown")
    for name, states in REGIONS.items():
        out = out.when(s.isin(states), name)
    return out.otherwise("Other")


def business_mix(cre: Column, residential: Column, commercial: Column, noninterest: Column, consumer: Column) -> Column:
    """The first rule on shares, in percent, that holds."""
    return (
        F.when(cre >= 300, "CRE-heavy").when(residential >= 40, "Mortgage-heavy").when(commercial >= 30, "C&I-focused")
        .when((noninterest >= 30) & (consumer >= 20), "Retail-heavy").otherwise("Diversified")
    )


def grade(value: Column, good: float, warn: float, higher_better: bool = True) -> Column:
    """good, warn or bad by two thresholds in the metric's direction; null for null."""
    a, b = (value >= good, value >= warn) if higher_better else (value <= good, value <= warn)
    return F.when(a, "good").when(b, "warn").when(value.isNotNull(), "bad")


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def credit_regime(spread: Column) -> Column:
    """Tight below 3.5, Normal below 5, Elevated below 8, else Stressed; n/a for null or NaN."""
    return F.when(~_known(spread), "n/a").when(spread < 3.5, "Tight").when(spread < 5, "Normal").when(spread < 8, "Elevated").otherwise("Stressed")


def curve_shape(two: Column, three: Column) -> Column:
    """By the ten-year spreads over two years and three months."""
    return (
        F.when(two.isNull() | three.isNull(), "n/a").when((two < 0) & (three < 0), "Inverted").when((two < 0) | (three < 0), "Partially inverted")
        .when(two > 0.5, "Steep").otherwise("Flat-to-normal")
    )


def curve_direction(now: Column, before: Column) -> Column:
    d = now - before
    return F.when(d > 0.05, "steepening").when(d < -0.05, "flattening").when(d.isNotNull(), "stable").otherwise("")


def policy_path(now: Column, before: Column) -> Column:
    d = now - before
    return F.when(now.isNull(), "n/a").when(before.isNull(), "-").when(d < -0.10, "Easing").when(d > 0.10, "Tightening").otherwise("On hold")


def recession_score(two: Column, three: Column, recent: Column, low: Column) -> Column:
    """Points to 100 from two spreads and the rise of unemployment's mean of three months over its low of twelve."""
    rise = recent - low
    points = lambda x: F.coalesce(x, F.lit(0))
    return (
        points(F.when(two < -0.5, 40).when(two < 0, 20).when(two < 0.5, 5)) + points(F.when(three < -0.5, 30).when(three < 0, 15)) + points(F.when(rise > 0.5, 30).when(rise > 0.3, 15))
    )


def recession_level(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score >= 30, "medium").otherwise("low")


def segment_findings(gross: Column, segments: dict[str, Column]) -> Column:
    """Array of findings on a loan book: a segment over 110 percent of the total, or all together over 105; empty without a positive total."""
    over = [F.when(v > gross * 1.10, F.lit(k)) for k, v in segments.items()]
    known = F.filter(F.array(*segments.values()), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    every = F.array(*over, F.when(total > gross * 1.05, F.lit("sum")))
    return F.when(gross > 0, F.filter(every, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def split_finding(total: Column, a: Column, b: Column, check_low: bool) -> Column:
    """'over' where two parts exceed 105 percent of a total, 'under' (if checked) below 90, else null."""
    ratio = F.when(total > 0, (a + b) / total)
    return F.when(ratio > 1.05, "over").when(F.lit(check_low) & (ratio < 0.90), "under")


def staleness(as_of: Column, today: Column, most: int) -> Column:
    """warning over ``most`` days, error from twice that on; null where fresh or without date."""
    age = F.datediff(today, as_of)
    return F.when(age > most, F.when(age < 2 * most, "warning").otherwise("error"))


def frozen_quote(stamp: Column, now: Column) -> Column:
    """Epoch seconds over five days old; stamps before 2000, over five minutes ahead or missing prove nothing."""
    return F.coalesce((stamp >= 946684800) & (stamp <= now + 300) & (now - stamp > 5 * 86400), F.lit(False))


def premarket(ts: Column, zone: str = "America/New_York") -> Column:
    """Whether a UTC time is on a weekday from 04:00 to before 09:30 in the market's zone."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return ~F.dayofweek(local).isin(1, 7) & (minute >= 240) & (minute < 570)


def price_badge(ok: Column, seconds: Column) -> Column:
    """By the age of the newest price: live below an hour or where none is cached, as of up to 76 hours, else stale."""
    return F.when(~ok, "offline").when(seconds.isNull() | (seconds < 3600), "live").when(seconds <= 76 * 3600, "as of").otherwise("stale")


def quote_move(bid: Column, ask: Column, last: Column, spread: float = 0.012) -> Column:
    """Percent from the last price to the middle of a two-sided quote no wider than ``spread`` of it; else null."""
    mid = (bid + ask) / 2
    return F.when((bid > 0) & (ask > 0) & (last > 0) & (ask >= bid) & ((ask - bid) / mid <= spread), (mid / last - 1) * 100)


def units_scale(title: Column) -> Column:
    """Dollar scale of a title: of '$ in <unit>', else of 'in <unit>', else 1."""
    t = F.lower(title)
    unit = F.coalesce(F.nullif(F.regexp_extract(t, r"[$]\s*in\s+(thousands|millions|billions)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"\bin\s+(thousands|millions|billions)", 1), F.lit("")))
    return F.when(unit == "thousands", 1e3).when(unit == "millions", 1e6).when(unit == "billions", 1e9).otherwise(1.0)


def label_key(label: Column) -> Column:
    """A line's key across filings: without numbers, dollar signs and dashes, lower-cased, single blanks."""
    bare = F.regexp_replace(label, "[0-9,]+|[$]|[–—]", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def row_kind(label: Column, kind: Column) -> Column:
    """monetary, pershare, shares or other, by the element's type if filed, else by the label."""
    typed = F.when(kind.rlike("(?i)perShareItemType"), "pershare").when(kind.rlike("(?i)sharesItemType"), "shares").when(kind.rlike("(?i)monetaryItemType"), "monetary").otherwise("other")
    told = F.when(label.rlike(r"(?i)per\s+share|per\s+common\s+share"), "pershare").when(label.rlike(r"(?i)\(in\s+shares\)|\bin\s+shares\b|weighted[- ]average.*shares|shares\s+outstanding"), "shares").otherwise("monetary")
    return F.when(F.coalesce(kind, F.lit("")) != "", typed).otherwise(told)


def swapped_magnitude(label: Column, value: Column) -> Column:
    """A per-share label with a value that no share has."""
    return F.coalesce(label.rlike("(?i)per share|per common share|earnings per") & (F.abs(value) > 100), F.lit(False))


def quarter_end_before(day: Column) -> Column:
    """The last quarter end strictly before a day."""
    return F.date_sub(F.trunc(day, "quarter"), 1)


def report_quarter(filed: Column) -> Column:
    """The quarter that a filing covers, as YYYYQn: the last one to end before its day."""
    end = quarter_end_before(filed)
    return F.concat(F.year(end).cast("string"), F.lit("Q"), F.quarter(end).cast("string"))


def quarters_back(end: Column, n: int) -> Column:
    """The quarter end n quarters before a quarter end."""
    return F.last_day(F.add_months(end, -3 * n))


def company_name(name: Column) -> Column:
    """Title case for names in capitals, with two-letter state and entity words kept upper."""
    cased = F.when(F.upper(name) == name, F.initcap(F.lower(name))).otherwise(name)
    out = F.trim(F.regexp_replace(cased, r"\s+", " "))
    for w in ("Na", "Usa", "Ii", "Iii"):
        out = F.regexp_replace(out, rf"\b{w}\b", w.upper())
    return out


def significant_tokens(text: Column, stop: list[str], least: int = 4) -> Column:
    """Distinct runs of ``least`` letters a to z or more that aren't stop words, sorted."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{least},}})"), F.lit(1)))
    return F.array_sort(F.filter(words, lambda w: ~w.isin(stop)))


def slug(text: Column, most: int = 90) -> Column:
    """Lower-case words joined by dashes, at most ``most`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def filed_quarter_end(day: Column, lag: int = 45) -> Column:
    """The newest quarter end at least ``lag`` days before a day, by when its reports are in."""
    late = F.date_sub(day, lag - 1)
    return quarter_end_before(late)

"""Classification of headlines, filings, regimes and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import rules as R
from ledgerline.functions.numbers import rounded
from ledgerline.operators import timeseries as T

from .base import SQL_DAILY, SQL_FILINGS, Tables, query

#: Headlines of the event store, by event_id.
HEADLINES = [
    "First Bank Announces Fourth Quarter Results", "Alpha Bancorp To Acquire Beta Trust", "Board declares quarterly dividend of $0.20", "Jane Roe named Chief Executive of Gamma", "Delta prices underwritten offering of senior notes",
    "Analyst upgrades Epsilon, raises price target", "OCC fined Zeta Bank over controls", "Consent order against Eta Bank", "Buffered notes linked to an index", "How should you buy bank stocks", "Theta Bank opens a branch",
    "Iota completes merger with Kappa", "Lawsuit settled with the FDIC", "Market-linked notes due 2030", "Top 5 bank stocks", "Lambda schedules conference call", "FISCAL year report by Mu", "",
]
URLS = ["https://www.reddit.com/r/banks", "https://example.com/a", "http://sub.facebook.com:80/x", "https://prs.example.org/bit.ly", "https://BIT.LY/abc", "no link", "https://notx.com/1"]
RELEASES = ["CPI (YoY)", "Crude Oil CPI Stocks", "Retail Sales", "MBA Mortgage Applications", "ISM Services", "Baker Hughes Rig Count", "Fed Chair speech", "GDPNow", "Nonfarm Payrolls"]
TITLES = ["Income - USD ($) shares in Thousands, $ in Millions", "Balance in thousands", "Notes", "Cash (USD $) $ in Billions", "shares in Thousands"]
LABELS = [
    ("Securities, net of allowance of $75 and $69", ""), ("Basic", "num:perShareItemType"), ("Basic", "sharesItemType"), ("Earnings per share – diluted", ""), ("Common stock (in shares)", ""), ("Weighted-average diluted shares", ""), ("Interest income", "us-gaap:monetaryItemType"),
    ("Total", "stringItemType"), ("Cash 1,234 —  2020", ""),
]
STATES = ["CT", "oh ", "TX", "HI", "PR", "", "zz"]
FORMS = ["10-K", "8-K", "425", "DEF 14A", "SC 13G/A", "424B5", "S-3ASR", "6-K", "S-1"]
ITEMS = [["2.02", "9.01"], ["9.01"], ["1.01", "7.01"], ["5.02"], ["8.01", "9.01"], ["5.07"], ["3.01"], []]
EXHIBITS = ["EX-21.1", "EX-3", "EX-31.1", "EX-4.2", "EX-10.14", "EX-99", "EX-101.INS", "EX-2"]


def _pick(values: list, key: str):
    """One of a short list of cases by a key; the list is a literal in the plan."""
    return F.element_at(F.array(*(F.array(*map(F.lit, v)) if isinstance(v, list) and v else F.array().cast("array<string>") if isinstance(v, list) else F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _text(values: list) -> str:
    show = lambda v: "[" + ", ".join(map(show, v)) + "]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(f"{show(v)}::VARCHAR[]" if isinstance(v, list) else show(v) for v in values) + "]"


def _chosen(values: list, key: str) -> str:
    return f"({_text(values)})[CAST({key} % {len(values)} + 1 AS INTEGER)]"


def _has(text: str, patterns: list[str]) -> str:
    return "regexp_matches(" + text + ", '" + R.any_of(patterns).replace("'", "''") + "')"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


@query(
    "headline_rules",
    f"""WITH h AS (SELECT event_id, {_chosen(HEADLINES, "event_id")} AS h FROM events)
SELECT event_id, CASE {" ".join(f"WHEN {_any('h', w)} THEN '{k}'" for k, w in R.RELEASE_KINDS.items())} ELSE 'press_release' END AS kind, NOT {_has("h", R.COMMENTARY)} AND {_has("h", R.OWN_VERBS)} AS own_release,
  {_has("h", R.NOTES)} AS routine_noise, {_has("h", R.ENFORCEMENT)} AS material_regulatory, substr(trim(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '-'), 1, 90) AS slug,
  array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(h), '[a-z]{{4,}}')), lambda w: w NOT IN ('bank', 'trust', 'quarter'))), ' ') AS tokens FROM h""",
)
def headline_rules(t: Tables) -> DataFrame:
    h = t.events.select("event_id", _pick(HEADLINES, "event_id").alias("h"))
    c = F.col("h")
    return h.select(
        "event_id", R.release_kind(c).alias("kind"), R.own_release(c).alias("own_release"), R.routine_noise(c).alias("routine_noise"), R.material_regulatory(c).alias("material_regulatory"), R.slug(c).alias("slug"),
        F.array_join(R.significant_tokens(c, ["bank", "trust", "quarter"]), " ").alias("tokens"),
    )


@query(
    "safe_urls",
    f"""WITH u AS (SELECT event_id, regexp_replace(lower(regexp_extract({_chosen(URLS, "event_id")}, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www[.]', '') AS h FROM events), b AS (SELECT unnest({_text(R.BLOCKED_HOSTS)}) AS b)
SELECT event_id, NOT EXISTS (SELECT 1 FROM b WHERE h = b OR ends_with(h, '.' || b)) AS safe FROM u""",
)
def safe_urls(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.safe_url(_pick(URLS, "event_id")).alias("safe"))


@query("core_releases", f"WITH r AS (SELECT event_id, {_chosen(RELEASES, 'event_id')} AS n FROM events) SELECT event_id, n AS name, {_any('n', R.CORE_RELEASES)} AND NOT {_any('n', R.LESSER_RELEASES)} AS core FROM r")
def core_releases(t: Tables) -> DataFrame:
    n = _pick(RELEASES, "event_id")
    return t.events.select("event_id", n.alias("name"), R.core_release(n).alias("core"))


@query(
    "junk_purged",
    f"""WITH h AS (SELECT event_id, {_chosen(HEADLINES, "event_id")} AS h, {_chosen(URLS, "event_id // 7")} AS u FROM events), p AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www[.]', '') AS host FROM h),
b AS (SELECT unnest({_text(R.BLOCKED_HOSTS)}) AS b)
SELECT event_id, h AS headline FROM p WHERE NOT {_has("h", R.NOTES)} AND NOT EXISTS (SELECT 1 FROM b WHERE host = b OR ends_with(host, '.' || b))""",
)
def junk_purged(t: Tables) -> DataFrame:
    h = t.events.select("event_id", _pick(HEADLINES, "event_id").alias("headline"), F.floor(F.col("event_id") / 7).alias("k")).withColumn("u", _pick(URLS, "k"))
    return h.where(~R.routine_noise(F.col("headline")) & R.safe_url(F.col("u"))).select("event_id", "headline")


def _form_sql(forms: list[str]) -> str:
    return ", ".join(f"'{f}'" for f in forms)


@query(
    "filing_panels",
    f"""WITH f AS (SELECT event_id, {_chosen(FORMS, "event_id")} AS form, {_chosen(ITEMS, "event_id // 9")} AS items, {_chosen(EXHIBITS, "event_id // 5")} AS ex FROM events), e AS (SELECT *, form = '8-K' AND list_contains(items, '2.02') AS er FROM f)
SELECT event_id, CASE WHEN er THEN 'annuals' {" ".join(f"WHEN form IN ({_form_sql(v)}) THEN '{k}'" for k, v in R.PANELS.items())} END AS panel,
  CASE WHEN form IN ({_form_sql(R.SHELF_FORMS)}) THEN 'shelf' WHEN starts_with(form, '424B') THEN 'offerings' END AS bucket,
  CASE {" ".join(f"WHEN regexp_matches(ex, '^EX-{k}([.]|$)') THEN '{v}'" for k, v in R.EXHIBITS.items())} END AS family,
  CASE WHEN list_contains(items, '2.02') THEN 'earnings' WHEN len(items) > 0 AND len(list_filter(items, lambda x: x <> '9.01')) = 0 THEN 'exhibit_only' WHEN list_has_any(items, ['1.01', '2.01']) THEN 'm_and_a'
    WHEN list_contains(items, '5.02') THEN 'executive_change' WHEN list_has_any(items, ['7.01', '8.01']) THEN 'press_release' WHEN list_contains(items, '5.07') THEN 'shareholder_vote' ELSE 'regulatory' END AS kind FROM e""",
)
def filing_panels(t: Tables) -> DataFrame:
    f = t.events.select("event_id", F.floor(F.col("event_id") / 9).alias("a"), F.floor(F.col("event_id") / 5).alias("b"))
    f = f.select("event_id", _pick(FORMS, "event_id").alias("form"), _pick(ITEMS, "a").alias("items"), _pick(EXHIBITS, "b").alias("ex"))
    earnings = (F.col("form") == "8-K") & F.array_contains("items", "2.02")
    return f.select("event_id", R.panel(F.col("form"), earnings).alias("panel"), R.offering_bucket(F.col("form")).alias("bucket"), R.exhibit_family(F.col("ex")).alias("family"), R.items_kind(F.col("items")).alias("kind"))


@query(
    "statement_labels",
    f"""WITH l AS (SELECT event_id, {_chosen([a for a, _ in LABELS], "event_id")} AS label, {_chosen([b for _, b in LABELS], "event_id")} AS kind, {_chosen(TITLES, "event_id")} AS title, value FROM events),
u AS (SELECT *, coalesce(nullif(regexp_extract(lower(title), '[$]\\s*in\\s+(thousands|millions|billions)', 1), ''), regexp_extract(lower(title), '\\bin\\s+(thousands|millions|billions)', 1)) AS unit FROM l)
SELECT event_id, lower(trim(regexp_replace(regexp_replace(label, '[0-9,]+|[$]|[–—]', '', 'g'), '\\s+', ' ', 'g'))) AS label_key,
  CASE WHEN kind <> '' THEN CASE WHEN contains(kind, 'perShareItemType') THEN 'pershare' WHEN contains(kind, 'sharesItemType') THEN 'shares' WHEN contains(kind, 'monetaryItemType') THEN 'monetary' ELSE 'other' END
    WHEN regexp_matches(label, '(?i)per\\s+share|per\\s+common\\s+share') THEN 'pershare' WHEN regexp_matches(label, '(?i)\\(in\\s+shares\\)|\\bin\\s+shares\\b|weighted[- ]average.*shares|shares\\s+outstanding') THEN 'shares' ELSE 'monetary' END AS row_kind,
  CASE unit WHEN 'thousands' THEN 1e3 WHEN 'millions' THEN 1e6 WHEN 'billions' THEN 1e9 ELSE 1e0 END AS scale, regexp_matches(label, '(?i)per share|per common share|earnings per') AND abs(value) > 100 AS swapped FROM u""",
)
def statement_labels(t: Tables) -> DataFrame:
    l = t.events.select("event_id", "value", _pick([a for a, _ in LABELS], "event_id").alias("label"), _pick([b for _, b in LABELS], "event_id").alias("kind"), _pick(TITLES, "event_id").alias("title"))
    c = F.col
    return l.select("event_id", R.label_key(c("label")).alias("label_key"), R.row_kind(c("label"), c("kind")).alias("row_kind"), R.units_scale(c("title")).alias("scale"), R.swapped_magnitude(c("label"), c("value")).alias("swapped"))


@query(
    "regimes",
    f"""WITH {SQL_FILINGS}, x AS (SELECT bank, qi, CASE WHEN k % 7 <> 0 THEN k % 100 / 10e0 END AS oas, CASE WHEN k % 11 <> 0 THEN (k % 41 - 20) / 20e0 END AS s2, (k % 31 - 15) / 15e0 AS s3, CASE WHEN k % 5 <> 0 THEN (k % 13) / 20e0 END AS p2
  FROM (SELECT *, bank * 31 + qi * 17 AS k FROM filings))
SELECT bank, qi, CASE WHEN oas IS NULL THEN 'n/a' WHEN oas < 3.5 THEN 'Tight' WHEN oas < 5 THEN 'Normal' WHEN oas < 8 THEN 'Elevated' ELSE 'Stressed' END AS credit,
  CASE WHEN s2 IS NULL THEN 'n/a' WHEN s2 < 0 AND s3 < 0 THEN 'Inverted' WHEN s2 < 0 OR s3 < 0 THEN 'Partially inverted' WHEN s2 > 0.5 THEN 'Steep' ELSE 'Flat-to-normal' END AS curve,
  CASE WHEN s2 - p2 > 0.05::DOUBLE THEN 'steepening' WHEN s2 - p2 < -0.05::DOUBLE THEN 'flattening' WHEN s2 - p2 IS NOT NULL THEN 'stable' ELSE '' END AS direction,
  CASE WHEN s2 IS NULL THEN 'n/a' WHEN p2 IS NULL THEN '-' WHEN s2 - p2 < -0.1::DOUBLE THEN 'Easing' WHEN s2 - p2 > 0.1::DOUBLE THEN 'Tightening' ELSE 'On hold' END AS path FROM x""",
)
def regimes(t: Tables) -> DataFrame:
    k = t.filings().withColumn("k", F.expr("bank * 31 + qi * 17"))
    x = k.select("bank", "qi", F.expr("case when k % 7 <> 0 then k % 100 / 10e0 end").alias("oas"), F.expr("case when k % 11 <> 0 then (k % 41 - 20) / 20e0 end").alias("s2"), F.expr("(k % 31 - 15) / 15e0").alias("s3"), F.expr("case when k % 5 <> 0 then (k % 13) / 20e0 end").alias("p2"))
    c = F.col
    return x.select("bank", "qi", R.credit_regime(c("oas")).alias("credit"), R.curve_shape(c("s2"), c("s3")).alias("curve"), R.curve_direction(c("s2"), c("p2")).alias("direction"), R.policy_path(c("s2"), c("p2")).alias("path"))


@query(
    "recession_score",
    f"""WITH {SQL_FILINGS}, x AS (SELECT bank, qi, (k % 41 - 20) / 20e0 AS s2, (k % 31 - 15) / 15e0 AS s3, (k % 23) / 20e0 AS u FROM (SELECT *, bank * 31 + qi * 17 AS k FROM filings)),
w AS (SELECT *, CASE WHEN count(u) OVER l = 12 THEN avg(u) OVER (PARTITION BY bank ORDER BY qi ROWS 2 PRECEDING) - min(u) OVER l END AS rise FROM x WINDOW l AS (PARTITION BY bank ORDER BY qi ROWS 11 PRECEDING)),
s AS (SELECT bank, qi, CASE WHEN s2 < -0.5 THEN 40 WHEN s2 < 0 THEN 20 WHEN s2 < 0.5 THEN 5 ELSE 0 END + CASE WHEN s3 < -0.5 THEN 30 WHEN s3 < 0 THEN 15 ELSE 0 END + CASE WHEN rise > 0.5 THEN 30 WHEN rise > 0.3 THEN 15 ELSE 0 END AS score FROM w)
SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM s""",
)
def recession_score(t: Tables) -> DataFrame:
    k = t.filings().withColumn("k", F.expr("bank * 31 + qi * 17"))
    x = k.select("bank", "qi", F.expr("(k % 41 - 20) / 20e0").alias("s2"), F.expr("(k % 31 - 15) / 15e0").alias("s3"), F.expr("(k % 23) / 20e0").alias("u"))
    w = T.by("bank", "qi")
    year = w.rowsBetween(-11, 0)
    full = F.count("u").over(year) == 12
    score = R.recession_score(F.col("s2"), F.col("s3"), F.when(full, F.avg("u").over(w.rowsBetween(-2, 0))), F.when(full, F.min("u").over(year)))
    return x.select("bank", "qi", score.alias("score")).withColumn("level", R.recession_level(F.col("score")))


@query(
    "bank_classes",
    f"""SELECT c_custkey, CASE WHEN k % 400 >= 300 THEN 'CRE-heavy' WHEN k % 61 >= 40 THEN 'Mortgage-heavy' WHEN k % 47 >= 30 THEN 'C&I-focused' WHEN k % 43 >= 30 AND k % 29 >= 20 THEN 'Retail-heavy' ELSE 'Diversified' END AS mix,
  CASE WHEN s = '' THEN 'Unknown' {" ".join(f"WHEN upper(trim(s)) IN ({_form_sql(v)}) THEN '{n}'" for n, v in R.REGIONS.items())} ELSE 'Other' END AS region,
  CASE WHEN v IS NULL THEN NULL WHEN v >= 5000 THEN 'good' WHEN v >= 1000 THEN 'warn' ELSE 'bad' END AS up, CASE WHEN v IS NULL THEN NULL WHEN v <= 1000 THEN 'good' WHEN v <= 5000 THEN 'warn' ELSE 'bad' END AS down
FROM (SELECT c_custkey, c_custkey * 7 AS k, {_chosen(STATES, "c_custkey")} AS s, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer)""",
)
def bank_classes(t: Tables) -> DataFrame:
    k, v = F.col("c_custkey") * 7, F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", R.business_mix(k % 400, k % 61, k % 47, k % 43, k % 29).alias("mix"), R.region(_pick(STATES, "c_custkey")).alias("region"), R.grade(v, 5000, 1000).alias("up"), R.grade(v, 1000, 5000, False).alias("down"))


@query(
    "composition_checks",
    """WITH s AS (SELECT o_custkey AS bank, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS a, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS b, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS c FROM orders GROUP BY 1),
g AS (SELECT *, coalesce(a, 0) * (1 + bank % 3) / 2e0 AS gross FROM s)
SELECT bank, CASE WHEN gross > 0 THEN array_to_string(list_filter([CASE WHEN a > gross * 1.10 THEN 'a' END, CASE WHEN b > gross * 1.10 THEN 'b' END, CASE WHEN c > gross * 1.10 THEN 'c' END,
    CASE WHEN coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) > gross * 1.05 THEN 'sum' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS findings,
  CASE WHEN gross > 0 AND (a + b) / gross > 1.05 THEN 'over' WHEN gross > 0 AND (a + b) / gross < 0.90 THEN 'under' END AS split FROM g""",
)
def composition_checks(t: Tables) -> DataFrame:
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    s = t.orders.groupBy(F.col("o_custkey").alias("bank")).agg(part("O").alias("a"), part("F").alias("b"), part("P").alias("c"))
    gross, c = F.coalesce("a", F.lit(0.0)) * (1 + F.col("bank") % 3) / 2, F.col
    return s.select("bank", F.array_join(R.segment_findings(gross, {n: c(n) for n in "abc"}), ",").alias("findings"), R.split_finding(gross, c("a"), c("b"), True).alias("split"))


@query(
    "quote_states",
    """WITH q AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(ts AS DATE) AS d, value, event_id % 11 AS k FROM events), n AS (SELECT *, 1705752000 AS now FROM q)
SELECT event_id, CASE WHEN DATE '2024-01-20' - d > 5 THEN CASE WHEN DATE '2024-01-20' - d < 10 THEN 'warning' ELSE 'error' END END AS stale,
  coalesce(f >= 946684800 AND f <= now + 300 AND now - f > 432000, false) AS frozen, CASE WHEN k = 0 THEN 'offline' WHEN k = 1 OR now - s < 3600 THEN 'live' WHEN now - s <= 273600 THEN 'as of' ELSE 'stale' END AS badge,
  round(CASE WHEN bid > 0 AND ask >= bid AND (ask - bid) / ((bid + ask) / 2) <= 0.012 AND last > 0 THEN ((bid + ask) / 2 / last - 1) * 100 END * 1e6) / 1e6 AS move
FROM (SELECT *, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN 5 ELSE s END AS f, value AS bid, value * (1 + k / 800e0) AS ask, 50e0 - k * 5e0 AS last FROM n)""",
)
def quote_states(t: Tables) -> DataFrame:
    s, k, v, now = F.unix_seconds(F.col("ts").cast("timestamp")), F.col("event_id") % 11, F.col("value"), F.lit(1705752000)
    stamp = F.when(k == 2, None).when(k == 3, 5).otherwise(s)
    return t.events.select(
        "event_id", R.staleness(F.to_date("ts"), F.lit("2024-01-20").cast("date"), 5).alias("stale"), R.frozen_quote(stamp, now).alias("frozen"), R.price_badge(k != 0, F.when(k != 1, now - s)).alias("badge"),
        rounded(R.quote_move(v, v * (1 + k / 800.0), 50.0 - k * 5.0), 6).alias("move"),
    )


@query(
    "premarket",
    """WITH y AS (SELECT DISTINCT CAST(year(ts) AS INTEGER) AS y FROM events WHERE ts IS NOT NULL), m AS (SELECT y, make_date(y, 3, 1) AS a, make_date(y, 11, 1) AS b FROM y),
z AS (SELECT y, CAST(a + CAST((7 - dayofweek(a)) % 7 + 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 7 HOUR AS starts, CAST(b + CAST((7 - dayofweek(b)) % 7 AS INTEGER) AS TIMESTAMP) + INTERVAL 6 HOUR AS ends FROM m),
l AS (SELECT event_id, CASE WHEN ts >= starts AND ts < ends THEN ts - INTERVAL 4 HOUR ELSE ts - INTERVAL 5 HOUR END AS l FROM events LEFT JOIN z ON y = year(ts))
SELECT event_id, extract(dow FROM l) NOT IN (0, 6) AND extract(hour FROM l) * 60 + extract(minute FROM l) BETWEEN 240 AND 569 AS premarket FROM l""",
)
def premarket(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.premarket(F.col("ts").cast("timestamp")).alias("premarket"))


@query(
    "calendar_quarters",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), q AS (SELECT *, CAST(date_trunc('quarter', d) AS DATE) - 1 AS e, CAST(date_trunc('quarter', d - 44) AS DATE) - 1 AS f FROM d)
SELECT o_orderkey, e AS before, year(e) || 'Q' || quarter(e) AS report_quarter, last_day(e - INTERVAL 3 MONTH) AS minus_one, last_day(e - INTERVAL 12 MONTH) AS year_ago, f AS filed FROM q""",
    dates=["before", "minus_one", "year_ago", "filed"],
)
def calendar_quarters(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    e = R.quarter_end_before(d)
    return t.orders.select("o_orderkey", e.alias("before"), R.report_quarter(d).alias("report_quarter"), R.quarters_back(e, 1).alias("minus_one"), R.quarters_back(e, 4).alias("year_ago"), R.filed_quarter_end(d).alias("filed"))


@query(
    "last_move",
    f"""WITH {SQL_DAILY}, m AS (SELECT series, d, n / 4 AS v FROM (SELECT series, d, n // 4 * 4 AS n FROM daily)), c AS (SELECT *, v - lag(v) OVER (PARTITION BY series ORDER BY d) AS dv FROM m),
l AS (SELECT series, max_by(dv, d) FILTER (WHERE dv <> 0) AS dv, max(d) FILTER (WHERE dv <> 0) AS moved FROM c GROUP BY 1)
SELECT series, CASE WHEN dv > 0 THEN 'hike' WHEN dv < 0 THEN 'cut' ELSE 'hold' END AS direction, CAST(coalesce(round(dv * 100), 0) AS BIGINT) AS bps, moved FROM l""",
    dates=["moved"],
)
def last_move(t: Tables) -> DataFrame:
    return T.last_move(t.daily().select("series", "d", F.floor(F.col("n") / 4).cast("double").alias("v")), "series", "d", "v")


@query(
    "trend_arrow",
    f"""WITH {SQL_DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS k FROM daily WHERE v IS NOT NULL)
SELECT series, CASE WHEN max_by(v, d) - min_by(v, d) > 0.05 THEN 'up' WHEN max_by(v, d) - min_by(v, d) < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM k WHERE k <= 10 GROUP BY 1""",
)
def trend_arrow(t: Tables) -> DataFrame:
    return T.trend(t.daily(), "series", "d", "v", 10)


@query(
    "zscore_latest",
    f"""WITH {SQL_DAILY}, c AS (SELECT *, max(d) OVER (PARTITION BY series) AS last FROM daily WHERE v IS NOT NULL), g AS (SELECT series, last, max_by(v, d) AS v, count(*) FILTER (WHERE near) AS k, avg(v) FILTER (WHERE near) AS m1, stddev_samp(v) FILTER (WHERE near) AS s1,
  count(*) AS k2, avg(v) AS m2, stddev_samp(v) AS s2 FROM (SELECT *, d >= last - 20 AS near FROM c) GROUP BY 1, 2)
SELECT series, round(CASE WHEN k >= 12 AND s1 > 0 THEN (v - m1) / s1 WHEN k < 12 AND k2 >= 12 AND s2 > 0 THEN (v - m2) / s2 END, 6) AS z FROM g""",
)
def zscore_latest(t: Tables) -> DataFrame:
    return T.zscore_latest(t.daily(), "series", "d", "v", 20).select("series", F.round("z", 6).alias("z"))

"""Grids of what was known when, and deals from opening to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import episodes as E
from ledgerline.operators import knowledge as K

from .base import SQL_FILINGS, Tables, query

DAYS = ["1996-06-30", "1998-02-10", "2001-12-31"]
FIRST, LAST = "1993-03-31", "1997-12-31"
#: Filed 40 days after the quarter; some again after 300 days, 3 percent up; some withdrawn after 500.
SQL_KNOWN = f"""{SQL_FILINGS}, own AS (SELECT *, bank * 31 + qi * 17 AS k, last_day(make_date(qi // 4, qi % 4 * 3 + 3, 1)) AS e FROM filings WHERE (bank + qi) % 4 <> 1),
facts AS (SELECT bank, e AS period, e + 40 AS filed, revenue * 10 AS equity, CASE WHEN k % 3 > 0 THEN CAST(1000 + k % 500 AS DOUBLE) END AS shares FROM own
  UNION ALL SELECT bank, e, e + 300, revenue * 10.3e0, CASE WHEN k % 3 > 0 THEN CAST(900 + k % 500 AS DOUBLE) END FROM own WHERE k % 5 = 0 UNION ALL SELECT bank, e, e + 500, NULL, NULL FROM own WHERE k % 7 = 0),
days AS (SELECT CAST(unnest(['{DAYS[0]}', '{DAYS[1]}', '{DAYS[2]}']) AS DATE) AS known_on),
quarters AS (SELECT last_day(make_date(x // 4, x % 4 * 3 + 3, 1)) AS quarter FROM (SELECT unnest(range(1993 * 4, 1998 * 4)) AS x)),
newest AS (SELECT * FROM facts JOIN days ON filed <= known_on QUALIFY row_number() OVER (PARTITION BY bank, period, known_on ORDER BY filed DESC) = 1),
grid AS (SELECT n.*, quarter FROM newest n JOIN quarters ON period <= quarter WHERE {{some}} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bank, known_on, quarter ORDER BY period DESC) = 1)"""


def _known(t: Tables) -> DataFrame:
    end = F.last_day(F.make_date(F.floor(F.col("qi") / 4).cast("int"), (F.col("qi") % 4 * 3 + 3).cast("int"), F.lit(1)))
    own = t.filings().where("(bank + qi) % 4 <> 1").withColumns({"k": F.expr("bank * 31 + qi * 17"), "period": end})
    told = lambda days, equity, shares: F.struct(F.date_add("period", days).alias("filed"), equity.cast("double").alias("equity"), F.when(F.col("k") % 3 > 0, shares).cast("double").alias("shares"))
    k = F.col("k")
    each = F.array(
        told(40, F.col("revenue") * 10, 1000 + k % 500), F.when(k % 5 == 0, told(300, F.col("revenue") * 10.3, 900 + k % 500)), F.when(k % 7 == 0, told(500, F.lit(None), F.lit(None)))
    )
    return own.select("bank", "period", F.explode(F.array_compact(each)).alias("x")).select("bank", "period", "x.*")


@query("known_grid", f"WITH {SQL_KNOWN.replace('{some}', 'equity')} SELECT bank, known_on, quarter, period, round(equity, 6) AS equity FROM grid WHERE date_diff('day', period, quarter) <= 400", dates=["known_on", "quarter", "period"])
def known_grid(t: Tables) -> DataFrame:
    g = K.known_grid(_known(t), "bank", "period", "filed", ["equity"], DAYS, FIRST, LAST, 400)
    return g.select("bank", "known_on", "quarter", "period", F.round("equity", 6).alias("equity"))


@query(
    "per_share_grid",
    f"""WITH {SQL_KNOWN.replace('{some}', 'equity')}, counts AS (SELECT n.*, quarter FROM newest n JOIN quarters ON period <= quarter WHERE shares IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bank, known_on, quarter ORDER BY period DESC) = 1)
SELECT bank, known_on, quarter, round(a.equity / b.shares, 6) AS value FROM (SELECT * FROM grid WHERE date_diff('day', period, quarter) <= 200) a FULL JOIN (SELECT * FROM counts WHERE date_diff('day', period, quarter) <= 400) b USING (bank, known_on, quarter)""",
    dates=["known_on", "quarter"],
)
def per_share_grid(t: Tables) -> DataFrame:
    of = lambda c, age: K.known_grid(_known(t), "bank", "period", "filed", [c], DAYS, FIRST, LAST, age)
    return K.per_share(of("equity", 200), of("shares", 400), "bank", "equity", "shares").withColumn("value", F.round("value", 6))


@query(
    "known_revisions",
    f"""WITH {SQL_KNOWN.replace('{some}', 'equity')}, l AS (SELECT bank, quarter, known_on, equity, lag(equity) OVER w AS before, row_number() OVER w AS k FROM grid WINDOW w AS (PARTITION BY bank, quarter ORDER BY known_on))
SELECT bank, quarter, known_on, round(before, 6) AS before, round(equity, 6) AS equity FROM l WHERE k > 1 AND before IS DISTINCT FROM equity""",
    dates=["known_on", "quarter"],
)
def known_revisions(t: Tables) -> DataFrame:
    g = K.revisions(K.known_grid(_known(t), "bank", "period", "filed", ["equity"], DAYS, FIRST, LAST), "bank", "equity")
    return g.where("revised").select("bank", "quarter", "known_on", F.round("before", 6).alias("before"), F.round("equity", 6).alias("equity"))


SQL_DEALS = """e AS (SELECT user_id % 40 AS acquirer, event_id % 5 AS target, event_id, CAST(ts AS DATE) AS d, CASE event_type WHEN 'click' THEN 'opening' WHEN 'purchase' THEN 'completion' WHEN 'error' THEN 'termination' END AS kind, ts FROM events),
f AS (SELECT *, lag(kind) OVER w AS k0, lag(d) OVER w AS a0 FROM e WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY acquirer, target ORDER BY d, event_id)),
o AS (SELECT *, coalesce(kind = 'opening' AND k0 = 'opening' AND date_diff('day', a0, d) <= 1, false) AS again, row_number() OVER (PARTITION BY acquirer, target ORDER BY d, event_id) AS n FROM f),
s AS (SELECT acquirer, target, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS queue, CAST([] AS STRUCT(o BIGINT, r BIGINT)[]) AS done FROM o GROUP BY 1, 2
  UNION ALL SELECT o.acquirer, o.target, o.n, CASE WHEN o.again THEN queue WHEN o.kind = 'opening' THEN list_append(queue, o.event_id) ELSE queue[2:] END,
    CASE WHEN o.kind <> 'opening' AND len(queue) > 0 THEN list_append(done, {'o': queue[1], 'r': o.event_id}) ELSE done END FROM s JOIN o ON s.acquirer = o.acquirer AND s.target = o.target AND o.n = s.n + 1),
fin AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY acquirer, target ORDER BY n DESC) = 1),
deals AS (SELECT acquirer, target, x.o AS opening, x.r AS resolution FROM (SELECT acquirer, target, unnest(done) AS x FROM fin) UNION ALL SELECT acquirer, target, unnest(queue), NULL FROM fin),
named AS (SELECT x.*, o.d AS opened, r.d AS resolved, CASE WHEN r.kind IS NULL THEN 'open' WHEN r.kind = 'completion' THEN 'completed' ELSE 'terminated' END AS status FROM deals x JOIN e o ON o.event_id = x.opening LEFT JOIN e r ON r.event_id = x.resolution)"""


def _deals(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "opening").when(F.col("event_type") == "purchase", "completion").when(F.col("event_type") == "error", "termination")
    e = t.events.select((F.col("user_id") % 40).alias("acquirer"), (F.col("event_id") % 5).alias("target"), "event_id", F.to_date("ts").alias("at"), kind.alias("kind"))
    return E.episodes(e, ["acquirer", "target"], "at", "kind", "event_id", again=1)


@query("deal_episodes", f"WITH RECURSIVE {SQL_DEALS} SELECT acquirer, target, opening, opened, resolution, resolved, status FROM named", dates=["opened", "resolved"])
def deal_episodes(t: Tables) -> DataFrame:
    return _deals(t).drop("repeats")


@query(
    "pending_deals",
    f"WITH RECURSIVE {SQL_DEALS} SELECT acquirer, target, opening, date_diff('day', opened, DATE '2024-01-20') AS age, date_diff('day', opened, DATE '2024-01-20') > 10 AS stale FROM named WHERE opened <= DATE '2024-01-20' AND (resolved IS NULL OR resolved > DATE '2024-01-20')",
)
def pending_deals(t: Tables) -> DataFrame:
    return E.pending(_deals(t), "2024-01-20", stale=10).select("acquirer", "target", "opening", F.col("age").cast("long").alias("age"), "stale")

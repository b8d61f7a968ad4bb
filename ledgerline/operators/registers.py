"""Registers of entities, holdings, filings and schedules: lookups, rosters, counts and merges.

Top rows per key are ranked windows, which Spark limits before the shuffle; lists of
distinct values and counts are keyed aggregates; exclusions are anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by the order, with ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def labelled(df: DataFrame, code: str, label: str) -> DataFrame:
    """Each code once with its largest label and count of rows; null codes left out."""
    return df.where(F.col(code).isNotNull()).groupBy(code).agg(F.max(label).alias(label), F.count("*").alias("n"))


def latest_roster(df: DataFrame, key: str, year: str) -> DataFrame:
    """Rows of each key's newest year."""
    return df.withColumn("_y", F.max(year).over(Window.partitionBy(key))).where(F.col(year) == F.col("_y")).drop("_y")


def missing(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, rows, missing: rows where any of the columns is null."""
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(any_null).alias("missing"))


def named_set(df: DataFrame, name: str, members: str) -> DataFrame:
    """name and its members (text, comma-separated) as a sorted array of distinct upper-case, trimmed words."""
    words = F.filter(F.transform(F.split(members, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return df.where(F.trim(name) != "").select(F.trim(name).alias(name), F.array_sort(F.array_distinct(words)).alias(members))


def appended(history: DataFrame, record: DataFrame, date: str, today: Column, keep: int) -> DataFrame:
    """A daily history with the day's record put in or replaced, without what is older than ``keep`` days."""
    old = history.join(record.select(date).distinct(), date, "left_anti").where(F.col(date) >= F.date_sub(today, keep))
    return old.unionByName(record)


def updated(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Stored rows with the known fresh values of ``columns``; nothing is inserted, other columns stay."""
    f = fresh.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = stored.join(f, keys, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns))


def buckets(holdings: DataFrame) -> DataFrame:
    """issuer, qi, total, change_pct: all holders' shares by stored quarter and the change to the stored quarter before; null after nothing."""
    t = holdings.groupBy("issuer", "qi").agg(F.sum("shares").alias("total"))
    before = F.lag("total").over(Window.partitionBy("issuer").orderBy("qi"))
    return t.withColumn("change_pct", F.when(before != 0, (F.col("total") - before) / before * 100))


def reverse_holdings(holdings: DataFrame, most: int = 25) -> DataFrame:
    """For each issuer's ``most`` largest holders of its newest quarter the other issuers they hold in that quarter: issuer, holder, value_usd, others (count), largest_other."""
    own = top(latest_roster(holdings, "issuer", "qi"), ["issuer"], [F.desc("value_usd"), F.col("holder")], most)
    other = holdings.select("holder", "qi", F.col("issuer").alias("_o"), F.col("value_usd").alias("_v"))
    met = own.join(other, ["holder", "qi"]).groupBy("issuer", "holder", "value_usd").agg(
        F.count_if(F.col("_o") != F.col("issuer")).alias("others"), F.max(F.when(F.col("_o") != F.col("issuer"), F.struct("_v", "_o"))).alias("_b")
    )
    return met.select("issuer", "holder", "value_usd", "others", F.col("_b._o").alias("largest_other"))


def positions(holdings: DataFrame, outstanding: DataFrame, price: str) -> DataFrame:
    """Newest holdings with value at the price, percent of shares outstanding and change against the quarter before."""
    w = Window.partitionBy("issuer", "holder").orderBy("qi")
    before = F.when(F.lag("qi").over(w) == F.col("qi") - 1, F.lag("shares").over(w))
    new = latest_roster(holdings.withColumn("before", before), "issuer", "qi").join(outstanding, "issuer", "left")
    return new.select(
        "issuer", "holder", "shares", (F.col("shares") * F.col(price)).alias("position"), F.when(F.col("outstanding") > 0, F.col("shares") / F.col("outstanding") * 100).alias("pct_of_outstanding"),
        F.when(F.col("before") != 0, (F.col("shares") / F.col("before") - 1) * 100).alias("change_pct"),
    )


def roster(df: DataFrame, keys: list[str], date: str, role: str) -> DataFrame:
    """Each person once with the latest role and date."""
    return df.groupBy(*keys).agg(F.max_by(role, F.struct(date, role)).alias(role), F.max(date).alias(date))


def open_market(df: DataFrame, today: Column, days: int, n: int) -> DataFrame:
    """Purchases and sales (codes P, S) of the last days, the newest n over all issuers."""
    own = df.where(F.col("code").isin("P", "S") & (F.col("date") >= F.date_sub(today, days)))
    return own.orderBy(F.desc("date"), "id").limit(n)


def lifespan(df: DataFrame, end: str, never: Column, active: Column) -> DataFrame:
    """``end`` null where the entity is active or the end is the far-future mark."""
    return df.withColumn(end, F.when(~active & (F.col(end) != never), F.col(end)))


def direction(node: Column, gone: Column, acquirer: Column, survivor: Column) -> Column:
    """Of a structure event as a node sees it: was_acquired, acquired or other."""
    return (
        F.when((gone == node) & survivor.isNotNull() & (survivor != node), "was_acquired")
        .when(gone.isNotNull() & (gone != node) & (F.coalesce(acquirer == node, F.lit(False)) | F.coalesce(survivor == node, F.lit(False))), "acquired").otherwise("other")
    )


def absorbed(events: DataFrame, base: DataFrame, since: Column) -> DataFrame:
    """(gone, survivor, date): absorptions since a day whose survivor is in the base and whose target is not, one a target: the newest."""
    own = events.where((F.col("date") >= since) & F.col("gone").isNotNull())
    own = own.join(base.select(F.col("id").alias("survivor")), "survivor", "left_semi").join(base.select(F.col("id").alias("gone")), "gone", "left_anti")
    return own.groupBy("gone").agg(F.max(F.struct("date", "survivor")).alias("b")).select("gone", "b.survivor", "b.date")


def holder_totals(df: DataFrame, holder: str, child: str, size: str) -> DataFrame:
    """holder, total, children, largest: sizes summed over children and the largest child (ties: the smaller key); rows without holder left out."""
    own = df.where(F.col(holder).isNotNull())
    return own.groupBy(holder).agg(F.sum(size).alias("total"), F.count("*").alias("children"), F.min_by(child, F.struct((-F.col(size)).alias("s"), F.col(child))).alias("largest"))


def next_after(days: DataFrame, day: Column) -> DataFrame:
    """One row: the first day strictly after one."""
    return days.where(F.col("day") > day).agg(F.min("day").alias("next"))


def window_of(df: DataFrame, key: str, date: str, days: int) -> DataFrame:
    """Rows within ``days`` days of each key's newest date."""
    return df.withColumn("_l", F.max(date).over(Window.partitionBy(key))).where(F.datediff("_l", date) <= days).drop("_l")


def surprise_event(actual: Column, estimate: Column) -> tuple[Column, Column, Column]:
    """Of a scheduled release: surprise, surprise in percent of the estimate's size, whether it is out."""
    s = actual - estimate
    return s, F.when(estimate != 0, s / F.abs(estimate) * 100), actual.isNotNull()


def soonest(df: DataFrame, key: str, date: str, today: Column, rest: list[str]) -> DataFrame:
    """Each key's soonest row from today on, with the columns ``rest``; ties by their order."""
    best = df.where(F.col(date) >= today).groupBy(key).agg(F.min(F.struct(date, *rest)).alias("b"))
    return best.select(key, F.col(f"b.{date}").alias(date), *(F.col(f"b.{c}").alias(c) for c in rest))


def agenda(a: DataFrame, b: DataFrame, key: str, date: str) -> DataFrame:
    """Two calendars' soonest rows merged: key, the earlier date, whether both name the same day (confirmed)."""
    j = a.select(key, F.col(date).alias("_a")).join(b.select(key, F.col(date).alias("_b")), key, "full")
    return j.select(key, F.least("_a", "_b").alias(date), F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("confirmed"))


def spread(a: DataFrame, b: DataFrame, date: str, value: str) -> DataFrame:
    """The difference of two series on the days that both have."""
    return a.select(date, F.col(value).alias("_a")).join(b.select(date, F.col(value).alias("_b")), date).select(date, (F.col("_a") - F.col("_b")).alias("spread")).where("spread is not null")


def valid_holdings(df: DataFrame, symbol: str, weight: str) -> DataFrame:
    """Rows with a symbol of letters (dots and dashes allowed) and a positive weight."""
    return df.where(F.col(symbol).rlike("^[A-Za-z][A-Za-z.-]*$") & (F.col(weight) > 0))


def choose(df: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """key, candidate: the one best candidate; none where the best score is shared."""
    w = Window.partitionBy(key)
    best = df.withColumn("_m", F.max(score).over(w)).where(F.col(score) == F.col("_m"))
    return best.groupBy(key).agg(F.count("*").alias("_n"), F.min(candidate).alias(candidate)).where("_n = 1").drop("_n")


def unique_index(names: DataFrame, name: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """Names that one entity alone bears (name, entity), and those that several do (name, n)."""
    g = names.groupBy(name).agg(F.count_distinct(entity).alias("n"), F.min(entity).alias(entity))
    return g.where("n = 1").drop("n"), g.where("n > 1").select(name, "n")


def collapsed(df: DataFrame, group: str, label: str, member: str, value: str) -> DataFrame:
    """Members of a group with one label and about equal values (1 percent, or a million) as one, the largest; other labels keep all theirs."""
    w = Window.partitionBy(group, label)
    top_value = F.max(value).over(w)
    marked = df.withColumn("_t", top_value)
    far = (F.abs(F.col(value) - F.col("_t")) > F.greatest(F.abs("_t") * 0.01, F.lit(1e6))).cast("int")
    marked = marked.withColumn("_far", far).withColumn("_mixed", F.max("_far").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc(value), member)))
    return marked.where("_mixed = 1 or _k = 1").select(group, label, member, value)


def one_of_equal(df: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Members of a group with exactly one value as one, the first by name."""
    return df.groupBy(group, value).agg(F.min(member).alias(member)).select(group, member, value)


def consolidated(df: DataFrame, keys: list[str], member: str, size: str, sums: list[str], ratios: dict[str, tuple[str, str]], averages: list[str]) -> DataFrame:
    """One record per key of its members' records: sums, ratios computed anew from sums (in percent), the largest member's id, the count.

    Ratios to average balances can't be computed from members and are null, but a single
    record passes through untouched. A sum skips missing values; null if all are missing.
    """
    n = F.count("*")
    out = df.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in sums), *(F.when(F.sum(b) != 0, F.sum(a) / F.sum(b) * 100).alias(r) for r, (a, b) in ratios.items()), *(F.when(n == 1, F.max(c)).alias(c) for c in averages),
        F.max_by(member, F.struct(F.col(size), -F.col(member))).alias("lead"), n.alias("members"),
    )
    return out


def best_of_each(df: DataFrame, key: str, metrics: dict[str, bool]) -> DataFrame:
    """metric, key, value: the best row by each metric's direction (ties: the smaller key); metrics nobody has are left out."""
    long = df.unpivot([key], list(metrics), "metric", "value").where("value is not null")
    up = F.col("metric").isin([m for m, higher in metrics.items() if higher])
    best = long.groupBy("metric").agg(F.max(F.struct(F.when(up, F.col("value")).otherwise(-F.col("value")).alias("s"), (-F.col(key)).alias("k"), "value")).alias("b"))
    return best.select("metric", (-F.col("b.k")).alias(key), "b.value")


def against_median(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """metric, key, value, median, gap: each row's known metrics beside the cohort's median."""
    long = df.unpivot([key], metrics, "metric", "value").where("value is not null")
    mid = long.groupBy("metric").agg(F.median("value").alias("median"))
    return long.join(F.broadcast(mid), "metric").select("metric", key, "value", "median", (F.col("value") - F.col("median")).alias("gap"))

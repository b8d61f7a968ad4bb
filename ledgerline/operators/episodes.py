"""Deals from announcement to end: each opening with the resolution that ends it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def episodes(events: DataFrame, pair: list[str], at: str, kind: str, event: str, again: int = 0) -> DataFrame:
    """One row a deal: pair, opening, opened, repeats, resolution, resolved, status.

    ``events``: pair columns, ``at``, ``kind`` (``opening``, ``completion``, ``termination``)
    and ``event`` (breaks ties of ``at``). A resolution ends the oldest deal of its pair that
    is open; one that finds none open ends nothing. An opening within ``again`` days of the
    one before it, with no resolution between, repeats that one and opens no deal. status:
    ``open`` (no resolution), ``completed`` or ``terminated``. Events without time, pair or
    kind are left out.

    Who ends what follows from running counts: resolutions that found nothing open are the
    running maximum of resolutions less openings, and the n-th resolution that found
    something ends the n-th opening. One shuffle by pair and no state but windows.
    """
    opening = F.col(kind) == "opening"
    rows = events.where(F.col(kind).isin("opening", "completion", "termination") & F.col(at).isNotNull())
    for c in pair:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.select(*pair, at, kind, event).repartition(*pair)
    order = Window.partitionBy(*pair).orderBy(at, event)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    repeats = opening & (F.lag(kind).over(order) == "opening") & (F.datediff(at, F.lag(at).over(order)) <= again)
    rows = rows.withColumn("_again", F.coalesce(repeats, F.lit(False)) if again > 0 else F.lit(False))
    n = lambda x: F.sum(x.cast("long")).over(so_far)
    rows = rows.withColumns({"_o": n(opening & ~F.col("_again")), "_r": n(~opening)})
    rows = rows.withColumn("_wasted", F.max(F.greatest(F.col("_r") - F.col("_o"), F.lit(0))).over(so_far))
    used = ~opening & (F.col("_wasted") == F.coalesce(F.lag("_wasted").over(order), F.lit(0)))
    rows = rows.withColumn("_n", F.when(opening, F.col("_o")).when(used, F.col("_r") - F.col("_wasted"))).where("_n is not null")
    what = F.struct(F.col(at).alias("at"), F.col(event).alias("event"), F.col(kind).alias("kind"))
    deals = rows.groupBy(*pair, "_n").agg(F.min(F.when(opening & ~F.col("_again"), what)).alias("o"), F.min(F.when(~opening, what)).alias("r"), F.sum(F.col("_again").cast("long")).alias("repeats"))
    status = F.when(F.col("r").isNull(), "open").when(F.col("r.kind") == "completion", "completed").otherwise("terminated")
    return deals.select(*pair, F.col("o.event").alias("opening"), F.col("o.at").alias("opened"), "repeats", F.col("r.event").alias("resolution"), F.col("r.at").alias("resolved"), status.alias("status"))


def pending(episodes: DataFrame, today: str, opened: str = "opened", stale: int = 730) -> DataFrame:
    """Deals open on a day, with ``age`` in days and whether they have been open for longer than ``stale`` days: those opened by then and not resolved by then."""
    day = F.to_date(F.lit(today))
    live = episodes.where((F.to_date(opened) <= day) & (F.col("resolved").isNull() | (F.to_date("resolved") > day)))
    age = F.datediff(day, F.to_date(opened))
    return live.withColumn("age", age).withColumn("stale", age > stale)

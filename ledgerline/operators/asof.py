"""As-of and interval joins: one shuffle by key, then a window over facts and probes together.

Facts of the same moment sort before probes, so a probe sees what is known at its own
time. Facts are expected once per key and moment; probes may repeat. No pair of facts and
probes is formed but the one that answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(probes: DataFrame, facts: DataFrame, key: str, at: str) -> DataFrame:
    mine = [c for c in probes.columns if c not in (key, at)]
    p = probes.select(key, at, F.lit(1).alias("_p"), F.struct(F.lit(1).alias("_"), *mine).alias("_probe"))
    f = facts.select(key, at, F.lit(0).alias("_p"), F.struct(F.col(at).alias("fact_at"), *[c for c in facts.columns if c not in (key, at)]).alias("_fact"))
    return p.unionByName(f, allowMissingColumns=True)


def _answered(both: DataFrame, probes: DataFrame, facts: DataFrame, key: str, at: str, fact: Column) -> DataFrame:
    out = both.withColumn("_found", fact).where("_p = 1")
    return out.select(
        key, at, *(F.col(f"_probe.{c}").alias(c) for c in probes.columns if c not in (key, at)),
        F.col("_found.fact_at").alias("fact_at"), *(F.col(f"_found.{c}").alias(c) for c in facts.columns if c not in (key, at)),
    )


def backward(probes: DataFrame, facts: DataFrame, key: str, at: str) -> DataFrame:
    """Each probe with the last fact at or before it: probe columns, fact_at and the fact's columns; null where there is none."""
    both = _both(probes, facts, key, at)
    w = Window.partitionBy(key).orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, 0)
    return _answered(both, probes, facts, key, at, F.last("_fact", True).over(w))


def backward_repeated(probes: DataFrame, facts: DataFrame, key: str, at: str) -> DataFrame:
    """As ``backward``, for probes that share few moments: each moment is answered once and dealt back in a join, so a key's probes don't meet in one task."""
    moments = probes.select(F.col(key).alias("_key"), F.col(at).alias("_at")).distinct()
    answers = backward(moments, facts.withColumnsRenamed({key: "_key", at: "_at"}), "_key", "_at")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(at).eqNullSafe(F.col("_at"))
    return probes.join(answers, same).drop("_key", "_at")


def forward(probes: DataFrame, facts: DataFrame, key: str, at: str) -> DataFrame:
    """Each probe with the first fact at or after it."""
    both = _both(probes, facts, key, at)
    w = Window.partitionBy(key).orderBy(F.desc(at), "_p").rowsBetween(Window.unboundedPreceding, 0)
    return _answered(both, probes, facts, key, at, F.last("_fact", True).over(w))


def fresh(joined: DataFrame, at: str, days: int, columns: list[str]) -> DataFrame:
    """Nulls the fact's columns where it is more than ``days`` away from the probe."""
    near = F.abs(F.datediff(at, "fact_at")) <= days
    return joined.select(*[c for c in joined.columns if c not in (*columns, "fact_at")], *(F.when(near, F.col(c)).alias(c) for c in ("fact_at", *columns)))


def nearest(probes: DataFrame, facts: DataFrame, key: str, at: str, ahead: int, back: int, value: str) -> DataFrame:
    """The first fact within ``ahead`` days at or after the probe, else the last within ``back`` days before it."""
    both = _both(probes, facts, key, at)
    up = Window.partitionBy(key).orderBy(F.desc(at), "_p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_up", F.last("_fact", True).over(up)).withColumn("_down", F.last("_fact", True).over(down))
    pick = F.when(F.datediff("_up.fact_at", at) <= ahead, F.col("_up")).when(F.datediff(F.col(at), F.col("_down.fact_at")) <= back, F.col("_down"))
    return _answered(both, probes, facts, key, at, pick)


def newest_within(left: DataFrame, right: DataFrame, key: str, at: str, days: int, right_at: str, order: list[str]) -> DataFrame:
    """Each row of ``left`` with the newest row of ``right`` from its day to ``days`` later, ties by ``order``; only matches, repeated rows each.

    Right rows enter the buckets of ``days`` + 1 days that they can answer, so the join is an equi-join.
    """
    span = days + 1
    day = lambda c: F.floor(F.unix_date(F.to_date(c)) / span)
    times = left.groupBy(*left.columns).agg(F.count("*").alias("_n"))  # equal rows have equal answers
    l = times.withColumn("_b", F.explode(F.array(day(at), day(at) + 1)))
    r = right.withColumn("_b", day(right_at))
    apart = F.datediff(F.to_date(right_at), F.to_date(at))
    met = l.join(r, [key, "_b"]).where((apart >= 0) & (apart <= days)).drop("_b")
    w = Window.partitionBy(*(met[c] for c in left.columns)).orderBy(F.desc(right_at), *order)
    first = met.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")

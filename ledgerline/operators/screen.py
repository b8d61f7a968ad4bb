"""The screening language: an ordered AND of filter specs over banks with history.

A spec's verdict is true, false or unknown (null: no data). The first spec that isn't true
decides: false drops a bank, unknown drops it and counts it as without data.

Kinds: absolute (metric op value), peer (percentile band within the scope), change (difference to 1
or 4 quarters back against a value) and trend (n strict moves up or down).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .peers import hazen

EQUAL_WITHIN = 0.005


@dataclass(frozen=True)
class Spec:
    kind: str
    metric: str
    op: str = ">"
    value: float = 0.0
    periods: int = 1


def compare(x: Column, op: str, value: float) -> Column:
    if op == "=":
        return F.abs(x - value) <= EQUAL_WITHIN
    return {">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}[op]


def verdict(spec: Spec, scope: list[str]) -> Column:
    """``metric`` is a column for absolute and peer specs; for change and trend an array column, newest first."""
    x = F.col(spec.metric)
    if spec.kind == "absolute":
        return compare(x, spec.op, spec.value)
    if spec.kind == "peer":
        share = hazen(scope, spec.metric)
        return share >= 100 - spec.value if spec.op == "top" else share <= spec.value
    if spec.kind == "change":
        return compare(F.get(x, F.lit(0)) - F.get(x, F.lit(spec.periods)), spec.op, spec.value)
    if spec.kind == "trend":
        moves = [F.get(x, F.lit(k)) - F.get(x, F.lit(k + 1)) for k in range(spec.periods)]
        known = F.lit(True)
        for m in moves:
            known = known & m.isNotNull()
        held = F.lit(True)
        for m in moves:
            held = held & ((m > 0) if spec.op == "up" else (m < 0))
        return F.when(known, held)
    return F.lit(None).cast("boolean")


def screen(df: DataFrame, specs: list[Spec], scope: list[str]) -> DataFrame:
    """Adds ``outcome``: keep, fail or nodata, by the first spec that isn't true. Percentiles are over all rows of the scope."""
    names = [f"_v{k}" for k in range(len(specs))]
    judged = df.select("*", *(verdict(s, scope).alias(n) for s, n in zip(specs, names)))
    outcome = F.lit("keep")
    for n in reversed(names):
        outcome = F.when(F.col(n).isNull(), "nodata").when(~F.col(n), "fail").otherwise(outcome)
    return judged.withColumn("outcome", outcome).drop(*names)

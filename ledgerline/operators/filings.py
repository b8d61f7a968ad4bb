"""Statements and compositions from filed facts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_filed(df: DataFrame, keys: list[str], filed: str) -> DataFrame:
    """Of rows with equal keys the one filed last (ties: larger value); no window, a keyed maximum."""
    rest = [c for c in df.columns if c not in (*keys, filed)]
    return df.groupBy(*keys).agg(F.max(F.struct(filed, *rest)).alias("_b")).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in (filed, *rest)))


def stitched(df: DataFrame, keys: list[str], filing: str, value: str) -> DataFrame:
    """Each cell from the newest filing that has it: the newest filing owns a period, older ones fill its holes. Adds ``source``."""
    best = F.max_by(F.struct(value, filing), F.when(F.col(value).isNotNull(), F.col(filing)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{value}").alias(value), F.col(f"_b.{filing}").alias("source"))


def quarter_from_durations(df: DataFrame, keys: list[str], start: str, end: str, value: str) -> DataFrame:
    """Quarter values of facts with durations: direct ones of 80 to 100 days, else the difference of two with one start whose ends lie so far apart. keys, end, value, derived."""
    days = F.datediff(end, start)
    w = Window.partitionBy(*keys, start).orderBy(end)
    gap = F.datediff(F.col(end), F.lag(end).over(w))
    step = F.when(gap.between(80, 100), F.col(value) - F.lag(value).over(w))
    rows = df.withColumn("_direct", F.when(days.between(80, 100), F.col(value))).withColumn("_step", step)
    out = rows.groupBy(*keys, end).agg(F.max("_direct").alias("_d"), F.max("_step").alias("_s"))
    return out.select(*keys, end, F.coalesce("_d", "_s").alias(value), (F.col("_d").isNull() & F.col("_s").isNotNull()).alias("derived")).where(F.col(value).isNotNull())


def row_value(sign_terms: list[tuple[int, Column]], denominator: bool = False) -> Column:
    """An expression row A + B - C: a numerator skips missing terms (null if all are); a denominator needs every term, and a positive sum."""
    known = [F.coalesce(F.lit(float(s)) * c, F.lit(0.0)) for s, c in sign_terms]
    total = sum(known[1:], known[0])
    some, every = F.lit(False), F.lit(True)
    for _, c in sign_terms:
        some, every = some | c.isNotNull(), every & c.isNotNull()
    return F.when(every & (total > 0), total) if denominator else F.when(some, total)


def searched_subset(values: list[float], total: float, tolerance: float, budget: int | None = 200_000) -> tuple[str, list[int]]:
    """Status and positions: 'unique' with the only subset that sums to the total within a tolerance, 'several', 'none', or 'exhausted' after ``budget`` steps (None: never)."""
    order = sorted(range(len(values)), key=lambda k: -values[k])
    rest = [0.0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        rest[i] = rest[i + 1] + max(0.0, values[order[i]])
    found: list[list[int]] = []
    stack: list[tuple[int, float, tuple[int, ...]]] = [(0, 0.0, ())]
    steps = 0
    while stack:
        steps += 1
        if budget is not None and steps > budget:
            return "exhausted", []
        i, s, chosen = stack.pop()
        if i == len(order):
            if chosen and abs(s - total) <= tolerance:
                found.append(list(chosen))
                if len(found) > 1:
                    return "several", []
            continue
        if s + rest[i] < total - tolerance:
            continue
        stack.append((i + 1, s, chosen))
        stack.append((i + 1, s + values[order[i]], (*chosen, order[i])))
    return ("unique", sorted(found[0])) if found else ("none", [])


def reconciling_subset(values: list[float], total: float, tolerance: float, budget: int | None = 200_000) -> list[int] | None:
    """Positions of the only subset that sums to the total within a tolerance; else None."""
    status, chosen = searched_subset(values, total, tolerance, budget)
    return chosen if status == "unique" else None


def compositions(df: DataFrame, group: str, member: str, value: str, total: str, tolerance: float = 0.5, budget: int | None = 200_000) -> DataFrame:
    """Members of each group whose values alone make up its total: group, member, value, stage.

    Stage 'all' if every member together does, else 'unique' if exactly one subset does. A group that doesn't reconcile
    gives one row without member, its stage 'several', 'none' or, where the search ended before it was through,
    'exhausted'; ``budget`` None searches to the end. Totals are checked natively; only the others' lists go to Python,
    one array a group.
    """
    lists = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(member, value))).alias("_m"), F.max(total).alias("_t"))
    whole = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x[value])
    judged = lists.withColumn("_all", F.abs(whole - F.col("_t")) <= tolerance)
    done = judged.where("_all").select(group, F.explode("_m").alias("m"), F.lit("all").alias("stage"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [searched_subset(values, t, tolerance, budget) for values, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.string()), pa.array([k for _, k in found], pa.list_(pa.int32()))], [group, "stage", "_k"])

    hard = judged.where(~F.col("_all"))
    found = hard.select(group, F.col(f"_m.{value}").alias("_v"), "_t").mapInArrow(search, f"{group} {dict(df.dtypes)[group]}, stage string, _k array<int>")
    part = hard.join(found, group).select(group, F.explode_outer("_k").alias("_i"), "_m", "stage").select(group, F.when(F.col("_i").isNotNull(), F.get("_m", F.col("_i"))).alias("m"), "stage")
    return done.unionByName(part).select(group, f"m.{member}", f"m.{value}", "stage")


def merged_order(lists: list[list[str]]) -> list[str]:
    """One order of all labels that keeps the newest list's and puts each further label after the one it followed."""
    start = object()
    after: dict = {start: start}  # each label's next one, in a ring through the start
    for labels in lists:
        before = start
        for label in labels:
            if label not in after:
                after[label], after[before] = after[before], label
            before = label
    out, label = [], after[start]
    while label is not start:
        out.append(label)
        label = after[label]
    return out


def row_order(df: DataFrame, key: str, filing: str, labels: str) -> DataFrame:
    """(key, filing, labels array) to key, position, label: the merged order over each key's filings, newest first."""
    lists = df.groupBy(key).agg(F.reverse(F.sort_array(F.collect_list(F.struct(filing, labels)))).alias("_f")).select(key, F.col(f"_f.{labels}").alias("_l"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merged_order(x) for x in b.column(1).to_pylist()], pa.list_(pa.string()))], [key, "_o"])

    return lists.mapInArrow(merge, f"{key} {dict(df.dtypes)[key]}, _o array<string>").select(key, F.posexplode("_o").alias("position", "label"))

"""Breakdowns of a total by member: which tagged members are its parts.

Filings tag parents and children side by side. A breakdown is shown only if its parts are
proven: by the filed hierarchy, or by values of which exactly one choice fits. Everything
else is refused with a status. Hierarchies are closed by joins along the links; only value
searches go to Python, one short list a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.workspace import written

#: Members of a group that a value search takes, and sums that may fit the total before it is refused.
MEMBERS, FITS = 40, 4_000_000


def without_parents(members: DataFrame, links: DataFrame, group: str, member: str) -> DataFrame:
    """``members`` (group, member, ...) less those of which a descendant by ``links`` (group, parent, child) is a member too.

    The mark climbs the links a step at a time, over members and what stands between them,
    until nothing new is marked; circles of links end so, too. Repeated links count once.
    """
    up = links.where("parent is not null and child is not null and parent != child").select(group, "parent", "child").distinct()
    marked = written(members.select(group, F.col(member).alias("child")).distinct().join(up, [group, "child"]).select(group, "parent").distinct(), "parents")
    fresh = marked
    while not fresh.isEmpty():
        above = fresh.withColumnRenamed("parent", "child").join(up, [group, "child"]).select(group, "parent").distinct()
        fresh = written(above.join(marked, [group, "parent"], "left_anti"), "parents")
        marked = marked.union(fresh)
    return members.join(marked.withColumnRenamed("parent", member), [group, member], "left_anti")


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of all subsets; bit i of a place says whether value i is in."""
    out = np.zeros(1)
    for v in values:
        out = np.concatenate([out, out + v])
    return out


class _Halves:
    """All subsets of a list by their sums, as pairs of subsets of its two halves."""

    def __init__(self, values: list[float]):
        self.split = len(values) // 2
        self.left, right = _sums(np.array(values[: self.split])), _sums(np.array(values[self.split :]))
        self.order = np.argsort(right, kind="stable")
        self.right = right[self.order]

    def fits(self, total: float, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Masks and sizes of the subsets of two or more that sum to the total; None if more than ``most`` sums fit."""
        low = np.searchsorted(self.right, total - tolerance - self.left, "left")
        count = np.searchsorted(self.right, total + tolerance - self.left, "right") - low
        if (n := int(count.sum())) > most:
            return None
        a = np.repeat(np.arange(len(self.left)), count)
        b = self.order[np.arange(n) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        masks = a.astype(np.int64) | (b.astype(np.int64) << self.split)
        size = np.bitwise_count(masks.astype(np.uint64)).astype(np.int64)
        return masks[size > 1], size[size > 1]


def _bits(mask: int) -> list[int]:
    return [k for k in range(MEMBERS) if mask >> k & 1]


def searched(values: list[float], total: float, tolerance: float, floor: float = 0.0) -> tuple[str, list[int], str, list[int]]:
    """(finest status, positions, sole status, positions) of positive values against a total.

    finest: the one largest choice of values that sums to the total, if each value left out
    is itself a sum of two or more chosen ones (within a ten-thousandth or ``floor``):
    ``finest``, else ``several``, ``inconsistent`` or ``none``. sole: the only choice of any
    size: ``sole``, ``several`` or ``none``. Both ``exhausted`` beyond MEMBERS or FITS.
    """
    place = [k for k, v in enumerate(values) if v > 0]
    if len(place) < 2 or total <= 0:
        return "none", [], "none", []
    if len(place) > MEMBERS or (found := _Halves([values[k] for k in place]).fits(total, tolerance, FITS)) is None:
        return "exhausted", [], "exhausted", []
    masks, size = found
    if not len(masks):
        return "none", [], "none", []
    sole = ("sole", [place[k] for k in _bits(int(masks[0]))]) if len(masks) == 1 else ("several", [])
    best = masks[size == size.max()]
    if len(best) > 1:
        return "several", [], *sole
    chosen = [place[k] for k in _bits(int(best[0]))]
    sums = _Halves([values[k] for k in chosen])
    for k in set(place) - set(chosen):
        parts = sums.fits(values[k], max(values[k] * 1e-4, floor), FITS)
        if parts is None:
            return "exhausted", [], *sole
        if not len(parts[0]):
            return "inconsistent", [], *sole
    return "finest", chosen, *sole


def _search(df: DataFrame, group: str, values: str, total: str, floor: float) -> DataFrame:
    """(group, finest, finest_at, sole, sole_at) for one row a group with an array of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [searched(v, t, max(abs(t) * 1e-4, floor), floor) for v, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            kinds = [pa.string(), pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], [group, "finest", "finest_at", "sole", "sole_at"])

    return df.select(group, values, total).mapInArrow(run, f"`{group}` {dict(df.dtypes)[group]}, finest string, finest_at array<int>, sole string, sole_at array<int>")


def _lists(members: DataFrame, totals: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """Members of a group as one array, smallest member first; groups that no search takes have none but their count."""
    counted = members.where(F.col(value) > 0).groupBy(group).agg(F.count("*").alias("_n")).join(totals, group)
    small = members.where(F.col(value) > 0).join(counted.where(F.col("_n") <= MEMBERS).select(group), group, "left_semi")
    lists = small.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), F.col(value).cast("double").alias("v")))).alias("_m"))
    return counted.join(lists, group, "left")


def finest_partition(members: DataFrame, totals: DataFrame, group: str, member: str, value: str, floor: float = 5e5) -> DataFrame:
    """The finest split of each group's total: group, status, member, value; one row without member where it is refused.

    ``members`` (group, member, value), ``totals`` (group, total, unique). See
    :func:`searched`; the tolerance is a ten-thousandth of the total, ``floor`` at least.
    Values of 0 and below take no part. Groups without total or positive values are left out.
    """
    lists = _lists(members, totals, group, member, value)
    found = _search(lists.where("_m is not null").withColumn("_v", F.col("_m.v")), group, "_v", "total", floor)
    judged = lists.join(found, group, "left").withColumn("status", F.coalesce("finest", F.lit("exhausted")))
    each = judged.select(group, "status", "_m", F.explode_outer(F.when(F.col("status") == "finest", F.col("finest_at"))).alias("i"))
    return each.select(group, "status", F.when(F.col("i").isNotNull(), F.get("_m", F.col("i"))).alias("x")).select(group, "status", F.col("x.m").alias(member), F.col("x.v").alias(value))


def resolved(members: DataFrame, totals: DataFrame, links: DataFrame, group: str, member: str, label: str, value: str, tolerance: float = 0.01, floor: float = 5e5, like: float = 1e6) -> DataFrame:
    """The parts of each group's total by the first of these that ties it: group, stage, member, value.

    Members with one label and values within a percent (or ``like``) are one, the largest.
    Then: ``equal`` values are one member; members ``linked`` to a descendant among them
    go; the ``finest`` split by values; the ``sole`` choice that sums to the total. Each
    must have two members or more that sum to the total within ``tolerance``. Where none
    does, one row without member, its stage ``unresolved``.
    """
    alike = Window.partitionBy(group, label)
    top = F.max(value).over(alike)
    same = F.min(F.abs(F.col(value) - top) <= F.greatest(F.abs(top) * 0.01, F.lit(like))).over(alike)
    keep = F.row_number().over(alike.orderBy(F.desc(value), member))
    known = members.where(F.col(value).isNotNull()).withColumns({"_same": same, "_k": keep}).where(~F.col("_same") | (F.col("_k") == 1)).select(group, member, F.col(value).cast("double").alias(value))
    work = written(known, "members")
    equal = work.groupBy(group, value).agg(F.min(member).alias(member)).select(group, member, value)
    linked = without_parents(work, links, group, member)
    lists = _lists(work, totals, group, member, value)
    found = written(lists.join(_search(lists.where("_m is not null").withColumn("_v", F.col("_m.v")), group, "_v", "total", floor), group), "searched")
    chosen = lambda k: found.where(F.col(k) == k).select(group, F.explode(F.transform(f"{k}_at", lambda i: F.get("_m", i))).alias("x")).select(group, F.col("x.m").alias(member), F.col("x.v").alias(value))
    stages = ["equal", "linked", "finest", "sole"]
    every = None
    for k, (name, df) in enumerate(zip(stages, (equal, linked, chosen("finest"), chosen("sole")))):
        df = df.select(group, F.lit(k).alias("_k"), F.lit(name).alias("stage"), member, value)
        every = df if every is None else every.unionByName(df)
    every = written(every, "stages")
    sums = every.groupBy(group, "_k").agg(F.count("*").alias("_n"), F.sum(value).alias("_s")).join(totals, group)
    ties = sums.where((F.col("_n") >= 2) & (F.col("total") != 0) & (F.abs(F.col("_s") - F.col("total")) <= F.abs("total") * tolerance))
    first = ties.groupBy(group).agg(F.min("_k").alias("_k"))
    refused = work.select(group).distinct().join(totals, group, "left_semi").join(first, group, "left_anti")
    none = refused.select(group, F.lit("unresolved").alias("stage"), F.lit(None).cast(dict(every.dtypes)[member]).alias(member), F.lit(None).cast("double").alias(value))
    return every.join(first, [group, "_k"]).select(group, "stage", member, value).unionByName(none)


def covering(found: DataFrame, filing: str, period: str, total: Column, share: float = 0.5) -> DataFrame:
    """Of candidates of a filing and period the largest total (ties: most rows, then smallest candidate), if it is at least ``share`` of the largest of the filing: ``found`` (filing, period, candidate, rows, ...) with ``covers``."""
    w = Window.partitionBy(filing, period).orderBy(total.desc(), F.desc("rows"), "candidate")
    best = found.withColumn("_t", total).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.withColumn("covers", F.col("_t") >= F.max("_t").over(Window.partitionBy(filing)) * share).drop("_t", "_r")

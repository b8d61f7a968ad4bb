"""Ownership hierarchies: edges (parent, child, pct, active)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree(edges: DataFrame, root: DataFrame, depth: int = 4) -> DataFrame:
    """Descendants of the roots (node) over active edges, at most ``depth`` generations: root, node, parent, pct, depth, place (among its parent's children by pct).

    One join a generation; a node already on its path is not entered again.
    """
    live = edges.where("active").select(F.col("parent").alias("_p"), F.col("child").alias("_c"), F.col("pct").alias("_pct"))
    live = live.withColumn("_place", F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("_pct"), "_c")))
    level = root.select(F.col("node").alias("root"), "node", F.array("node").alias("_path"))
    found = None
    for k in range(1, depth + 1):
        j = level.join(live, level.node == live._p).where(~F.array_contains("_path", F.col("_c")))
        level = j.select("root", F.col("_c").alias("node"), F.col("_p").alias("parent"), F.col("_pct").alias("pct"), F.lit(k).alias("depth"), F.col("_place").alias("place"), F.concat("_path", F.array("_c")).alias("_path"))
        found = level if found is None else found.unionByName(level)
        level = level.select("root", "node", "_path")
    return found.drop("_path")


def climb(edges: DataFrame, nodes: DataFrame, depth: int = 4) -> DataFrame:
    """Top holder of each node, by the largest active stake at every step, at most ``depth`` up: node, top, steps."""
    best = edges.where("active").groupBy(F.col("child").alias("_c")).agg(F.max_by("parent", F.struct("pct", "parent")).alias("_up"))
    now = nodes.select("node", F.col("node").alias("top"), F.lit(0).alias("steps"))
    for _ in range(depth):
        now = now.join(best, now.top == best._c, "left").select("node", F.coalesce("_up", "top").alias("top"), (F.col("steps") + F.col("_up").isNotNull().cast("int")).alias("steps"))
    return now


def open_at(df: DataFrame, day, start: str, end: str) -> DataFrame:
    """Rows whose interval holds the day; a null end is open."""
    return df.where((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day)))

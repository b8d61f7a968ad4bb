"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, looked_up, written

#: Edges that one task finishes: 16 MB of ids.
SMALL = 1 << 20


def _finished(batches):
    """Each node of a bounded set of edges once with the smallest node it reaches, by pointer jumping."""
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if held:
        table = pa.concat_tables(held)
        ends = np.stack([table.column(k).to_numpy() for k in (0, 1)])
        names, at = np.unique(ends, return_inverse=True)
        u, v = at.reshape(2, -1)
        top = np.arange(len(names))
        while True:
            least = np.minimum(top[u], top[v])
            before = top.copy()
            np.minimum.at(top, top[u], least)
            np.minimum.at(top, top[v], least)
            top = top[top]
            if (top == before).all():
                break
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[top])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Of undirected edges (a, b), each node once with the smallest node it reaches: (node, component).

    Every step is a keyed minimum, pre-aggregated on the map side, and a join that deals
    the edges of a node with a third of all of them over many tasks. Steps are written to
    the shared folder; once no more than SMALL edges are left, one task finishes them.
    Without edges the result is empty; null ends and loops are dropped.
    """
    now = written(
        edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        if now.count() <= SMALL:
            found = written(now.coalesce(1).mapInArrow(_finished, "node long, component long"), "components")
            dropped(now)
            return found
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = looked_up(both.where("v > u"), least, "u", "v", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = looked_up(large, low, "u", "v", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u != v").distinct()
        new = written(small, "edges")
        row = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        dropped(now)
        now = new
        if (row.n, row.s) == mark:
            break
        mark = (row.n, row.s)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())

"""The trie of conversation prefixes, owned node by node by its smallest member.

A node is a sequence of first turns; its members are the conversations that start with it.
The smallest member owns the node, and with a node a conversation owns all that follow on
its path: each conversation owns the end of its path from some depth on, and each node has
one owner. So sums over a node's subtree are sums over its members: what a member's turns
weigh from that depth on, less what those of them weigh that it owns, is what its copies
would save; and the leaves below are those of its members that own theirs. Owned turns and
weights to the end are windows over each path; one group-by of prefixes does the rest.

Turns travel as digests. A prefix is named by a chain of digests, computed along sorted
paths with one digest of memory, however long the conversation. The smallest member of a
prefix is a keyed minimum (partial on the map side) that goes back to its members dealt
over many tasks, since the root has every conversation and a common first turn may have a
third; a window over a prefix would put those into one task. The digest of the members
that end at a node runs over them sorted, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import looked_up, written

NAME = "op12_prefix_trie"
#: Of the query: conversations share up to REACH - 1 turns of the first of their GROUP.
GROUP, REACH = 5, 9
ROOT = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """Each turn of ``conversations`` (conv_id, turn, role, text) as conv_id, place (from 1), digest, weight (UTF-8 bytes of the text).

    A null turn comes first; equal turns are in the order of their digests, so repeated
    rows count as turns each. Null role or text is empty. Rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    named = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("weight"))
    return named.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")).alias("place"), "digest", "weight")


def rebuilt(own: DataFrame, group: int = GROUP, reach: int = REACH) -> DataFrame:
    """``own`` turns (see :func:`turns`) where each conversation c begins with the first h turns of c - c % group, and goes on with its own after the first h.

    h: unsigned crc32 of decimal c, modulo ``reach``. Where that conversation has fewer
    turns, all; where there is none, none. A conversation may end without turns: then it
    has no row here.
    """
    counts = own.groupBy("conv_id").agg(F.max("place").alias("size"))
    plan = counts.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % reach).cast("int").alias("h")
    ).join(counts.select(F.col("conv_id").alias("base"), "size"), "base", "left")
    plan = plan.select("conv_id", "base", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("shared"))
    first = own.where(F.col("place") < reach).withColumnRenamed("conv_id", "base")
    begun = plan.join(first, "base").where("place <= shared").select("conv_id", F.col("place").alias("depth"), "digest", "weight")
    rest = own.join(plan, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), "digest", "weight")
    return begun.unionByName(rest)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id and depth, each with the digest of the path so far as ``node``."""
    conv, so_far = None, ROOT
    for b in batches:
        nodes = []
        for c, d in zip(b.column("conv_id").to_pylist(), b.column("digest").to_pylist()):
            so_far = hashlib.sha256(((so_far if c == conv else ROOT) + d).encode()).hexdigest()
            conv = c
            nodes.append(so_far)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), pa.array(nodes, pa.string()), b.column("weight")], ["conv_id", "depth", "node", "weight"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and conv_id, each node once with the digest of its conv_ids, comma-joined."""
    now, digest = None, None
    for b in batches:
        done = []
        for node, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()):
            if node == now:
                digest.update(f",{c}".encode())
            else:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(str(c).encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def trie(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, depth from 1, digest, weight).

    ``conversations`` (conv_id, unique) names all members, also those without turns, which
    end at the root. Columns: node (digest of the prefix), conv_id (smallest member),
    depth, parent_conv_id (the parent's conv_id; of the root null), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree, its top included), saved_tokens
    (over the subtree, each node's members less one, times the weight of its last turn),
    ends_sha256 (of the ids of members that end here, ascending, comma-joined; without any
    that of an empty string). Without conversations the result is empty.
    """
    along = paths.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_chained, "conv_id long, depth int, node string, weight long")
    root = conversations.select("conv_id", F.lit(0).alias("depth"), F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("weight"))
    path = Window.partitionBy("conv_id")
    steps = written(root.unionByName(along).withColumn("size", F.max("depth").over(path)), "steps")
    owners = steps.groupBy("node").agg(F.min("conv_id").alias("owner"), F.max("size").alias("deepest"))
    owned = looked_up(steps, owners, "node", "conv_id", "inner")
    own, to_end = F.col("conv_id") == F.col("owner"), path.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    leaf = own & (F.col("depth") == F.col("size")) & (F.col("deepest") == F.col("depth"))
    marked = owned.select(
        "node", "conv_id", "depth", "size",
        F.lag("owner").over(path.orderBy("depth")).alias("parent"),
        F.coalesce(F.lead(own.cast("long")).over(path.orderBy("depth")), F.lit(0)).alias("child"),
        F.sum(F.when(~own, F.col("weight")).otherwise(0)).over(to_end).alias("saved"),
        F.max(leaf.cast("long")).over(path).alias("leaf"),
    )
    marked = written(marked, "marked")
    nodes = marked.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").cast("long").alias("depth"), F.min("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    ends = marked.where("depth = size").select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends, "node string, ends_sha256 string")
    return nodes.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(ROOT)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie(rebuilt(own), own.select("conv_id").distinct()).drop("node")


ORACLE_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT conv_id, max(i) AS size FROM own GROUP BY 1),
crc AS (SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) AS crc FROM size, tab),
plan AS (SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base, c.crc % 9 AS h, least(c.crc % 9, coalesce(s.size, 0)) AS shared
  FROM crc c LEFT JOIN size s ON s.conv_id = c.conv_id - c.conv_id % 5),
path AS (
  SELECT p.conv_id, o.i AS depth, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.base AND o.i <= p.shared
  UNION ALL SELECT p.conv_id, o.i - p.h + p.shared, o.role, o.text FROM plan p JOIN own o ON o.conv_id = p.conv_id AND o.i > p.h),
step AS (
  SELECT conv_id, depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS node, strlen(text) AS weight FROM path
  UNION ALL SELECT conv_id, 0, [], 0 FROM size),
deep AS (SELECT conv_id, max(depth) AS d FROM step GROUP BY 1),
node AS (SELECT s.node, len(s.node) AS depth, min(s.conv_id) AS conv_id, count(*) AS n_convs, any_value(s.weight) AS weight,
  coalesce(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE deep.d = s.depth), '') AS ends
  FROM step s JOIN deep USING (conv_id) GROUP BY s.node),
child AS (SELECT node[:len(node) - 1] AS node, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
flat AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c ON n.node = c.node),
below AS (SELECT node[:k] AS node, sum((n_convs - 1) * weight) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM flat) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM flat f JOIN below b ON f.node = b.node LEFT JOIN node p ON f.depth > 0 AND p.node = f.node[:f.depth - 1]
"""

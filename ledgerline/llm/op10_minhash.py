"""Near-duplicate groups by b-bit MinHash.

Per document one pass computes the set of word shingles, minima, band keys of some minima
each and the low four bits of every minimum, packed (at 85 percent: 80 minima, 20 bands of
four, 40 bytes). Documents with
equal sets form a class, which its smallest doc_id stands for. Band keys that several
classes share give candidates; inside a band the packed signatures are compared by
counting equal low bits, corrected for chance collisions. Classes that may be similar
form clusters (connected components), and within each cluster full shingle sets decide.

Skew: classes absorb exact copies before anything is grouped by band or cluster. In a
band, and again in a cluster, every class first meets the hub, its smallest doc_id, where
the class is; no group is gathered for that. Those linked with the hub are linked with
each other, so only pairs with a class that isn't are left: such classes, in blocks, meet
all others of the band or cluster, in blocks, and each pair of blocks is a group of its
own. No group grows with the data, copies of one text cost one comparison each, and no
pair of different texts goes unjudged.

Bands, minima and the cut-off of the estimate follow from the similarity asked for: the
chance of losing a link that just reaches it is at most LOSS in the bands and at most LOSS
in the estimate. What is confirmed is exact.

No join is a broadcast: tables with copies compress, and one whose files are under the
broadcast threshold can be many times that as rows on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import free, looked_up, written
from .words import SPACES, U, Words, flat, mix, slices

NAME = "op10_minhash"
BITS, LOSS, MOST_MINIMA = 4, 4e-7, 512
BAND_BLOCK, CLUSTER_BLOCK = 512, 256
#: Words of a shingle and percent of the pipeline's stage.
STAGE = 5, 80


class Plan(NamedTuple):
    """Minima of a band, bands, and how many low bits of candidates may differ."""

    rows: int
    bands: int
    most: int


@cache
def plan(percent: int) -> Plan:
    """The plan that loses a link at ``percent`` with a chance of at most LOSS in the bands and in the estimate: up to four minima a band, fewer where that takes over MOST_MINIMA."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    like, word = percent / 100, 64 // BITS
    for rows in (4, 3, 2, 1):
        miss = 1 - like**rows
        bands = max(1, math.ceil(math.log(LOSS) / math.log(miss))) if miss else 1
        step = word // math.gcd(word, rows)  # minima fill whole 64-bit words
        bands = -(-bands // step) * step
        if rows * bands <= MOST_MINIMA:
            break
    minima, differs = rows * bands, (1 - like) * (1 - 2.0**-BITS)
    tail, most = 0.0, minima
    while most and differs:
        log = math.lgamma(minima + 1) - math.lgamma(most + 1) - math.lgamma(minima - most + 1) + most * math.log(differs) + (minima - most) * math.log1p(-differs)
        tail += math.exp(log)
        if tail > LOSS:
            break
        most -= 1
    return Plan(rows, bands, most if differs else 0)


@cache
def _factors(minima: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(10)
    return rng.integers(0, 1 << 32, minima, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, minima, np.uint32)


MINIMA = plan(85).rows * plan(85).bands


def _sets(words: Words, n: int) -> list[np.ndarray]:
    """The distinct shingles of each document, sorted."""
    run, of = words.shingles(n)
    cuts = np.searchsorted(of, np.arange(len(words.count) + 1))
    return [np.unique(run[a:b]) for a, b in zip(cuts, cuts[1:])]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], n: int, of_plan: Plan) -> Iterator[pa.RecordBatch]:
    rows, count, _ = of_plan
    total = rows * count
    factor, shift = _factors(total)
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(*flat(part.column("text")), SPACES)
            run, of = words.shingles(n)
            cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
            full = np.flatnonzero(cuts[:-1] < cuts[1:])
            low, at = (run >> U(32)).astype(np.uint32), cuts[:-1][full]
            minima = np.empty((len(full), total), np.uint32)
            for k in range(total if len(full) else 0):
                minima[:, k] = np.minimum.reduceat(low * factor[k] + shift[k], at)
            bits = (minima & ((1 << BITS) - 1)).astype(np.uint8)
            packed = bits[:, 0::2] | (bits[:, 1::2] << 4)
            bands = np.zeros((len(full), count), U)
            for r in range(rows):
                bands = mix(bands + minima[:, r::rows].astype(U) + U(1))
            bands = mix(bands + np.arange(count, dtype=U)).view(np.int64)
            size, digest, sig, keys = [0] * part.num_rows, *([None] * part.num_rows for _ in range(3))
            for row, d in enumerate(full):
                shingles = np.unique(run[cuts[d] : cuts[d + 1]])
                size[d], digest[d], sig[d], keys[d] = len(shingles), _digest(shingles), packed[row].tobytes(), bands[row]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "digest", "sig", "bands"],
            )


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the packed minima differ, by bit counts; rows of 64-bit words."""
    x = a ^ b
    x |= x >> U(1)
    x |= x >> U(2)
    return np.bitwise_count(x & U(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """Jaccard similarity from differing minima, corrected for low bits that agree by chance."""
    chance = 2.0**-BITS
    return (1 - differing / MINIMA - chance) / (1 - chance)


class _Links:
    """Joined sets of ids; keeps the links that join two of them."""

    def __init__(self):
        self.up, self.links = {}, []

    def top(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((a, b))

    def batch(self):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in self.links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that agree in the first columns, and where the groups begin; rows come sorted."""
    held: list[pa.Table] = []
    size = 0

    def cut(table):
        change = np.zeros(table.num_rows - 1, bool)
        for k in range(keys):
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
        if size > most:
            table = pa.concat_tables(held).combine_chunks()
            cuts = cut(table)
            if len(cuts) > 2:
                yield table.slice(0, cuts[-2]), cuts[:-1]
            held = [table.slice(cuts[-2])]
            size = 0 if len(cuts) > 2 else size
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield table, cut(table)


def _near(count: int, similar) -> Iterator[tuple[int, int]]:
    """Links that join ``count`` rows of a group as all similar pairs would; ``similar(k)``: the rows similar to row k."""
    label = np.arange(count)
    for k in range(count):
        hit = similar(k)
        for x in np.unique(label[hit]):
            if x != label[k]:
                other = int(np.flatnonzero(hit & (label == x))[0])
                label[label == x] = label[k]
                yield k, other


def _signatures(column, minima: int) -> np.ndarray:
    return np.frombuffer(flat(column.cast(pa.large_binary()))[0], U).reshape(-1, minima * BITS // 64)


def _near_hub(batches: Iterator[pa.RecordBatch], of_plan: Plan) -> Iterator[pa.RecordBatch]:
    """Whether each class of a band may be similar to the band's hub: ``rest`` if not."""
    minima = of_plan.rows * of_plan.bands
    for b in batches:
        far = unlike(_signatures(b.column("sig"), minima), _signatures(b.column("hub_sig"), minima)) > of_plan.most
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("band", "rep", "sig", "hub")), pa.array(far)], ["band", "rep", "sig", "hub", "rest"])


def _soft(batches: Iterator[pa.RecordBatch], of_plan: Plan) -> Iterator[pa.RecordBatch]:
    minima, most = of_plan.rows * of_plan.bands, of_plan.most
    for table, cuts in _groups(batches, 3, 4 << 20):
        ids, links, rest = table.column("rep").to_numpy(), _Links(), table.column("rest").to_numpy()
        sig = _signatures(table.column("sig"), minima)
        sizes = np.diff(cuts)
        for s in np.unique(sizes[sizes > 1]):
            at = cuts[:-1][sizes == s]
            if s <= 16:
                x, y = np.triu_indices(int(s), 1)
                for part in np.array_split(at, max(1, len(at) * len(x) // 200_000)):
                    a, b = (part[:, None] + x).ravel(), (part[:, None] + y).ravel()
                    near = (unlike(sig[a], sig[b]) <= most) & (rest[a] | rest[b])
                    for p, q in zip(ids[a[near]].tolist(), ids[b[near]].tolist()):
                        links.join(p, q)
            else:
                for o in at:
                    own, alone = sig[o : o + s], rest[o : o + s]
                    for p, q in _near(int(s), lambda k, own=own, alone=alone: (unlike(own, own[k]) <= most) & (alone | alone[k])):
                        links.join(int(ids[o + p]), int(ids[o + q]))
        yield links.batch()


def _to_hub(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Whether the full set of each class of a cluster is linked with that of the cluster's hub: ``rest`` if not."""
    known, hub = None, None
    for batch in batches:
        for part in slices(batch, "text"):
            rest, clusters = np.zeros(part.num_rows, bool), part.column("cluster").to_numpy()
            for k, own in enumerate(_sets(Words(*flat(part.column("text")), SPACES), n)):
                if known != clusters[k]:
                    known, hub = clusters[k], _sets(Words(*flat(part.column("hub_text").slice(k, 1)), SPACES), n)[0]
                both = len(np.intersect1d(own, hub, assume_unique=True))
                rest[k] = 100 * both < percent * (len(own) + len(hub) - both)
            yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("rep"), pa.array(rest)], ["cluster", "rep", "rest"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exact, by products of incidence matrices in column blocks."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column, out = rows[order], column[order], np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column[-1]) + 1, 4096):
        p, q = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[rows[p:q], column[p:q] - a] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _exact(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for table, cuts in _groups(batches, 3, 2 << 20):
        links, sets = _Links(), []
        for part in slices(table, "text"):
            sets += _sets(Words(*flat(part.column("text")), SPACES), n)
        ids, rest = table.column("rep").to_numpy(), table.column("rest").to_numpy()
        for a, b in zip(cuts, cuts[1:]):
            own = sets[a:b]
            if len(own) < 2:
                continue
            sizes, alone = np.array([len(x) for x in own]), rest[a:b]
            if len(own) == 2:
                both = len(np.intersect1d(*own, assume_unique=True))
                common = np.array([[sizes[0], both], [both, sizes[1]]])
            else:
                common = _common(own)
            linked = (100 * common >= percent * (sizes[:, None] + sizes - common)) & (alone[:, None] | alone)
            for p, q in _near(len(own), lambda k, m=linked: m[k]):
                links.join(int(ids[a + p]), int(ids[a + q]))
        yield links.batch()


def _rest_cells(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows (key, rep, rest, ...) of the keys with a ``rest`` row, dealt to cells (key, i, j) where each of those meets every row of its key.

    ``rest`` rows are in blocks i, all rows in blocks j, of about ``size``.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("rest").alias("_r")).where("_r > 0 and _n > 1")
    blocks = lambda n: F.ceil(F.col(n) / size).cast("int")
    met = looked_up(df, counts, key, "rep", "inner", merge=True).withColumn("_is", blocks("_r")).withColumn("_js", blocks("_n"))
    met = met.withColumn("_i", F.pmod(F.xxhash64("rep"), F.col("_is")).cast("int")).withColumn("_j", F.pmod(F.xxhash64("rep"), F.col("_js")).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    down = F.transform(F.filter(every("_is"), lambda i: ~F.col("rest") | (i != F.col("_i"))), lambda i: F.struct(i.alias("i"), F.col("_j").alias("j")))
    across = F.transform(every("_js"), lambda j: F.struct(F.col("_i").alias("i"), j.alias("j")))
    cells = met.withColumn("_c", F.explode(F.when(F.col("rest"), F.concat(across, down)).otherwise(down)))
    return cells.select(key, "_c.i", "_c.j", *[c for c in df.columns if c != key])


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Documents are linked where 100 * intersection >= percent * union of their sets of
    ``n``-word shingles (fewer words: the whole sequence as one); percent from 1 to 100. component_id is the
    smallest doc_id reachable by links, kept is doc_id = component_id. Null or wordless
    texts have empty sets, link with nothing and are kept, each as its own component.
    Rows that repeat a doc_id are judged by their own texts and count as one node. A null
    doc_id takes no part: component_id null, kept true. Further columns are ignored; an
    empty table gives an empty result.
    """
    own_plan = plan(percent)
    hashed = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    signed = written(
        hashed.mapInArrow(lambda it: _signed(it, n, own_plan), "doc_id long, text_hash long, n_shingles long, digest binary, sig binary, bands array<long>"), "signed"
    )
    classes = written(
        signed.where("digest is not null and doc_id is not null").groupBy("digest", "sig", "bands").agg(F.min("doc_id").alias("rep")), "classes"
    )
    # classes that may be similar
    banded = classes.select(F.explode("bands").alias("band"), "rep", "sig")
    shared = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1")
    shared = shared.join(classes.select(F.col("rep").alias("hub"), F.col("sig").alias("hub_sig")).hint("merge"), "hub").drop("size")
    met = looked_up(banded, shared, "band", "rep", "inner", merge=True).where("rep != hub")
    judged = written(met.mapInArrow(lambda it: _near_hub(it, own_plan), "band long, rep long, sig binary, hub long, rest boolean"), "judged")
    cells = _rest_cells(judged.drop("hub"), "band", BAND_BLOCK).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = cells.mapInArrow(lambda it: _soft(it, own_plan), "a long, b long")
    clusters = components(judged.where("not rest").select("rep", "hub").distinct().union(more).toDF("a", "b")).toDF("rep", "cluster")
    # links of full sets within clusters
    members = clusters.join(classes.select("rep", "digest").hint("merge"), "rep")
    hashes = signed.select(F.col("doc_id").alias("rep"), "digest", "text_hash")
    members = members.join(hashes.hint("merge"), ["rep", "digest"]).groupBy("rep", "cluster").agg(F.min("text_hash").alias("text_hash"))
    texts = written(members.join(hashed.withColumnRenamed("doc_id", "rep").hint("merge"), ["rep", "text_hash"]).select("rep", "cluster", "text"), "texts")
    hubs = texts.where("rep = cluster").groupBy("cluster").agg(F.first("text").alias("hub_text"))
    met = looked_up(texts.where("rep != cluster"), hubs, "cluster", "rep", "inner", merge=True)
    judged = written(met.mapInArrow(lambda it: _to_hub(it, n, percent), "cluster long, rep long, rest boolean"), "judged")
    cells = _rest_cells(judged.distinct(), "cluster", CLUSTER_BLOCK)
    wanted = texts.join(cells.select("rep").distinct().hint("merge"), "rep", "left_semi").select("rep", "text").dropDuplicates(["rep"])
    cells = cells.join(wanted.hint("merge"), "rep").select("cluster", "i", "j", "rep", "rest", "text")
    more = cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lambda it: _exact(it, n, percent), "a long, b long")
    linked = components(judged.where("not rest").select("rep", "cluster").union(more).toDF("a", "b"))
    named = classes.join(linked.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return looked_up(signed.select("doc_id", "text_hash", "n_shingles", "digest"), named, "digest", "doc_id", merge=True).select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "text_hash"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, with all its columns; groups are of texts alike by STAGE (words of a shingle, percent).

    Of rows with equal doc_id and text, one stays. Rows without doc_id, and null or
    wordless texts, stay.
    """
    h, r = free(docs.columns, "_hash", "_row")
    kept = near_duplicates(docs, *STAGE).where("kept and doc_id is not null").select("doc_id", F.col("text_hash").alias(h)).distinct()
    named = docs.withColumn(h, F.xxhash64("text")).join(kept.hint("merge"), ["doc_id", h], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.lit(0)))
    return named.withColumn(r, first).where(F.col(r) == 1).select(docs.columns).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) END AS sh
  FROM w),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM c),
common AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
link AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS node, rep AS goal FROM c UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON r.goal = x.a),
top AS (SELECT node, min(goal) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(t.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(t.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN top t ON t.node = c.rep
"""

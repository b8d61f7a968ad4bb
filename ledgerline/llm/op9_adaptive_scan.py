"""Nearest vectors by inner product: probed lists, scanned with early abandonment.

Equal vectors are one entry with its smallest ids. Lists are about LIST_SIZE entries each,
as long as their centroids take no more than CENTROID_BYTES: up to MEANS lists a k-means of
a bounded sample gives them, more are the sample's own vectors. Vectors are rotated by a
random orthogonal matrix and kept in blocks of columns.
Inside a probed list a query first takes partial distances over the leading block of all
entries; after each block a hypothesis test drops those whose scaled partial distance
says that the full one exceeds the query's bound, and only the rest read further blocks.
Those that pass all blocks are scored exactly, in double precision, on original vectors.

The bound starts from the query's k-th best among the sample's entries in the lists it
probes. Every answer comes from the scan: the nearest lists that hold k entries together
also return those that look nearest on the leading block, so no query is left with fewer
than k.
How many lists to probe is measured: for a bounded set of queries the true neighbours,
found by brute force over all entries, tell how deep their lists lie.

Lists are cut into blocks of entries and their queries into blocks of queries; each pair
of blocks is one group, so no list, however common its vectors, is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scratch import fraction, written

NAME = "op9_adaptive_scan"
ORACLE_SQL = None
NEIGHBOURS = 20
LIST_SIZE, MEANS, CENTROID_BYTES = 256, 1024, 64 << 20
SAMPLE = 8192
TRIALS, RECALL = 64, 0.97
COLUMNS = 16
LOOSE = 2.1
ENTRY_BLOCK, QUERY_BLOCK = 4096, 2048


def _vectors(column, width: int, kind=np.float32) -> np.ndarray:
    """Rows of a list or binary column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros((0, width), kind)
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _means(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds, from distinct rows of the sample; a list that runs empty keeps its centroid."""
    centre = x[np.random.default_rng(9).choice(len(x), lists, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, centre)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre.astype(np.float32)


def _parts(rows: int, lists: int):
    """Runs of rows whose distances to all lists take at most 64 MB."""
    step = max(1, (16 << 20) // lists)
    return [slice(a, a + step) for a in range(0, rows, step)]


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = 0.5 * (centre**2).sum(axis=1)
    return np.concatenate([np.argmax(x[p] @ centre.T - half, axis=1) for p in _parts(len(x), len(centre))] or [np.zeros(0, np.int64)])


def _rotation(width: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(64).normal(size=(width, width)))[0].astype(np.float32)


def scan(q: np.ndarray, x: np.ndarray, qr: np.ndarray, xr: np.ndarray, bound: np.ndarray, k: int, sure: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, the entries (rows of x) that may be among its k best, and their exact inner products.

    ``q``, ``x``: original vectors, ``qr``, ``xr``: rotated; ``bound``: inner products that k entries are known to reach;
    ``sure``: queries that get k entries (all where there are fewer) whatever the tests drop.
    """
    width, out = x.shape[1], []
    xx, qq = (x.astype(np.float64) ** 2).sum(axis=1), (q.astype(np.float64) ** 2).sum(axis=1)
    head = xr[:, :COLUMNS]
    first = (head**2).sum(axis=1)[None, :] + (qr[:, :COLUMNS] ** 2).sum(axis=1)[:, None] - 2 * (qr[:, :COLUMNS] @ head.T)
    for i in range(len(q)):
        own, tau = q[i].astype(np.float64), bound[i]
        if len(x) > 4 * k:  # entries that look nearest raise the bound
            ahead = np.argpartition(first[i], k)[: k + 1]
            tau = max(tau, np.partition(x[ahead].astype(np.float64) @ own, 1)[0 if len(ahead) <= k else 1])
        limit = np.maximum(qq[i] + xx - 2 * tau, 0)
        part, at, done = first[i].astype(np.float64), np.arange(len(x)), min(COLUMNS, width)
        while True:
            keep = part <= limit[at] * (done / width) * (1 + LOOSE / np.sqrt(done)) ** 2 + 1e-6 if done < width else part <= limit[at] * (1 + 1e-5) + 1e-5
            part, at = part[keep], at[keep]
            if done >= width or not len(at):
                break
            more = min(width, done + COLUMNS)
            part = part + ((xr[at, done:more] - qr[i, done:more]) ** 2).sum(axis=1)
            done = more
        if sure is not None and sure[i] and len(at) < k:
            at = np.union1d(at, np.argpartition(first[i], min(k, len(x)) - 1)[:k])
        score = x[at].astype(np.float64) @ own
        if len(at) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= cut], score[score >= cut]
        out.append((at, score))
    return out


def searched(embeddings: DataFrame, is_query, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """For each row of ``embeddings`` (vec_id, embedding) where ``is_query`` holds, its ``k`` nearest found: query_id, rank, vec_id, score.

    Nearest by largest inner product, ties to the smaller vec_id, every row but the
    query's own a candidate (all of them where there are fewer than k). Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do those of
    another length than the most frequent one (ties: the shorter), or without vec_id.
    Rows that repeat vec_id and vector count once. Further columns are ignored.
    """
    spark = embeddings.sparkSession
    double = embeddings.schema["embedding"].dataType.elementType == DoubleType()
    kind, element = (np.float64, "double") if double else (np.float32, "float")
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    valid = embeddings.where(fine & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast(f"array<{element}>").alias("embedding"), is_query.alias("asks"))
    top = valid.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    out = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return spark.createDataFrame([], out)
    width, keep = top.width, k + 1  # one more, as a query's own entry may be its own row only
    valid = valid.where(F.size("embedding") == width).distinct()
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ids = valid.select("embedding", "vec_id", rank.alias("r")).where(F.col("r") <= keep).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asks = valid.groupBy("embedding").agg(F.max("asks").alias("asks"))
    entries = written(ids.join(asks, "embedding").select(F.col("ids")[0].alias("uid"), "embedding", "ids", "asks"), "entries")
    count = entries.count()

    def gathered(df: DataFrame) -> np.ndarray:
        return _vectors(df.select("embedding").toArrow().column(0), width)

    lists = max(1, min(count // LIST_SIZE, CENTROID_BYTES // (4 * width)))
    most = max(SAMPLE, lists if lists > MEANS else 0)
    sample = gathered(entries.where(fraction(most / count, "sample", "uid")).limit(2 * most))
    if not len(sample):
        sample = gathered(entries.limit(most))
    lists = min(lists, len(sample))
    centre, turn = _means(sample, lists) if lists <= MEANS else sample[:lists], _rotation(width)
    near_sample = sample[:SAMPLE]
    sample_list = _nearest(near_sample, centre)
    spread = spark.sparkContext.broadcast((centre, turn, near_sample, sample_list))
    half = 0.5 * (centre**2).sum(axis=1)

    def assign(batches):
        centre, turn, *_ = spread.value
        for b in batches:
            v = _vectors(b.column("embedding"), width, kind)
            own, r = _nearest(v.astype(np.float32), centre), v.astype(np.float32) @ turn
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(own.astype(np.int32)), pa.array([y.tobytes() for y in v], pa.binary()), pa.array([y.tobytes() for y in r], pa.binary()), b.column("asks")], ["uid", "list", "vector", "rotated", "asks"])

    index = written(entries.select("uid", "embedding", "asks").mapInArrow(assign, "uid long, list int, vector binary, rotated binary, asks boolean"), "index")
    sizes = np.zeros(lists, np.int64)
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]

    # how deep the lists of true neighbours lie
    trials = index.where("asks")
    asking = max(1, trials.count())
    trials = trials.where(fraction(min(1.0, TRIALS / asking), "trial", "uid")).limit(4 * TRIALS).collect() or trials.limit(TRIALS).collect()
    probes = lists
    if trials and lists > 1:
        q = np.stack([np.frombuffer(r.vector, kind) for r in trials])

        def brute(batches):
            best = None
            for b in batches:
                score = _vectors(b.column("vector"), width, kind).astype(np.float64) @ q.T.astype(np.float64)
                own = np.repeat(b.column("list").to_numpy()[:, None], len(q), axis=1)
                if best is not None:
                    score, own = np.concatenate([best[0], score]), np.concatenate([best[1], own])
                at = np.argsort(-score, axis=0, kind="stable")[:keep]
                best = np.take_along_axis(score, at, 0), np.take_along_axis(own, at, 0)
            if best is not None:
                n = len(best[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(q)), n), pa.int32()), pa.array(best[0].ravel()), pa.array(best[1].ravel(), pa.int32())], ["q", "score", "list"])

        near = index.select("vector", "list").mapInArrow(brute, "q int, score double, list int")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= keep).select("q", "list").collect()
        depth = np.argsort(np.argsort(-(q.astype(np.float32) @ centre.T - half), axis=1, kind="stable"), axis=1)
        probes = int(np.quantile([depth[r.q, r["list"]] for r in near], recall)) + 1
    held_sizes = spark.sparkContext.broadcast(sizes)

    def chosen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists that each query probes, query by query, how many, and which of them are the nearest that hold enough entries."""
        parts = [few(v[p].astype(np.float32)) for p in _parts(len(v), lists)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else few(np.zeros((0, width), np.float32))

    def few(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centre, sizes = spread.value[0], held_sizes.value
        order = np.argsort(-(v @ centre.T - half), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        enough = np.maximum(probes, (held < 4 * keep).sum(axis=1) + 1)
        n = np.minimum(enough, lists)
        sure = held - sizes[order] < keep
        cut = lambda a: np.concatenate([a[i, : n[i]] for i in range(len(v))] or [np.zeros(0, a.dtype)])
        return cut(order), n, cut(sure)

    def counted(batches):
        total = np.zeros(lists, np.int64)
        for b in batches:
            total += np.bincount(chosen(_vectors(b.column("vector"), width, kind))[0], minlength=lists)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists), pa.int32()), pa.array(total)], ["list", "n"])

    def probe(batches):
        *_, sample, sample_list = spread.value
        for b in batches:
            v = _vectors(b.column("vector"), width, kind)
            own, n, sure = chosen(v)
            at, ends = np.repeat(np.arange(len(v)), n), np.concatenate([[0], np.cumsum(n)])
            bound = np.full(len(v), -np.inf)
            if len(sample) >= keep:
                for i in range(0, len(v), 256):
                    j = min(len(v), i + 256)
                    probed = np.zeros((j - i, lists), bool)
                    probed[at[ends[i] : ends[j]] - i, own[ends[i] : ends[j]]] = True
                    score = v[i:j].astype(np.float64) @ sample.T.astype(np.float64)
                    score[~probed[:, sample_list]] = -np.inf
                    bound[i:j] = np.partition(score, len(sample) - keep, axis=1)[:, len(sample) - keep] - 1e-6 * np.maximum(1, np.abs(v[i:j]).max(axis=1))
            row = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("uid").take(row), pa.array(own, pa.int32()), b.column("vector").take(row), pa.array(bound).take(row), pa.array(sure)], ["uid", "list", "vector", "bound", "sure"])

    asking_rows = index.where("asks").select("uid", "vector")
    asked = asking_rows.mapInArrow(probe, "uid long, list int, vector binary, bound double, sure boolean")
    queries_of = np.zeros(lists, np.int64)
    for r in asking_rows.select("vector").mapInArrow(counted, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
        queries_of[r["list"]] = r.n

    blocks = lambda n, size: np.maximum(1, -(-n // size)).tolist()
    cut = F.broadcast(spark.createDataFrame(list(zip(range(lists), blocks(sizes, ENTRY_BLOCK), blocks(queries_of, QUERY_BLOCK))), "list int, ebs int, qbs int"))
    own_block = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    other_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread_q = asked.join(cut, "list").withColumn("qb", own_block("qbs")).withColumn("eb", other_blocks("ebs")).drop("ebs", "qbs")
    spread_e = index.select("uid", "list", "vector", "rotated").join(cut, "list").withColumn("eb", own_block("ebs")).withColumn("qb", other_blocks("qbs")).drop("ebs", "qbs")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v, r = _vectors(left.column("vector"), width, kind), _vectors(right.column("vector"), width, kind), _vectors(right.column("rotated"), width)
        found = scan(q, v, q.astype(np.float32) @ spread.value[1], r, left.column("bound").to_numpy(), keep, left.column("sure").to_numpy()) if len(v) else []
        ids, uids = left.column("uid").to_numpy(), right.column("uid").to_numpy()
        return pa.table(
            {
                "quid": pa.array(np.concatenate([np.full(len(at), ids[i]) for i, (at, _) in enumerate(found)]) if found else [], pa.int64()),
                "uid": pa.array(np.concatenate([uids[at] for at, _ in found]) if found else [], pa.int64()),
                "score": pa.array(np.concatenate([s for _, s in found]) if found else [], pa.float64()),
            }
        )

    keys = ["list", "eb", "qb"]
    hits = spread_q.groupBy(*keys).cogroup(spread_e.groupBy(*keys)).applyInArrow(search, "quid long, uid long, score double")
    first = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "uid"))
    best = hits.withColumn("r", first).where(F.col("r") <= keep).drop("r")
    queries = valid.where("asks").join(entries.select("embedding", F.col("uid").alias("quid")), "embedding").select(F.col("vec_id").alias("query_id"), "quid")
    named = best.join(entries.select("uid", "ids"), "uid").join(queries, "quid").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

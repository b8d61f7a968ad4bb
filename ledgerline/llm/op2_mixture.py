"""Document rates that bring expected domain token totals to target weights.

A softmax classifier, fitted to a bounded sample of the labels table, gives every
document a posterior over domains. Rates w >= 0 then minimise the squared distance of
sum(w * tokens * posterior) from the targets by accelerated projected gradient: each
round sums the totals over all documents, and moves every rate by its posterior times one
vector, then up to 0. A rate thus follows from its posterior and the short list of
vectors, so no rates are stored or joined. The first rounds scale the gradient by the
inverse second moments of the posteriors, weighted by tokens, of the documents whose rate
can move; where the targets can be reached, few rounds do. Where they can't, plain rounds
follow, with momentum and the inverse of all moments' largest eigenvalue as step, which
always come to the least squares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import SIZE, Rows, descend, fit, sample
from .scratch import free, written
from .words import slices

NAME = "op2_mixture"
ORACLE_SQL = None
SAMPLE = 20_000
ROUNDS = 10
SCALED_PASSES, PASSES = 16, 40
TOLERANCE = 1e-4
#: Target weights by domain, in the order of the posteriors.
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}


def domain(quality: str = "quality", toxic: str = "toxic"):
    """Number of the domain of a row of labels: toxic, else clean if of quality, else poor."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 1, 0).when(F.col(quality) == 0, 1)


def _posteriors(parameters: dict, cut: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    width = parameters["w"].shape[1]
    if len(cut) < 2:
        return np.zeros((0, width))
    z = np.add.reduceat(value[:, None] * parameters["w"][index], cut[:-1]).astype(np.float64)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _step(parameters, sums, cut, index, value, label):
    p = _posteriors(parameters, cut, index, value)
    p[np.arange(len(label)), label] -= 1
    own = (p / len(label)).astype(np.float32)[np.repeat(np.arange(len(label)), np.diff(cut))] * value[:, None]
    descend(parameters, sums, "w", index, own + 1e-6 * parameters["w"][index], 0.3)


def learn(docs: DataFrame, labels: DataFrame, domains: int = len(TARGETS), most: int = SAMPLE, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The classifier's parameters from ``labels`` (doc_id, label); of repeated labels the largest counts, null ones don't."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    return fit(sample(docs, one, most), {"w": np.zeros((SIZE, domains), np.float32)}, _step, rounds)


def _momentum(k: int) -> float:
    return k / (k + 3)


def rates(posterior: np.ndarray, moves: list[tuple[np.ndarray, float]], most: float | None) -> np.ndarray:
    """Rates after all moves (vector, momentum after it), from 1, each followed by projection on [0, most]."""
    w = ahead = np.full(len(posterior), 1.0 if most is None else min(1.0, most))
    for g, momentum in moves:
        new = np.clip(ahead - posterior @ g, 0, most)
        w, ahead = new, new + momentum * (new - w)
    return w


def _judged(docs: DataFrame, parameters: dict) -> DataFrame:
    spread = docs.sparkSession.sparkContext.broadcast(parameters)

    def judge(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                f = Rows(part)
                p = _posteriors(spread.value, f.cut, f.index, f.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(f.tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    named = [c for c in ("text", "n_chars") if c in docs.columns]
    return docs.select("doc_id", *named).mapInArrow(judge, "doc_id long, n_tokens long, posterior array<double>")


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _totals(judged: DataFrame, moves: list[tuple[np.ndarray, float]], most: float | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected domain totals at the present rates, and the second moments by tokens of all posteriors and of those whose rate can move."""

    def part(batches):
        out = np.zeros(width + 2 * width * width)
        for b in batches:
            n, p = b.column("n_tokens").to_numpy(), _matrix(b.column("posterior"), width)
            w = rates(p, moves, most)
            free = (w > 0) & (w < (np.inf if most is None else most))
            out += np.concatenate([(n * w) @ p, ((p * n[:, None]).T @ p).ravel(), ((p * (n * free)[:, None]).T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["k", "x"])

    found = np.zeros(width + 2 * width * width)
    for r in judged.select("n_tokens", "posterior").mapInArrow(part, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        found[r.k] = r.x
    every, moving = found[width:].reshape(2, width, width)
    return found[:width], every, moving


def solve(judged: DataFrame, targets: np.ndarray, most: float | None = None, passes: int = PASSES) -> list[tuple[np.ndarray, float]]:
    """The moves of projected gradient; the targets are shares of all tokens.

    Ends when the totals are within TOLERANCE, or their distance from the targets (the root of the squares that are made
    least, which still falls where one domain's share can't) shrank by no more than that in eight plain passes.
    Scaled passes end after SCALED_PASSES, or four without gain; those after the nearest totals don't count.
    """
    moves: list[tuple[np.ndarray, float]] = []
    nearest, kept = np.inf, 0
    for scaled, count, patience in ((True, SCALED_PASSES, 4), (False, passes, 8)):
        before = best = None
        for k in range(count):
            totals, every, moving = _totals(judged, moves, most, len(targets))
            if not (tokens := every.sum()):
                return moves
            totals = totals / tokens
            miss, distance = np.abs(totals - targets).max(), np.linalg.norm(totals - targets)
            if scaled and miss < nearest:
                nearest, kept = miss, len(moves)
            if miss < TOLERANCE:
                return moves
            if best is not None and k % patience == 0 and distance > best - TOLERANCE:
                break
            best = distance if best is None or k % patience == 0 else best
            ahead = totals if before is None or scaled else totals + _momentum(k - 1) * (totals - before)
            before, top = totals, np.linalg.eigvalsh(every / tokens)[-1]
            if scaled:
                g = np.linalg.solve(moving / tokens + 1e-9 * top * np.eye(len(targets)), ahead - targets)
            else:
                g = (ahead - targets) / top
            moves.append((g, 0.0 if scaled else _momentum(k)))
        if scaled:
            del moves[kept:]
    return moves


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, n_chars if present): doc_id, n_tokens, p_<domain> for each domain, rate.

    ``labels`` has (doc_id, label: number of a domain). The expected number of copies is
    ``rate``; over all rows, sum(rate * n_tokens * p) comes to the target share of all
    tokens, or as near as rates from 0 (to ``most``) allow. Texts that are null or
    without words have no tokens and a rate from their posterior. Repeated rows count
    each; an empty table gives an empty result. Further columns are ignored.
    """
    judged = written(_judged(docs, learn(docs, labels, len(targets))), "posteriors")
    moves = solve(judged, np.array(list(targets.values())), most)
    width = len(targets)

    def rated(batches):
        for b in batches:
            p = _matrix(b.column("posterior"), width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), *(pa.array(p[:, k]) for k in range(width)), pa.array(rates(p, moves, most))], ["doc_id", "n_tokens", *(f"p_{x}" for x in targets), "rate"])

    return judged.mapInArrow(rated, "doc_id long, n_tokens long, " + "".join(f"p_{x} double, " for x in targets) + "rate double")


def sampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs``, each kept with a chance of its rate, which is 1 at the most; all columns. The draw is a hash of doc_id and text."""
    parameters = learn(docs, labels, len(targets))
    judged = written(_judged(docs, parameters), "posteriors")
    moves = solve(judged, np.array(list(targets.values())), 1.0)
    spread, names, (draw,) = docs.sparkSession.sparkContext.broadcast(parameters), docs.columns, free(docs.columns, "_draw")
    drawn = docs.withColumn(draw, F.pmod(F.xxhash64("doc_id", "text", F.lit("mixture")), F.lit(1 << 30)) / float(1 << 30))

    def judge(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                f = Rows(part)
                w = rates(_posteriors(spread.value, f.cut, f.index, f.value), moves, 1.0)
                yield part.filter(pa.array(part.column(draw).to_numpy() < w)).select(names)

    return drawn.mapInArrow(judge, docs.schema)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", domain().alias("label"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of over-represented domains are thinned out; rates stop at 1, so none that dedup removed comes back."""
    return sampled(docs, _labels(spark, sf_dir))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"), _labels(spark, sf_dir))

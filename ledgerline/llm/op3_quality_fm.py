"""Quality scores by a factorisation machine.

Hashed words, structure statistics and metadata interact in pairs through low-rank
factors; a score takes time linear in the features, as the sum over pairs is half the
difference of the squared sum and the sum of squares, factor by factor. The machine is
fitted in rounds to a bounded sample of labelled rows (``SAMPLE``), by shards whose
parameters are averaged; scoring is one pass without shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import SIZE, Rows, descend, fit, sample
from .words import slices

NAME = "op3_quality_fm"
ORACLE_SQL = None
FACTORS = 8
SAMPLE = 20_000
ROUNDS = 12


def margins(parameters: dict, cut: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: linear part plus pairs, by the sum-of-squares identity; and the sum of factors."""
    x = value[:, None] * parameters["v"][index]
    total = np.add.reduceat(x, cut[:-1]) if len(cut) > 1 else x[:0]
    squares = np.add.reduceat(x * x, cut[:-1]) if len(cut) > 1 else x[:0]
    linear = np.add.reduceat(value * parameters["w"][index], cut[:-1]) if len(cut) > 1 else value[:0]
    return linear + 0.5 * (total**2 - squares).sum(axis=1), total


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _step(parameters, sums, cut, index, value, label):
    z, total = margins(parameters, cut, index, value)
    wrong = ((_chance(z) - label) / len(label)).astype(np.float32)
    row = np.repeat(np.arange(len(label)), np.diff(cut))
    own = wrong[row] * value
    pairs = own[:, None] * (total[row] - value[:, None] * parameters["v"][index])
    descend(parameters, sums, "w", index, own + 1e-6 * parameters["w"][index], 0.3)
    descend(parameters, sums, "v", index, pairs + 1e-6 * parameters["v"][index], 0.05)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The machine's parameters from ``labels`` (doc_id, label 0/1); repeated labels count by majority (ties: 1), null ones don't."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    start = {"w": np.zeros(SIZE, np.float32), "v": np.random.default_rng(3).normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)}
    return fit(sample(docs, one, most), start, _step, rounds)


def scores(docs: DataFrame, parameters: dict[str, np.ndarray]) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, n_chars if present): doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts are scored by their statistics alone, repeated rows each;
    without labels every score is near 0.5. Further columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(parameters)

    def judge(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                f = Rows(part)
                score = _chance(margins(spread.value, f.cut, f.index, f.value)[0])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    named = [c for c in ("text", "n_chars") if c in docs.columns]
    return docs.select("doc_id", *named).mapInArrow(judge, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    parameters = learn(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return scores(docs, parameters).select("doc_id", held_out.alias("held_out"), "score", "predicted")

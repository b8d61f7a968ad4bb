"""Language proportions of documents by expectation-maximisation over n-gram likelihoods.

Learning counts hashed letter trigrams by language, in each task and then by key; the
model is one likelihood per language and bucket (65,536 buckets, so its size is bounded
by the number of languages). Each document is then a mixture of languages: EM estimates
the proportions that make its trigrams likeliest, first over all languages, then over
growing sets of the most present ones, while the log-likelihood gains more than a penalty
per language and log of the number of trigrams. No stage but the counts' sum shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import U, mix, slices

NAME = "op1_language_mixture"
ORACLE_SQL = None
BUCKET_BITS = 16
SMOOTHING = 0.5
PENALTY = 3.0
#: Least share of a language that may join the set, and EM's rounds over all languages and over a set; 0 and many are exact.
LEAST, ROUNDS = 0.02, (10, 8)
NONE = "und"

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter (general category L)."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every trigram of lower-cased letters and word gaps, and whether each document has a letter."""
    low = [f" {x.lower()} " if x else " " for x in texts]
    point = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(x) for x in low])
    letter = _letters()[point]
    some = np.bincount(doc[letter], minlength=len(low)) > 0
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1] | (doc[1:] != doc[:-1])  # the first of several gaps
    point, doc = np.where(letter, point, 32)[kept].astype(U), doc[kept]
    if len(point) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), some
    run = mix((point[:-2] << U(42)) | (point[1:-1] << U(21)) | point[2:])
    whole = doc[:-2] == doc[2:]
    return (run[whole] >> U(64 - BUCKET_BITS)).astype(np.uint32), doc[2:][whole], some


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def rows():
        at = {k: np.flatnonzero(v) for k, v in sums.items()}
        names = [k for k, v in at.items() for _ in range(len(v))]
        buckets = np.concatenate(list(at.values())) if at else np.zeros(0, np.int64)
        counts = np.concatenate([sums[k][v] for k, v in at.items()]) if at else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(buckets, pa.int32()), pa.array(counts, pa.int64())], ["lang", "bucket", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            bucket, doc, _ = _trigrams(part.column("text").to_pylist())
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = np.bincount(bucket[(langs == lang)[doc]], minlength=1 << BUCKET_BITS)
                sums[lang] = sums[lang] + own if lang in sums else own
            if len(sums) > 64:
                yield rows()
                sums.clear()
    yield rows()


class Model:
    """Likelihoods by bucket (rows) and language (columns)."""

    def __init__(self, counts: pd.DataFrame):
        self.names = sorted(counts["lang"].unique())
        table = np.zeros((1 << BUCKET_BITS, len(self.names)))
        table[counts["bucket"], counts["lang"].map({x: k for k, x in enumerate(self.names)}).astype(int)] = counts["n"]
        self.p = (table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * len(table))


def _fit(p: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions after EM, and the log-likelihood before its last round."""
    total, like = n.sum(), -math.inf
    for _ in range(rounds):
        each = p @ share
        now = float(n @ np.log(each))
        share = share * ((n / each) @ p) / total
        if now - like < 1e-3 * math.log(total + 1):
            break
        like = now
    return share, now


def mixture(p: np.ndarray, n: np.ndarray, penalty: float = PENALTY, least: float = LEAST, rounds: tuple[int, int] = ROUNDS) -> tuple[dict[int, float], float]:
    """Proportions by language of one document, and their log-likelihood; ``p``: likelihoods of its distinct trigrams, ``n``: their counts."""
    single = n @ np.log(p)
    rank = np.argsort(-single, kind="stable")
    like, found = float(single[rank[0]]), {int(rank[0]): 1.0}
    if p.shape[1] == 1:
        return found, like
    best, start = like, np.exp(np.maximum((single - like) / n.sum(), -6))
    share, _ = _fit(p, n, start / start.sum(), rounds[0])
    order = np.argsort(-share, kind="stable")
    cost = penalty * math.log(n.sum() + 1)
    for k in range(2, int((share >= least).sum()) + 1):
        own = order[:k]
        part, now = _fit(p[:, own], n, share[own] / share[own].sum(), rounds[1])
        if now - cost * (k - 1) <= best:
            break
        like, best, found = now, now - cost * (k - 1), dict(zip(own.tolist(), part.tolist()))
    return found, like


def _predict(column: pa.Array, model: Model, penalty: float) -> list[tuple[dict[str, float], float]]:
    """Of each text the proportions by language, most first, and by how much a trigram is likelier than one drawn from all buckets alike (log)."""
    bucket, doc, some = _trigrams(column.to_pylist())
    key, n = np.unique((doc.astype(np.uint32) << np.uint32(BUCKET_BITS)) | bucket, return_counts=True)
    cuts = np.searchsorted(key >> np.uint32(BUCKET_BITS), np.arange(len(column) + 1))
    n, out = n.astype(np.float64), []
    for k in range(len(column)):
        a, b = cuts[k], cuts[k + 1]
        if not some[k] or a == b or not model.names:
            out.append(({}, 0.0))
            continue
        found, like = mixture(model.p[key[a:b] & ((1 << BUCKET_BITS) - 1)], n[a:b], penalty)
        gain = like / n[a:b].sum() + BUCKET_BITS * math.log(2)
        out.append(({model.names[i]: x for i, x in sorted(found.items(), key=lambda x: (-x[1], x[0]))}, gain))
    return out


def learn(docs: DataFrame, training) -> Model:
    """The model from text and non-null lang of the rows where the column ``training`` holds."""
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(counts.toPandas())


def languages(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, shares.

    ``shares`` has the proportion of each language of the chosen set, lang_pred is the one
    with most (ties: the first name), score its proportion. Texts that are null or have no
    letter get 'und', 0 and no shares, as all do without any learnt language. Repeated
    rows are judged each; further columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [x for x, _ in _predict(part.column("text"), spread.value, penalty)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([next(iter(x), NONE) for x in found], pa.string()),
                        pa.array([min(1.0, next(iter(x.values()), 0.0)) for x in found], pa.float64()),
                        pa.array([list(x.items()) for x in found], pa.map_(pa.string(), pa.float64())),
                    ],
                    ["doc_id", "lang_pred", "score", "shares"],
                )

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, shares map<string,double>")


def accepted(docs: DataFrame, model: Model, wanted: list[str] | None = None, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs`` with a learnt (and wanted) language, with all their columns.

    Texts that are null or have no letter go, and so do those whose trigrams are no
    likelier under their own mixture than if drawn from all buckets alike: no learnt
    language accounts for them. Repeated rows are judged each.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [next(iter(x), NONE) if gain > 0 else NONE for x, gain in _predict(part.column("text"), spread.value, penalty)]
                yield part.filter(pa.array([x != NONE and (wanted is None or x in wanted) for x in found], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognised language go, null and letterless texts among them; repeated rows are judged each."""
    return accepted(docs, learn(docs, ~_held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = languages(docs, learn(docs, ~_held_out() & F.col("doc_id").isNotNull()))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "shares")

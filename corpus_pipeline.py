"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import op1_language_mixture, op2_mixture, op7_pack, op8_decontaminate, op10_minhash
from ledgerline.llm.scratch import written

STAGES = [
    ("language ID", op1_language_mixture.stage),
    ("MinHash near-dedup", op10_minhash.stage),
    ("benchmark decontamination", op8_decontaminate.stage),
    ("mixing sources to target weights", op2_mixture.stage),
    ("token-ID / binary output", op7_pack.stage),
]

#: The stages learn models and pack token ids, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs

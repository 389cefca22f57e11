"""A training-corpus pipeline: stages over the documents table, each written
and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matrica.llm._shared import discard, materialize, scratch, table
from matrica.llm.queries import stage_byte_bpe, stage_decontamination, stage_near_dedup, stage_quality_classifier, stage_quality_rules

STAGES = [
    ("quality classifier", stage_quality_classifier),
    ("quality rules", stage_quality_rules),
    ("MinHash near-dedup", stage_near_dedup),
    ("benchmark decontamination", stage_decontamination),
    ("byte-level BPE", stage_byte_bpe),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs

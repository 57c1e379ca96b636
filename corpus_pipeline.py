"""Document pipeline: quality rules, near-duplicates, benchmark decontamination, secret redaction, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; ``run`` writes each
result as Parquet in the shared folder and reads it as the next stage's documents. All stages but the last
return the columns of documents.

Defined results: a null text counts as empty, fails the quality rules and goes; null ids pass through, and each
such row is judged on its own; of rows that are equal in id and text one stays; texts of any length are taken
whole; an empty table gives an empty result; other columns, also such that differ from doc_id and text in case
only, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm import bpe, decontaminate, quality, secrets, simhash
from vouchline.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.apply(docs, quality.CURRENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked fingerprints the row with the least id stays."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows the text."""
    found = secrets.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes."""
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_level_bpe", byte_level_bpe),
]

#: XXH64 fingerprints and merges by rank have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

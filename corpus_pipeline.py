"""A corpus pipeline: classify, deduplicate, decontaminate, remove secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, jaccard, packing, quality, secrets
from millrace.llm.base import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: neither of low quality nor toxic. Null and empty texts go; rows that repeat go or stay together, ids play no part."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram Jaccard links join, a row with the smallest id; rows without an id or without words all stay."""
    return jaccard.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: each row by its own text; null and empty texts stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows and null texts too, with each secret replaced by a mark; n_chars follows a changed text."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences, and the ids themselves; a null or empty text is the end id alone. Workers hold little, as they have run the other stages before."""
    return packing.pack_documents(docs, with_ids=True, cache_units=60_000, batch_bytes=2 << 20)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: The classifier, the randomness tests and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]

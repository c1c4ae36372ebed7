"""From raw documents to token ids: quality, exact and near duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import bpe_encode
from millrace.llm.decontaminate import decontaminate
from millrace.llm.exact_dedup import keep_first_copies
from millrace.llm.quality import keep_good
from millrace.llm.queries import table, vocabulary_path
from millrace.llm.shared import Workspace
from millrace.llm.simhash import keep_similar_representatives


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return keep_first_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles alike by 0.8 or more) the document with the smallest doc_id."""
    return keep_similar_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their count and digests, and the digest of the decoded text."""
    return bpe_encode(docs.select("doc_id", "text"), vocabulary_path()).drop("text")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The first, third and last stage (a trained model, XXH64, BPE) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all stages applied to the table ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: from raw documents to packed training sequences in five stages.

Each stage is a function of (spark, docs, sf_dir) and calls one operator of ``ldaplens.llm``. All but
the last return the columns of ``documents`` they were given, so stages can be run, written and read
again one by one; ``run`` does that in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ldaplens.llm.common import written
from ldaplens.llm.exact_dedup import drop_indexes, keep_one
from ldaplens.llm.jaccard_join import keep_one_of_similar
from ldaplens.llm.packing import pack_documents
from ldaplens.llm.quality import keep_good
from ldaplens.llm.secret_scans import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays. The index is written to shared files, which the
    next stage deletes."""
    return keep_one(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8, the smallest id stays."""
    drop_indexes()  # the stage before is written
    return keep_one_of_similar(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Shingle links and byte-pair tokens are not to be had in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldaplens.llm.byte_bpe import round_trip
from ldaplens.llm.centroids import cluster_vectors
from ldaplens.llm.common import tables
from ldaplens.llm.exact_dedup import exact_dedup
from ldaplens.llm.fill_in_middle import fill_in_middle
from ldaplens.llm.html_text import extract_text
from ldaplens.llm.jaccard_join import similar_components
from ldaplens.llm.lm_scoring import score_texts
from ldaplens.llm.oracles import ORACLE
from ldaplens.llm.packing import pack_documents
from ldaplens.llm.quality import quality_rules
from ldaplens.llm.secret_scans import digest, join_back, read_ledger, record
from ldaplens.llm.suffix_dedup import remove_repeats
from ldaplens.llm.token_counts import token_counts
from ldaplens.llm.warc import read_archives, write_archives
from ldaplens.session import scratch_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(tables(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table comes in two batches, even ids and the others; the second is scanned for what the ledger lacks."""
    docs = tables(spark, sf_dir, "documents")
    place = scratch_path(spark, "secret-ledger")
    even = F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(1)) == 0
    for batch in (docs.where(even), docs.where(~even)):
        record(batch, place)
    return digest(join_back(docs, read_ledger(spark, place)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(tables(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(tables(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(tables(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(tables(spark, sf_dir, "pages"))
    return read_archives(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(tables(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(tables(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(tables(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(tables(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(tables(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(tables(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secret_scans, op3_quality_rules, op4_html_text, op5_byte_bpe, op6_exact_dedup, op7_warc, op8_suffix_dedup, op9_jaccard_join, op10_packing, op11_lm_scoring, op12_fill_in_middle, op13_centroids)}

__all__ = ["ORACLE", "QUERIES"]

"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .jaccard import jaccard_components
from .lexical import ranked_search
from .license_scan import known_licenses, license_scan
from .lm import lm_scores
from .mixing import mix_sources
from .near_vectors import near_vectors
from .packing import pack_documents
from .quality import quality_rules
from .records import read_records, write_records
from .repair import damaged, repair_conversations
from .sql import SQL
from .suffix import suffix_dedup
from .tokens import tokenizer_path
from .topk import top_k
from .warc import read_archive, write_archive


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), where)
    return read_archive(spark, where).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to"
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_records(table(spark, sf_dir, "documents"), shared_dir(spark, "records"), tokenizer_path()))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


_ALL = (
    op1_license_scan, op2_topk_search, op3_curve_packing, op4_quality_rules, op5_warc_archive,
    op6_jaccard_join, op7_token_records, op8_source_mixing, op9_lm_scores, op10_suffix_dedup,
    op11_near_vectors, op12_ranked_search, op13_repair_conversations,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {k: v for k, v in SQL.items() if k in QUERIES}

"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers as tokens
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import bpe_codec, line_dedup, orc_ids, packing, quality, secret_scan, simhash, substring_dedup, token_counts, vptree
from rookery.llm.common import scratch_dir, table

RANKS, TOKENIZER = tokens.path("byte_bpe_50k.tiktoken"), tokens.path("byte_bpe_50k.json")
#: More prunes more of a vantage-point tree; 1 is exact.
RELAX = 1.5


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), RANKS, tokens.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, count_col="n_lines_removed")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), k=10, relax=RELAX)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.bpe_digests(table(spark, sf_dir, "documents"), RANKS, tokens.PATTERN)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), TOKENIZER, tokens.PATTERN, capacity=1024, end_id=2)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    schema = orc_ids.write_token_ids(table(spark, sf_dir, "documents"), path, TOKENIZER, tokens.PATTERN, end_id=2)
    return orc_ids.token_id_digests(orc_ids.read_token_ids(spark, path, schema))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_quality_rules, op4_vantage_point_search, op5_bpe_codec, op6_best_fit_packing, op7_simhash, op8_orc_token_ids, op9_secret_scan, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {}

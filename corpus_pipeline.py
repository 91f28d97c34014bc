"""From raw documents to packed sequences: five operators, one after another, each on what its predecessor kept.

What is joined with the documents grows with them and is never broadcast. No stage reads columns but doc_id, text and n_chars, so others
may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers as tokens
from pyspark.sql import DataFrame, SparkSession

from rookery.llm import line_dedup, packing, quality, secret_scan, simhash
from rookery.llm.common import col, cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; rows that share an id are kept if one of them is.

    A null id is an id like any other here. Null, empty and wordless texts fail and go; long texts are judged whole; repeated rows alike.
    """
    kept = quality.judge(docs).where("kept").selectExpr("doc_id as __kept").distinct().hint("merge")
    return docs.join(kept, col(docs, "doc_id").eqNullSafe(kept["__kept"]), "left_semi")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of chunks that stand elsewhere first; n_chars follows the text.

    Rows with a null id or text stay as they are, and empty texts; a text that loses all lines is empty. Repeated rows count as one document.
    """
    from pyspark.sql import functions as F

    shorter = line_dedup.line_dedup(docs)
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else shorter


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 or more, on sets of five-word shingles, connect: the least by id and hash of its text.

    Null, empty and wordless texts are one group; a null id is the least; of repeated rows one stays. Long texts are compared whole.
    """
    return simhash.keep_one(docs, cut(simhash.similar_documents(docs), "near"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text.

    Rows with a null id are masked like any; null and empty texts stay as they are; repeated rows are all masked.
    """
    from pyspark.sql import functions as F

    clean = secret_scan.redact(docs, secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens.

    A null or empty text is its end id alone; repeated rows and rows with a null id are packed like any; only long texts are cut.
    """
    return packing.best_fit_packing(docs, tokens.path("byte_bpe_50k.json"), tokens.PATTERN, capacity=1024, end_id=2)


STAGES = [("quality rules", quality_rules), ("line dedup", repeated_lines), ("near duplicates", near_duplicates), ("secret scan", secrets), ("packing", packed)]
#: Model fitting, hashing of words and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

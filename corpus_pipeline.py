"""Corpus pipeline: language ID, near-dedup, PII redaction, mixing to target weights, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import fresh_path
from millrace.llm.language import keep_identified
from millrace.llm.mixing import mix
from millrace.llm.near_dup import keep_one
from millrace.llm.packing import pack
from millrace.llm.pii import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose language is a close call, go.

    Null doc_ids, repeated rows and further columns stay as they are; an empty table gives no rows, and so does one without a labelled row to learn from.
    """
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of the smallest doc_id.

    Rows equal in doc_id and text count once; a doc_id with different texts loses none; rows of null doc_id are compared like any other and lose to
    those with one; further columns stay as they are; an empty table gives no rows.
    """
    return keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars is that of the new text.

    Null and empty texts, null doc_ids, repeated rows and further columns stay as they are; an empty table gives no rows.
    """
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions, in mixed order: documents of heavy sources repeat, some of light ones go, and the one at a source's cut is cut.

    Null sources are a source; documents of no words go; an empty table gives no rows.
    """
    return mix(docs).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    Null text is an empty document; null doc_ids and repeated rows are documents of their own, a null source is a source; further columns are ignored; an
    empty table gives no rows.
    """
    return pack(docs)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("PII", redact_pii), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Compression, signatures and boosted trees are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over the documents table, as a list of stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardedup, pii, quality
from tidemark.llm.common import shared_path
from tidemark.llm.queries import tokenizer_spec


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null, empty and very short texts are among them. Rows that repeat share a verdict."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; of ties and repeated rows, one. A row without an id stays."""
    return neardedup.deduplicated(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind; n_chars follows. No row goes; null texts stay null."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents are left out or repeated. Null is a source of its own; rows with equal ids share their fate."""
    return mixing.repeated(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) of every document: its token ids, and the text that they give back. Null texts have no ids and give back the empty text."""
    return bpe.encode_decode(docs, tokenizer_spec()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: The stages run trained models and a tokenizer, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    Every stage takes any table with the columns of documents: extra columns, whatever their names, go with their rows until the last stage. Null texts count as
    empty; ids may be null or repeat; rows that repeat are rows of their own until near_dedup keeps one; an empty table stays empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = shared_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs

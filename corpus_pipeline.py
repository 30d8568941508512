"""Corpus pipeline: each stage's output is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideloom.llm.common import discard, stored, table, vocabulary
from tideloom.llm.fertility import filter_fertility
from tideloom.llm.neardup import near_duplicates
from tideloom.llm.packing import pack_sequences
from tideloom.llm.quality import filter_quality
from tideloom.llm.repeats import cut_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on labelled documents, rejects. See score_quality for nulls, repeats and empty tables."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the fertility bands reject, null and empty texts among them."""
    return filter_fertility(docs, vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate class: all its rows; rows without doc_id stay."""
    others = near_duplicates(docs).filter("class_id < doc_id").select("doc_id")
    return docs.join(others.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-word windows that start in a document with a smaller doc_id out of the texts; null texts stay null."""
    return cut_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 ids; null texts count as empty."""
    return pack_sequences(docs, vocabulary("word_bpe_49k.json"), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL cannot express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir))
        if i:  # the stage before is written, and nothing reads its input any more
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

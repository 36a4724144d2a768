"""Stages that turn raw documents into training data; each works on all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, language_id, line_dedup, near_copies, sentencepiece_bpe
from skein.llm.common import keep, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text, declared language and source together speak for a language; the others go."""
    return language_id.keep_identified(docs).select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay in another place; n_chars is that of the new text."""
    found = line_dedup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id; Jaccard similarity 0.8 over five words a shingle.

    Candidates are those that op8's operator links (SimHash, two bits) and, as 0.8 is 4 to 14 bits, those of MinHash.
    Documents that line dedup left without words are one group, of which one stays.  Rows that repeat that doc_id are
    near copies too, so one of them stays; rows without doc_id stay where their group has no other.
    """
    return near_copies.keep_one(docs, words=5)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item; the others go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    return sentencepiece_bpe.encode_documents(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmarks),
    ("sentencepiece", encoded),
]

#: Trained models, MinHash and alignment can't be written in SQL; tests/llm hold a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs, name)
    return docs

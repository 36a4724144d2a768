"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language_id, license_scan, line_dedup, media_tiff, sentencepiece_bpe, simhash, token_output, toxicity
from .common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (doc_id) and all pages (page_id)."""
    docs = language_id.document_records(read_table(spark, sf_dir, "documents"))
    records = docs.unionByName(language_id.page_records(read_table(spark, sf_dir, "pages")))
    return language_id.identify(records, language_id.fit_text(records))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit_on(docs))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "dropped", "first_doc_ids", "text")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sentencepiece_bpe.encode_documents(docs, tokenizer("piece_bpe_32k.model"), ids=False)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokenize_to_orc(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_words", "n_passages", "best", "starts", "ends")


def op10_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiff.texts_as_tiff(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_decontaminate": op5_decontaminate,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_output": op7_token_output,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_media_tiff": op10_media_tiff,
}

#: None of these can be written in SQL; tests/llm holds brute-force versions.
ORACLE_SQL: dict[str, str] = {}

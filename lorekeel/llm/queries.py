"""The queries opN_<name> of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, html_extract, mixing, near_dedup, pii, quality_rules, secrets, token_counts, token_store
from .common import table

#: Name of the word-level tokenizer; its place is looked up, never copied.
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def _pii_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.BASE_KINDS), F.sha2(_pii_text("base"), 256).alias("base_sha256"), _pii_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_private"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, secrets.KINDS), F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans")
    )


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))
    return token_store.read_store(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", F.round("score", 6).alias("score"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digests(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


NORMAL_SQL = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH n AS (SELECT doc_id, sha256({NORMAL_SQL}) AS text_sha256 FROM documents)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_pii": op2_pii,
    "op3_html_extract": op3_html_extract,
    "op4_secrets": op4_secrets,
    "op5_token_store": op5_token_store,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_bpe_codec": op10_bpe_codec,
}
SQL = {"op8_exact_dedup": OP8_SQL}

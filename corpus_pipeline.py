"""A training corpus from raw documents: rules, duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is
written as Parquet and read again as the next one's documents. All but the last
return the columns of the documents they got.

Nulls, empty texts and repeated rows: a null or empty text has no words, so the rules
drop it; null doc_ids, sources and languages are values like others; repeated rows are
one text, of which one row stays; of ties the smallest doc_id stays. Empty tables give
an empty result of the same columns. The mixture's part files are in training order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeel.llm import bpe_codec, exact_dedup, mixing, near_dedup, quality_rules
from lorekeel.llm.common import delete, shared_dir, table
from lorekeel.llm.queries import WORD_TOKENIZER, tokenizer_path
from lorekeel.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mixture takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, encoded and decoded again."""
    ship(spark)
    return bpe_codec.codec_digests(docs, tokenizer_path(WORD_TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixture),
    ("bpe codec", tokens),
]

#: The trained ratios, the sketches and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate results lie in the shared folder until the next one is written."""
    ship(spark)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            if number:
                delete(spark, f"{folder}/{number - 1}")
    return docs

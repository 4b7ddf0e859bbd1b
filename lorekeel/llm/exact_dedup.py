"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition makes one run: its distinct digests, sorted, each with its
smallest identifier and its number of rows. Runs then meet in rounds. A round
exchanges the runs whose numbers agree above the lowest ``fan_bits`` bits (so it
is that many binomial rounds in one multiway merge), merges them in digest order
and keeps the smallest identifier, after checking that the second fingerprint of
the merged entries agrees. A run is made on the sending side of the first round,
where its partition lies whole, so it needs no exchange of its own. Entries are spread over tasks by (digest, run), so no
task holds a whole run, and a digest that a third of all rows share arrives as at
most one entry for each run and task, never as its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, keep_rows, whole_text

#: 2 ** FAN_BITS runs meet in one round.
FAN_BITS = 4


def normalised(column: str = "text"):
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(whole_text(column), SPACE, " ")


def merged_runs(entries: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """(digest, best, n) of ``entries`` (digest, proof, id, ord, run): the tree-merge.

    ``best`` is the smallest (id, ord), nulls last, and ``n`` the number of rows.
    A digest whose entries have different second fingerprints stops the job.
    """
    first = entries.select(
        "digest",
        "run",
        F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("ord")).alias("best"),
        F.lit(1).cast("long").alias("n"),
        F.col("proof").alias("low"),
        F.col("proof").alias("high"),
    )

    def merge(runs: DataFrame) -> DataFrame:
        together = runs.groupBy("digest", "run").agg(
            F.min("best").alias("best"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        proof = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
            F.raise_error(F.lit("two texts share a digest but not their second fingerprint")).cast("long")
        )
        return together.select("digest", "run", "best", "n", proof.alias("low"), proof.alias("high"))

    runs = first
    highest = entries.agg(F.max("run").alias("top")).first()["top"] or 0
    for _ in range(max(1, math.ceil((int(highest).bit_length()) / fan_bits))):
        runs = merge(runs.withColumn("run", F.shiftright("run", fan_bits)))
    return runs.select("digest", "best", "n", F.col("low").alias("proof"))


def _entries(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    plain = normalised(text)
    return docs.select(
        F.col(doc_id).alias("id"),
        F.unhex(F.sha2(plain, 256)).alias("digest"),
        F.xxhash64(plain, F.length(plain)).alias("proof"),
        F.monotonically_increasing_id().alias("ord"),
    )


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one
    space. The smallest doc_id of a group stays; a null doc_id ranks last. Rows
    that tie on it (repeated rows) count in group_size and exactly one of them is
    kept. Null texts are empty texts, and all empty texts form a group. An empty
    table gives an empty result. Columns other than the two named are not read, so
    their names cannot clash.
    """
    entries = cut(_entries(docs, text, doc_id).withColumn("run", F.shiftright("ord", 33)))
    best = merged_runs(entries)
    row, keep = entries.alias("row"), best.alias("keep")
    return row.join(keep, F.col("row.digest") == F.col("keep.digest")).select(
        F.col("row.id").alias("doc_id"),
        F.col("keep.best.id").alias("keep_id"),
        F.col("keep.n").alias("group_size"),
        (F.col("row.ord") == F.col("keep.best.ord")).alias("kept"),
        F.lower(F.hex("row.digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; rules as exact_duplicates.

    The choice among rows that tie on digest and doc_id does not depend on how a
    rerun splits the input.
    """
    entries = cut(_entries(docs, text, doc_id).withColumn("run", F.shiftright("ord", 33)))
    winners = merged_runs(entries).select(F.hex("digest").alias("digest"), F.col("best.id").alias("id"))
    return keep_rows(docs, winners, F.upper(F.sha2(normalised(text), 256)), text, doc_id)

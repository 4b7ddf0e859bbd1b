"""Nearest-neighbour retrieval with cited evidence.

The order of the steps is part of the result: the ``CANDIDATES`` nearest records are
taken first (a chunk under several roots takes several places), then the best record
of each chunk stays, then the distance threshold, then the limit of at most ``MOST``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.text import base_name
from ..functions.vectors import cosine_distance, literal

#: Candidates, results, default threshold, length of an excerpt.
CANDIDATES, MOST, THRESHOLD, EXCERPT = 32, 8, 0.45, 1000
#: Questions that are asked at a time; their vectors go to every task.
QUESTION_BLOCK = 4096
#: Passages of a task that meet a block at a time.
SLICE = 512


def nearest(records: DataFrame, query: Sequence[float], roots: Sequence[str] | None = None, k: int = CANDIDATES) -> DataFrame:
    """The k nearest records by cosine distance, ties by record_id; no roots: no filter.

    The scan reads vectors only where the root filter lets them pass (it reaches the
    Parquet reader), and k rows of each task meet in a top-k.
    """
    scoped = records.where(F.col("root_id").isin(*roots)) if roots else records
    measured = scoped.withColumn("distance", cosine_distance(F.col("vector"), literal(query)))
    return measured.orderBy("distance", "record_id").limit(k)


def evidence(candidates: DataFrame, threshold: float = THRESHOLD, limit: int = MOST) -> DataFrame:
    """Best record of each chunk within the threshold (inclusive), nearest first."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise CorpusError("limit must be a positive integer", "INVALID_REQUEST")
    best = Window.partitionBy("chunk_id").orderBy("distance", "record_id")
    kept = candidates.withColumn("place", F.row_number().over(best)).where((F.col("place") == 1) & (F.col("distance") <= threshold))
    return kept.drop("place").orderBy("distance", "record_id").limit(min(limit, MOST))


def cited(rows: DataFrame) -> DataFrame:
    """Evidence columns of retrieved records; excerpts are the first 1000 code points."""
    return rows.select(
        F.substring("document", 1, EXCERPT).alias("excerpt"), "file_id", base_name(F.col("drive_path")).alias("file_name"),
        "folder_alias", "drive_path", "drive_url", "local_path", "locator", "revision", "content_hash", "mime_type", "distance",
    )


def require_scope(rows: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Rows that left the requested roots stop the query."""
    inside = F.col("root_id").isin(*roots)
    return rows.withColumn("root_id", F.when(inside, F.col("root_id")).otherwise(F.raise_error(F.lit("a candidate left the requested scope"))))


def answer(records: DataFrame, query: Sequence[float], roots: Sequence[str], threshold: float = THRESHOLD, limit: int = MOST) -> DataFrame:
    """Cited evidence for one question; an empty answer is a typed error."""
    found = cited(evidence(require_scope(nearest(records, query, roots), roots), threshold, limit))
    if found.isEmpty():
        raise CorpusError("no evidence within the threshold", "NO_RELEVANT_EVIDENCE")
    return found


def sparse_retrieve(passages: DataFrame, questions: DataFrame, dimension: int, threshold: float = THRESHOLD, k: int = CANDIDATES, limit: int = MOST, block: int = QUESTION_BLOCK) -> DataFrame:
    """(question_id, chunk_id, distance, place) for many questions over sparse unit vectors.

    Both sides are rows (id, dim, value). Questions are asked in blocks, passages are
    gathered to one row each, and a block's vectors meet slices of a task's passages as
    two matrices. A task keeps the k nearest of each question, so that k rows a question
    and task leave it at most, never a row for each pair, and no dimension is a key. The
    nearest of all tasks are taken by a last window.
    """
    held = passages.groupBy("id").agg(F.collect_list(F.struct("dim", "value")).alias("v")).select("id", F.col("v.dim").alias("dims"), F.col("v.value").alias("values"))
    asked = questions.select(F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(questions.select("id").distinct().count() / block)))).alias("block"), "id", "dim", "value")
    blocks = [r["block"] for r in asked.select("block").distinct().orderBy("block").collect()] or [0]
    near = functools.reduce(DataFrame.unionByName, [_nearest_of_block(held, asked.where(F.col("block") == b), dimension, threshold, k) for b in blocks])
    place = Window.partitionBy("question_id").orderBy("distance", "chunk_id")
    first = near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= min(k, limit))
    return first.select("question_id", "chunk_id", "distance", "place")


def _nearest_of_block(held: DataFrame, asked: DataFrame, dimension: int, threshold: float, k: int) -> DataFrame:
    """(question_id, chunk_id, distance) of the k nearest passages (id, dims, values) in each task."""
    names: dict[str, int] = {}
    cells = [(r["dim"], names.setdefault(r["id"], len(names)), r["value"]) for r in asked.orderBy("id", "dim").collect()]  # a block's
    matrix = np.zeros((dimension, len(names)))
    for dim, column, value in cells:
        matrix[dim, column] = value
    questions = np.array(list(names), object)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, chosen = np.zeros((0, len(questions))), np.zeros((0, len(questions)), object)
        for part in parts:
            for start in range(0, part.num_rows, SLICE):
                ids, dims, values = part.slice(start, SLICE).columns
                sizes = np.array([len(x) for x in dims], np.int64)
                dense = np.zeros((len(ids), dimension))
                dense[np.repeat(np.arange(len(ids)), sizes), dims.flatten().to_numpy()] = values.flatten().to_numpy()
                distance = np.concatenate([best, np.round(np.maximum(1 - dense @ matrix, 0.0), 9)])
                every = np.concatenate([chosen, np.broadcast_to(np.array(ids.to_pylist(), object)[:, None], (len(ids), len(questions)))])
                # strings are compared only where distances tie
                order = np.lexsort((np.unique(every, return_inverse=True)[1].reshape(every.shape), distance), axis=0)[:k]
                best, chosen = np.take_along_axis(distance, order, 0), np.take_along_axis(every, order, 0)
        near = best <= threshold
        asked_by = np.broadcast_to(questions, best.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked_by[near].tolist(), pa.string()), pa.array(chosen[near].tolist(), pa.string()), pa.array(best[near], pa.float64())], ["question_id", "chunk_id", "distance"]
        )

    return held.mapInArrow(run, "question_id string, chunk_id string, distance double")

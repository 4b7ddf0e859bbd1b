"""Embedders: a protocol, and a deterministic hashing embedder of built-in functions.

The hashing embedder stands in where no model can run; its distances follow shared
words and say nothing about meaning.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a model of the E5 family expects before its inputs.
PASSAGE, QUERY = "passage: ", "query: "


class Embedder(Protocol):
    model_id: str
    dimension: int

    def embed_passages(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...

    def count(self, text: str) -> int: ...


def model_identity(embedder: Embedder) -> str:
    return json.dumps({"dimension": embedder.dimension, "model_id": embedder.model_id}, sort_keys=True, separators=(",", ":"))


class HashingEmbedder:
    """Words hashed to dimensions, counted, scaled to unit length."""

    def __init__(self, dimension: int = 256):
        self.model_id, self.dimension = f"hashing-md5-{dimension}", dimension

    def _embed(self, text: str) -> list[float]:
        import hashlib
        import math

        out = [0.0] * self.dimension
        for word in text.lower().split():
            out[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimension] += 1.0
        length = math.sqrt(sum(x * x for x in out))
        return [x / length for x in out] if length else out

    def embed_passages(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._embed(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._embed(text)

    def count(self, text: str) -> int:
        return len(text.split())


def sparse_hash_vectors(texts: DataFrame, dimension: int = 256) -> DataFrame:
    """(id, dim, value): HashingEmbedder over a frame (id, text) as a sparse table, without Python."""
    words = texts.select("id", F.explode(F.split(F.lower("text"), "\\s+")).alias("w")).where("w != ''")
    dim = F.conv(F.left(F.md5("w"), F.lit(8)), 16, 10).cast("long") % dimension
    counts = words.groupBy("id", dim.alias("dim")).agg(F.count("*").cast("double").alias("n"))
    lengths = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(lengths, "id").select("id", "dim", (F.col("n") / F.col("length")).alias("value"))


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch: int = 256) -> DataFrame:
    """``chunks`` with a column vector (array<float>), embedded in batches of passages."""
    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):
                rows = part.slice(at, batch)
                texts = [PASSAGE + t for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]
                vectors = embedder.embed_passages(texts)
                if any(len(v) != embedder.dimension for v in vectors):
                    raise ValueError("the embedder gave vectors of another dimension")
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], [*rows.schema.names, "vector"])

    return chunks.mapInArrow(run, schema)

"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: At most so many edges are joined in one task.
FEW_EDGES = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    met = both.join(least, F.col("a") == F.col("of")).where("b > a")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
    met = down.join(least, F.col("a") == F.col("of"))
    moved = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct()


def _smallest_reachable(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all edges (a, b) of one task, by union with path halving."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for part in edges:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    nodes = sorted(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "label"])


def connected_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, label) of every node that has an edge (a, b: long); label is the smallest node reachable.

    Up to ``few`` edges, by their count, are joined in one task. More go through
    alternating large-star and small-star steps: aggregations and joins only, so a
    node with very many edges is combined before the shuffle and its join is
    splittable. Every round is written to the shared folder and replaces the one
    before; loops and repeated edges are ignored. The number of rounds grows with
    the logarithm of the longest path. Both ways give the same labels.
    """
    tables = Tables(edges.sparkSession, "components")
    now = tables.put(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= few:
        return tables.put(now.coalesce(1).mapInArrow(_smallest_reachable, "node long, label long"))
    stamp = None
    while True:
        last, now = now, tables.put(_small_star(_large_star(now)))
        tables.drop(last)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == stamp or not seen["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        stamp = (seen["n"], seen["h"])

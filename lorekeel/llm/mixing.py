"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. A source's schedule is a piecewise-linear weight
over that time; its integral says which share of the source's words is due by
then. A document covers a stretch of its source's word demand (its words after
those of the documents before it in hash order, a pass over the source after the
other), and inverting the integral at the middle of the stretch gives the
document's training position. Rows are range-sorted by that position.

Running totals are taken in two levels (totals of hash-range buckets, then within a
bucket), so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, n_words_of, whole_text

#: No document is taken more often.
MOST_PASSES = 3
#: Weights of the sources in order of name, repeating.
WEIGHTS = (1, 2, 3)
#: Knots (time, weight) of the schedule of each weight class: steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Bits of a document's place in its source's order; of these, at least so many name its bucket, and more where a bucket would have more rows.
KEY_BITS, BUCKET_BITS, BUCKET_ROWS = 63, 12, 4096
#: A source is filled up to this share of its target, as far as documents fit.
TOLERANCE = 0.001
#: At most so many sources are broadcast; beyond, rows are joined with them.
BROADCAST_SOURCES = 100_000


def invert_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` of a schedule's whole weight is due."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    if whole <= 0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs weights of at least 0 and some above it")
    pieces = []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        if area > 0:
            due = share * whole - F.lit(before)
            slope = (w1 - w0) / (t1 - t0)
            # w0 x + slope x^2 / 2 = due, in the form that stays exact for a slope near 0
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * due, F.lit(0.0)))
            pieces.append((before + area, F.lit(t0) + F.least(2 * due / (F.lit(w0) + root), F.lit(t1 - t0))))
        before += area
    for end, time in reversed(pieces):
        out = F.when(share * whole <= end, time).otherwise(out)
    return F.when(share <= 0, F.lit(float(knots[0][0]))).otherwise(out)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, rank, target) from rows (source, size).

    All words are shared out by weight; a target stops at ``most`` times its
    source's size and the excess is reshared until none is above. That fixed point
    is target = min(most * size, level * weight): sources are filled in order of
    most * size / weight until the level of the rest lies below the next one's.
    The windows run over one row for each source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    filling = Window.orderBy("ratio", "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("weight", weight)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
    )
    # the first source whose own ratio reaches the level of those from it on sets the level
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())["level"]
    target = F.least(cap, F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", F.col("source_size").cast("long").alias("source_size"), "rank", target.alias("target"))


def _order_key(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def _bucket_bits(narrow: DataFrame) -> int:
    """Bits of a key that name its bucket, so that one of the largest source has about BUCKET_ROWS rows."""
    most = narrow.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    return max(BUCKET_BITS, math.ceil(math.log2(most / BUCKET_ROWS)))


def _with_source(rows: DataFrame, each: DataFrame) -> DataFrame:
    """Rows (source, ...) with the columns of the row of ``each`` for their source, null being one."""
    named = each.withColumnRenamed("source", "of")
    named = F.broadcast(named) if each.count() <= BROADCAST_SOURCES else named
    return rows.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _taken_in_walks() -> Column:
    return F.exists("walks", lambda w: (F.col("size") <= w["gap"]) & (F.col("key") <= w["upto"]))


def _walk(narrow: DataFrame, state: DataFrame, bits: int) -> DataFrame:
    """``state`` (source, ..., gap, filled, walks) after one more walk in key order over the documents that fit."""
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & ~_taken_in_walks()
    bucket = F.shiftright("key", KEY_BITS - bits)
    fitting = _with_source(narrow, state.select("source", "gap", "walks")).where(fits).select("source", "size", "key", "gap", bucket.alias("bucket"))
    sums = fitting.groupBy("source", "bucket", "gap").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("offset", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    # the bucket in which the gap is reached, at most one for a source; the windows have brought a source together already
    reached = F.when((F.col("offset") <= F.col("gap")) & (F.col("gap") < F.col("offset") + F.col("sum")), F.struct("bucket", "offset"))
    each = placed.groupBy("source").agg(F.max(reached).alias("cross"), F.sum("sum").alias("all"))
    cross = each.where("cross is not null").select(F.col("source").alias("of"), F.col("cross.bucket").alias("in"), "cross.offset")
    inside = fitting.join(F.broadcast(cross), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    # a range frame: rows of one key are taken together
    upto = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    run = inside.select("source", "key", "gap", (F.col("offset") + F.sum("size").over(upto)).alias("end"))
    # what is known of a source comes together by one aggregation
    known = [
        state.select("source", F.struct(*state.columns).alias("state")),
        run.where(F.col("end") <= F.col("gap")).select("source", F.col("key").alias("last"), "end"),
        each.select("source", F.shiftleft("cross.bucket", KEY_BITS - bits).alias("begin"), "cross.offset", "all"),
    ]
    every = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), known)
    met = every.groupBy("source").agg(F.any_value("state", F.lit(True)).alias("state"), *[F.max(c).alias(c) for c in ("last", "end", "begin", "offset", "all")])
    met = met.select("state.*", "last", "end", "begin", "offset", "all")
    filled = F.coalesce("end", "offset", "all", F.lit(0))
    last = F.coalesce("last", F.col("begin") - 1, F.lit((1 << KEY_BITS) - 1))
    walk = F.struct(F.col("gap").alias("gap"), last.cast("long").alias("upto"))
    fixed = [c for c in state.columns if c not in ("gap", "filled", "walks")]
    return met.select(*fixed, (F.col("gap") - filled).cast("long").alias("gap"), filled.cast("long").alias("filled"), F.concat("walks", F.array(walk)).alias("walks"))


def source_plan(narrow: DataFrame, weights: Sequence[float], most: int, bits: int, tables: Tables) -> DataFrame:
    """(source, source_size, rank, target, whole, walks, gap, nearest): what is taken of each source.

    ``whole`` passes are taken by every document. What then is missing is filled in
    walks over the source in key order: a walk takes the documents that are no longer
    than the gap, from the first on, until the next one would exceed it; what is left
    is the next walk's gap. A walk is told by two numbers, its gap and its last key.
    Walks go on until every gap is below TOLERANCE of its target or no document fits;
    then the shortest document not taken comes in (``nearest``) if that brings the
    source closer to its target.
    """
    targets = source_targets(narrow, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(1)).cast("int")
    gap = F.when(F.col("source_size") > 0, F.floor(F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = tables.put(
        targets.withColumn("whole", whole).select("*", gap.alias("gap"), F.lit(1).cast("long").alias("filled"), F.array().cast("array<struct<gap:long,upto:long>>").alias("walks"))
    )
    while not state.where((F.col("filled") > 0) & (F.col("gap") > F.col("target") * TOLERANCE)).isEmpty():
        state, last = tables.put(_walk(narrow, state, bits)), state
        tables.drop(last)
    left = _with_source(narrow, state.select("source", "gap", "walks", "whole")).where((F.col("size") > 0) & (F.col("gap") > 0) & (F.col("whole") < most) & ~_taken_in_walks())
    # rows of one key come in together, so their words count together
    least = left.groupBy("source", "gap", "key").agg(F.sum("size").alias("words")).groupBy(F.col("source").alias("of"), "gap").agg(F.min(F.struct("words", "key")).alias("x"))
    least = least.select("of", F.when(F.col("x.words") < 2 * F.col("gap"), F.col("x.key")).alias("nearest"))
    return tables.put(state.join(least, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "filled"))


def assign_positions(rows: DataFrame, narrow: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES, bucket_bits: int | None = None) -> DataFrame:
    """``rows`` (box, id, source, size, key) with source_size, rank, target, passes, start.

    ``narrow`` are the rows (source, size, key) as a written table, ``key`` orders a
    source. ``start`` is the number of the source's words before the row in that order.
    """
    tables = Tables(rows.sparkSession, "mixing")
    bits = bucket_bits or _bucket_bits(narrow)
    plan = source_plan(narrow, weights, most, bits, tables)
    bucket = F.shiftright("key", KEY_BITS - bits)
    sums = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.put(sums.select("source", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"), F.xxhash64(F.col("source").isNull(), "source", "bucket").alias("cell")))
    here = rows.withColumn("bucket", bucket).withColumn("cell", F.xxhash64(F.col("source").isNull(), "source", "bucket"))
    met = here.alias("row").join(
        starts.alias("at"),
        (F.col("row.cell") == F.col("at.cell")) & (F.col("row.bucket") == F.col("at.bucket")) & F.col("row.source").eqNullSafe(F.col("at.source")),
    )
    within = Window.partitionBy("row.cell", "row.bucket", "row.source").orderBy("row.key", "row.id", "row.size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("at.offset") + F.sum("row.size").over(within) - F.col("row.size")
    placed = _with_source(met.select(*[F.col(f"row.{c}").alias(c) for c in rows.columns], start.alias("start")), plan)
    more = (_taken_in_walks() | F.coalesce(F.col("key") == F.col("nearest"), F.lit(False))) & (F.col("size") > 0) & (F.col("whole") < most)
    out = placed.withColumn("passes", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int"))
    return out.select(*rows.columns, "source_size", "rank", "target", "start", "passes")


def position(number: Column, schedules: Sequence = SCHEDULES) -> Column:
    """Training position of pass ``number`` (0 first) of a row of assign_positions."""
    middle = F.col("start") + F.col("size") / 2 + number * F.col("source_size")
    share = F.when(F.col("target") > 0, F.least(middle / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    kind = F.col("rank") % len(schedules)
    out = F.lit(0.0)
    for i, knots in enumerate(schedules):
        out = F.when(kind == i, invert_schedule(share, knots)).otherwise(out)
    return out


def _keyed(docs: DataFrame, box: Column, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    body = whole_text(text)
    return docs.select(
        box.alias("box"),
        F.col(doc_id).alias("id"),
        F.col(source).cast("string").alias("source"),
        n_words_of(body).alias("size"),
        _order_key(F.col(doc_id), body, seed).alias("key"),
    )


def mixing_plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes, source, position.

    size is the number of words (null text: 0), taken = passes * size. position is
    that of the first pass (null when not taken); rows come range-sorted by it. A
    null source is a source of its own, ranked last; null doc_ids are ids like others.
    Documents of a source without words pass once (they take nothing). Repeated rows
    are taken alike; other columns are not read. An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "mixing-rows")
    rows = tables.put(_keyed(docs, F.lit(True), text, doc_id, source, seed))
    out = assign_positions(rows, rows.select("source", "size", "key"))
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (F.col("size") * F.col("passes")).cast("long").alias("taken"),
        "passes",
        "source",
        F.when(F.col("passes") > 0, position(F.lit(0))).alias("position"),
    ).orderBy("position", "doc_id")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """The rows of ``docs`` in training order: each once for each pass, columns as they were.

    Nulls, repeated rows and empty tables are treated as in mixing_plan. A pass that
    only fills a gap at its source's end has the last position.
    """
    names = docs.columns
    tables = Tables(docs.sparkSession, "mixing-rows")
    narrow = tables.put(_keyed(docs, F.lit(True), text, doc_id, source, seed).select("source", "size", "key"))
    rows = _keyed(docs, F.struct(*[F.col(f"`{n}`") for n in names]), text, doc_id, source, seed)
    out = assign_positions(rows, narrow)
    copies = out.where("passes > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    return copies.withColumn("position", position(F.col("turn"))).orderBy("position", "id", "turn").select("box.*")

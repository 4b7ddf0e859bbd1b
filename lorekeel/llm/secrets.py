"""Secret scan with multipart credential linking.

Base patterns find secrets that show themselves. Weak candidates, which alone mean
nothing, are reported only with their complement: an identifier with a secret in
its scope, a secret with an identifier in its scope, an endpoint with both. A
scope reaches ``SCOPE`` characters to either side. Parts meet by an interval join:
each side is laid into blocks of positions and joined on (text, block) with the
overlap test, as a semi-join, so no pairs are written and a block holds no more
parts than its characters allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

SCOPE = 160
BLOCK = 1024
#: Matches of one text are summed in pieces of this length.
PIECE = 128

KINDS = ("assign", "access", "hex")
BASE = {
    "assign": "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{12,}",  # a shorter run is dropped whole, so the length may stand in the pattern
    "hex": "[0-9a-f]{32,}",
}
WEAK_KINDS = ("id", "key", "endpoint")
WEAK = {
    "id": "(?<![A-Za-z0-9_-])((?i:client|access|account|app|user)[_-]?(?i:id|key_id|name)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.@-]{6,}|(?=[A-Z]*[0-9])[A-Z]{4}[A-Z0-9]{12,28}(?![A-Za-z0-9_-]))",
    "key": "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])",
    "endpoint": "(?i:https?|postgres|mysql|mongodb|redis|amqp|s3)://[^\\x20\\x09-\\x0D\"'<>]+|(?i:host|endpoint|server)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9.-]+\\.[A-Za-z0-9:/.-]+",
}


def _lengths(text: Column, found: Column, pattern: str) -> Column:
    gaps = F.split(text, pattern, -1)
    return F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), x["hit"].alias("hit")),
    )


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x["gap"] + x["size"])


def add_spans(frame: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds, for each kind, an array (start, end, hit) of all its matches in ``text``.

    Matches come from regexp_extract_all and the gaps between them from split; their
    positions are running sums of both lengths, taken in pieces so that the work
    stays near linear in the number of matches.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    for kind, pattern in patterns.items():
        frame = frame.withColumn(kind, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    for kind, pattern in patterns.items():
        some = F.size(kind) > 0
        frame = frame.withColumn(kind, F.when(some, _lengths(F.col("text"), F.col(kind), pattern)))
    for kind in patterns:
        frame = frame.withColumn(f"{kind}_at", _piece_starts(F.col(kind)))
        frame = frame.withColumn(kind, F.coalesce(_placed(F.col(kind), F.col(f"{kind}_at")), none)).drop(f"{kind}_at")
    return frame


def _pieces(parts: Column) -> Column:
    return F.sequence(F.lit(1), F.size(parts), F.lit(PIECE))


def _piece_starts(parts: Column) -> Column:
    totals = F.transform(_pieces(parts), lambda c: _total(F.slice(parts, c, PIECE)))
    return F.when(parts.isNotNull(), F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.array_append(a, F.element_at(a, -1) + t)))


def _placed(parts: Column, starts: Column) -> Column:
    """The spans of parts (gap, size, hit), each piece summed on from its start."""

    def piece(c: Column, k: Column) -> Column:
        begin = F.struct(F.get(starts, k).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["hit"].alias("hit"))
            return F.struct((start + x["size"]).alias("at"), F.array_append(a["out"], span).alias("out"))

        return F.aggregate(F.slice(parts, c, PIECE), begin, step)["out"]

    return F.when(parts.isNotNull(), F.flatten(F.transform(_pieces(parts), piece)))


def _named(kinds: tuple[str, ...], first: int = 0) -> Column:
    """All spans of the kinds as one array (start, rank, kind, end)."""

    def of(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.concat(*[of(first + i, kind) for i, kind in enumerate(kinds)])


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _laid(parts: DataFrame, reach: int) -> DataFrame:
    low, high = F.floor((F.greatest(F.col("start") - reach, F.lit(0))) / BLOCK), F.floor((F.col("end") + reach) / BLOCK)
    return parts.withColumn("block", F.explode(F.sequence(low, high)))


def _near(parts: DataFrame, others: DataFrame) -> DataFrame:
    """The parts with one of the others in their scope."""
    a, b = _laid(parts, SCOPE).alias("a"), _laid(others, 0).alias("b")
    met = a.join(
        b,
        (F.col("a.text_key") == F.col("b.text_key"))
        & (F.col("a.block") == F.col("b.block"))
        & (F.col("b.start") <= F.col("a.end") + SCOPE)
        & (F.col("b.end") >= F.col("a.start") - SCOPE),
        "left_semi",
    )
    return met.select([f"a.{c}" for c in parts.columns]).distinct()


def linked_parts(found: DataFrame) -> DataFrame:
    """(text_key, links): the weak candidates that have their complements in scope.

    ``found`` has text_key, base and weak arrays (start, rank, kind, end). A text is
    linked once, however many rows have it.
    """
    mixed = found.where(F.size("weak") > 0).select("text_key", F.explode(F.concat("base", "weak")).alias("s")).select("text_key", "s.*").distinct()
    mixed = cut(mixed)
    ids, keys, ends = (mixed.where(F.col("kind").isin(*k)) for k in (("access", "id"), ("assign", "hex", "key"), ("endpoint",)))
    near = _near(ids, keys).unionByName(_near(keys, ids)).unionByName(_near(_near(ends, ids), keys))
    weak = near.where(F.col("kind").isin(*WEAK_KINDS))
    return weak.groupBy("text_key").agg(F.collect_list(F.struct("start", "rank", "kind", "end")).alias("links"))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of start, rank, kind, end).

    Base spans are the leftmost non-overlapping matches of each base pattern over
    the whole text; ``spans`` adds the linked weak candidates that overlap no base
    span. A null text is empty and has no spans; repeated rows give repeated
    results; doc_id may be null; other columns are not read.
    """
    frame = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    frame = add_spans(frame, BASE | WEAK)
    frame = frame.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["hit"], BASE["assign"], 2)) >= 8))
    frame = frame.withColumn("base", _named(KINDS))
    free = F.filter(
        _named(WEAK_KINDS, len(KINDS)), lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    )
    frame = frame.withColumn("weak", free)
    rows = cut(frame.select("doc_id", "base", "weak", F.when(F.size("weak") > 0, F.sha2("text", 256)).alias("text_key")))
    links = cut(linked_parts(rows))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    # texts without weak parts stay out of the join, where they would share one null key
    met = rows.where("text_key is not null").join(links, "text_key", "left").select("doc_id", "base", F.concat("base", F.coalesce("links", none)).alias("spans"))
    return met.unionByName(rows.where("text_key is null").select("doc_id", "base", F.col("base").alias("spans")))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """(doc_id, text) of every row, with each reported span replaced by ``mark``; overlapping spans share one.

    Null texts come back empty; nulls, repeated rows and empty tables otherwise as in
    find_secrets.
    """
    boxed = docs.select(F.struct(F.col(doc_id).alias("id"), whole_text(text).alias("text")).alias("box"), whole_text(text).alias("text"))
    found = find_secrets(boxed, "text", "box")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(F.col("doc_id.text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        fresh = F.when(s["start"] >= a["at"], F.lit(mark)).otherwise(F.lit(""))
        return F.struct(F.concat(a["out"], kept, fresh).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    done = found.withColumn("done", F.aggregate(F.sort_array("spans"), begin, step))
    return done.select(F.col("doc_id.id").alias("doc_id"), F.concat("done.out", F.expr("substring(doc_id.text, done.at + 1)")).alias("text"))

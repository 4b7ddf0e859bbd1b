"""Near-duplicates by bottom-k sketches from one hash function.

One hash function maps a document's five-word shingles to numbers; its sketch is the
k smallest. Documents with the same set are one class, and two sketch sizes are used:

1. ``KEPT`` values of every class. Inverted lists of the retained values give each
   class its overlap with all others together: how many of its values any other
   class has. A class that shares too few for even one partner at the threshold goes.
2. ``WIDE`` values of the classes left, the whole set for most. Their lists generate
   the overlaps of pairs, in two steps. First every list proposes its members to its
   centre, the member with the fewest values of its own: a large group of near copies
   becomes one label without its pairs being met. Then one whole pass decides: the
   values that different labels share are brought into one order, rarest first. From
   the first value that two sets share on, neither has more of them left than its
   remaining ones, and these must suffice for the overlap that the threshold asks
   for. Lists are joined under that condition, whatever their length and for all
   members, so that sets with frequent values meet only where they can be linked.

The sketch of the union then estimates a pair's similarity and drops it if it lies far
below the threshold; full sets decide the rest. After the pass no link between two
labels is left, so it is not repeated.

Nothing is capped. For sets of up to ``WIDE`` values the second step is exact. Sampling
enters twice: the counts of a sketch that is not the whole set, and the estimate, may
each fall short of what they estimate by ``SIGMAS`` standard deviations before a pair
at the very threshold is lost, a probability of about 1e-7.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_codec import batches
from .common import WORD, Tables, keep_rows, whole_text
from .components import connected_components

#: Words of a shingle; similarity (in hundredths) from which two documents are linked.
WORDS, SIMILAR = 5, 75
#: Retained values of every document's sketch, and of the sketch of those that may have a partner.
KEPT, WIDE = 64, 512
#: Standard deviations that a count or an estimate from a sketch may be off.
SIGMAS = 5.2
#: At most so many rows of a few numbers are broadcast; beyond, they are joined.
BROADCAST_IDS = 1_000_000

_words = re.compile(WORD.encode()).findall
_STEP = 0x9E3779B97F4A7C15


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words make one shingle."""
    import xxhash

    words = _words(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() knows A-Z only
    if not words:
        return np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        z = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            z = (z + hashed[i : len(words) - size + 1 + i]) * np.uint64(_STEP)
            z ^= z >> np.uint64(29)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.unique(z.view(np.int64))


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _arrays(lists: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kept: int = KEPT) -> DataFrame:
    """doc_id, ord, n (size of the set), digest of the set, sketch (the smallest ``kept`` values)."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("ord"), whole_text(text).alias("text"))
    schema = T.StructType([*frame.schema.fields[:2], *T._parse_datatype_string("n long, digest binary, text_sha256 string, sketch array<long>").fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in batches(part, "text"):
                sets = [shingle_set(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string()),
                        _arrays([s[:kept] for s in sets]),
                    ],
                    schema.names,
                )

    return frame.mapInArrow(run, schema)


def full_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest, values (the full set) of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, texts in batches(part, "text", 64):
                sets = [shingle_set(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), _arrays(sets)], ["digest", "values"])

    return docs.select(whole_text(text).alias("text")).mapInArrow(run, "digest binary, values array<long>")


def _bounded(frame: DataFrame) -> DataFrame:
    """A written frame of a few numbers, marked for broadcast where its row count allows it."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_IDS else frame


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILAR


def _slack(kept: int) -> float:
    """What a count out of ``kept`` sampled values may fall short by."""
    share = SIMILAR / 100
    return SIGMAS * math.sqrt(kept * share * (1 - share))


def _least(n: Column, kept: int) -> Column:
    """Retained values that a set of n must share with its partner, whichever that is."""
    exact = F.ceil(n * SIMILAR / 100)
    # a partner has up to n * 100 / SIMILAR values: its sketch may be a sample where that exceeds kept
    return F.when(n * 100 <= kept * SIMILAR, exact).otherwise(F.least(exact, F.lit(math.floor(kept * SIMILAR / 100 - _slack(kept)))))


def _least_of_pair(a: Column, b: Column, kept: int) -> Column:
    """Retained values that sets of a and b values must share: similarity s asks for an overlap of (a + b) s / (1 + s)."""
    overlap = (a + b) * SIMILAR / (100 + SIMILAR)
    sampled = overlap * kept / F.greatest(a, b) - _slack(kept)
    return F.when(F.greatest(a, b) <= kept, overlap).otherwise(sampled) - 1e-6


def _survivors(classes: DataFrame, tables: Tables) -> DataFrame:
    """cid of the classes that share enough of their sketch with others for a partner to be possible."""
    held = classes.select("cid", "n", F.explode("sketch").alias("value"))
    shared = tables.put(held.groupBy("value").agg(F.count("*").alias("members")).where("members > 1").select("value"))
    met = held.join(_bounded(shared), "value", "left_semi").groupBy("cid", "n").agg(F.count("*").alias("shared"))
    out = tables.put(met.where(F.col("shared") >= _least(F.col("n"), KEPT)).select("cid"))
    tables.drop(shared)
    return out


def _sets_of(cids: DataFrame, classes: DataFrame, docs: DataFrame, text: str, doc_id: str, tables: Tables) -> DataFrame:
    """cid, n, sketch, values (the full set) of the classes named, from the texts of their first rows."""
    chosen = tables.put(classes.select("cid", "doc_id", "digest").join(_bounded(cids), "cid", "left_semi"), narrow=True)
    ids = chosen.select(F.col("doc_id").alias("pick"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")).join(_bounded(ids), F.col("doc_id").eqNullSafe(F.col("pick")), "left_semi")
    found = full_sets(rows).join(_bounded(chosen.select("digest", "cid")), "digest")
    out = tables.put(found.select("cid", F.monotonically_increasing_id().alias("mark"), F.size("values").cast("long").alias("n"), F.slice("values", 1, KEPT).alias("sketch"), "values"))
    if out.count() > chosen.count():  # repeated rows
        firsts = tables.put(out.groupBy("cid").agg(F.min("mark").alias("mark")).select("mark"))
        out = out.join(_bounded(firsts), "mark", "left_semi")
    return out.drop("mark")


def _ranked(sets: DataFrame) -> DataFrame:
    """cid, n, values: the retained values that other classes have too, rarest first, with their numbers of members."""
    held = sets.select("cid", "n", F.explode(F.slice("values", 1, WIDE)).alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    met = held.join(shared, "value").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("members", "value"))).alias("values"))
    return met.where(F.size("values") >= _least(F.col("n"), WIDE))


def _star_pairs(ranked: DataFrame) -> DataFrame:
    """a, b, na, nb, lists: members with the centres of their lists, and how many lists propose them."""
    kept = F.least("n", F.lit(WIDE))
    held = ranked.select("cid", "n", ((kept - F.size("values")) / kept).alias("own"), F.explode("values.value").alias("value"))
    centres = held.groupBy("value").agg(F.min(F.struct("own", "cid", "n")).alias("c"))
    met = held.join(centres, "value").where((F.col("cid") != F.col("c.cid")) & _sizes_fit(F.col("n"), F.col("c.n")))
    return met.groupBy(F.col("cid").alias("a"), F.col("c.cid").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb")).agg(F.count("*").alias("lists"))


def _star_links(ranked: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """Links between list members and centres: those the lists themselves prove, and of the others each member's best one."""
    pairs = tables.put(_star_pairs(ranked))
    whole = (F.greatest("na", "nb") <= WIDE) & (F.col("lists") * (100 + SIMILAR) >= (F.col("na") + F.col("nb")) * SIMILAR)
    proven = pairs.where(whole).select("a", "b")
    best = tables.put(pairs.groupBy("a").agg(F.max(F.struct(whole.alias("proven"), "lists", "b")).alias("best")).where("not best.proven").select("a", "best.b"))
    links = _verified(best, sets, tables)
    return proven.unionByName(links)


def _whole_pass(ranked: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """a, b: the pairs of different labels that can reach the overlap from their first shared value on."""
    named = _bounded(labels.withColumnRenamed("node", "cid"))
    held = ranked.join(named, "cid", "left").select("cid", "n", F.coalesce("label", "cid").alias("label"), F.explode("values").alias("at"))
    held = held.select("cid", "n", "label", "at.members", "at.value")
    spread = held.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("smallest"))
    spread = tables.put(spread.where("low < high").select("value", "smallest"))
    met = held.join(_bounded(spread), "value")
    lists = met.groupBy("cid", "n", "label").agg(F.sort_array(F.collect_list(F.struct("members", "value", "smallest"))).alias("values"))
    at = lists.select("cid", "n", "label", F.size("values").alias("all"), F.posexplode("values").alias("pos", "at"))
    at = at.select("cid", "n", "label", (F.col("all") - F.col("pos")).alias("left"), "at.value", "at.smallest")
    n, least = F.col("n"), _least(F.col("n"), WIDE)
    useful = F.when(n * 100 <= WIDE * SIMILAR, F.col("left") >= _least_of_pair(n, F.col("smallest"), WIDE)).otherwise(True)
    entries = tables.put(at.where((F.col("left") >= least) & useful).drop("smallest"))
    x, y = entries.alias("x"), entries.alias("y")
    enough = F.least("x.left", "y.left") >= _least_of_pair(F.col("x.n"), F.col("y.n"), WIDE)
    met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.label") < F.col("y.label")) & _sizes_fit(F.col("x.n"), F.col("y.n")) & enough)
    out = tables.put(met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct())
    tables.drop(spread, entries)
    return out


def _met(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """a, b, na, nb, va, vb: written pairs with a column of both their sets.

    Each side of a pair fetches its own and the two meet by the pair, so that a set
    with very many partners is no hot key, and sets without partners stay where they are.
    """
    some = _bounded(pairs.select("a", "b"))
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col(column).alias("va")).join(some, "a")
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col(column).alias("vb")).join(some, "b")
    return left.join(right, ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """The links (a, b): pairs that the union's sketch lets pass and that reach the similarity on their full sets."""
    shared = F.array_intersect("va", "vb")
    union = F.slice(F.sort_array(F.array_union("va", "vb")), 1, KEPT)
    size = F.least(F.size("union"), F.lit(KEPT))
    near = F.size(F.array_intersect("union", "shared")) >= size * SIMILAR / 100 - F.when((F.col("na") <= KEPT) & (F.col("nb") <= KEPT), 1e-6).otherwise(_slack(KEPT))
    passed = tables.put(_met(pairs, sets, "sketch").select("a", "b", "na", "nb", union.alias("union"), shared.alias("shared")).where(near).select("a", "b"), narrow=True)
    counted = _met(passed, sets, "values").select("a", "b", "na", "nb", F.size(shared).alias("shared"))
    return tables.put(counted.where(100 * F.col("shared") >= SIMILAR * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b"), narrow=True)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, ord, text_sha256, n_shingles, component_id, kept.

    Words are lower-cased in A-Z only; documents are linked from a Jaccard
    similarity of 0.75 of their distinct five-word shingles (fewer words: the whole
    sequence as one). Rows without words, null texts included, have an empty set
    and are linked with nothing: each is a component of its own. component_id is
    the smallest doc_id of the component (null only if all its doc_ids are); repeated
    rows are in one class, and exactly one row of a component is kept: the first of
    those with the smallest doc_id. An empty table gives an empty result. Other
    columns are not read.
    """
    tables = Tables(docs.sparkSession, "near")
    rows = tables.put(sketches(docs, text, doc_id))
    some = rows.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("ord"))).alias("best")
    heads = some.groupBy("digest").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = tables.put(heads.select(F.col("best.ord").alias("cid"), F.col("best.doc_id").alias("doc_id"), "digest", "n", "sketch"))

    sets = _sets_of(_survivors(classes, tables), classes, docs, text, doc_id, tables)
    ranked = tables.put(_ranked(sets))
    stars = _star_links(ranked, sets, tables)
    labels = connected_components(stars)
    rest = _verified(_whole_pass(ranked, labels, tables), sets, tables)
    labels = connected_components(labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(rest))
    tables.drop(ranked)

    # components of one class have no label; classes of larger ones are few columns wide
    named = classes.select("cid", "doc_id", "digest").join(labels.withColumnRenamed("node", "cid"), "cid")
    best = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("cid").alias("ord"))).alias("best"))
    linked = named.join(best, "label").select("digest", "best.doc_id", "best.ord")
    single = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left_anti").select("digest", "doc_id", F.col("cid").alias("ord"))
    found = tables.put(linked.unionByName(single).select("digest", F.col("doc_id").alias("component_id"), F.col("ord").alias("kept_ord")), narrow=True)
    tables.drop(classes)
    members = some.select("doc_id", "ord", "n", "text_sha256", "digest").join(found, "digest").select(
        "doc_id", "ord", "text_sha256", F.col("n").alias("n_shingles"), "component_id", (F.col("ord") == F.col("kept_ord")).alias("kept")
    )
    alone = rows.where("n = 0").select("doc_id", "ord", "text_sha256", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return members.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, with the columns of ``docs``; rules as near_duplicates.

    Rows that agree in doc_id and whole text (repeated rows) stay as one, those
    without words included.
    """
    kept = near_duplicates(docs, text, doc_id).where("kept").select(F.col("text_sha256").alias("digest"), F.col("doc_id").alias("id"))
    return keep_rows(docs, kept, F.sha2(whole_text(text), 256), text, doc_id)

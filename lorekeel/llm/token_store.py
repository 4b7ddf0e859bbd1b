"""Content-addressed store of token ids.

A rolling hash cuts each document's ids into chunks by content, so equal passages
make equal chunks wherever they stand. A chunk's address is the SHA-256 of its ids;
its bytes are stored once. A document is a recipe (the addresses in order, with
their places) under a Merkle root, and the recipes lie in ascending doc_id order in
numbered parts with a manifest row each.

    chunks/    stored=true: digest, n, ids (binary); stored=false: where chunks occur
    recipes/   part, pos, local_start, doc_id, ord, n_tokens, root, chunks
    manifest/  part, docs, tokens, start, root, top

Everything hangs on ``top``: it is the root of a Merkle tree over the manifest's rows, a
row's ``root`` is that of a tree over its part's recipes in order (in blocks of BLOCK
leaves, so that no task needs a whole part), a recipe's leaf covers its place, its
doc_id, its number of ids and its document's root, and that is the root of a tree over
the chunks' addresses and places. Reading proves all of it.

Ids of one chunk are little-endian unsigned 16-bit integers where all fit, else
32-bit; ``n`` tells which. All folders lie in the shared checkpoint folder.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_codec import Codec, batches, grouped
from .common import shared_dir, whole_text

#: A chunk ends where the high bits of the rolling hash are 0: 512 ids on average.
CUT_BITS = 9
#: Ids that the rolling hash looks back over.
SPAN = 16
#: A chunk ends after so many ids at the latest.
LONGEST = 4096
#: Recipes in a block of a part's Merkle tree.
BLOCK = 1024
#: Addresses that a task remembers to send a chunk's bytes once.
SENT = 50_000

OCCURRENCE = "doc_id long, ord long, seq long, at long, n int, n_tokens long, root binary, digest binary, ids binary, slot binary"


def _gears(ids: np.ndarray) -> np.ndarray:
    """A fixed 64-bit random number for each id (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@functools.cache
def _gear_table() -> np.ndarray:
    return _gears(np.arange(1 << 16))


def cut_streams(ids: np.ndarray, stops: np.ndarray, cut_bits: int = CUT_BITS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the chunks of id streams that lie one behind the other, each to its stop.

    The rolling hash of a stream does not see the one before it.
    """
    rolled = _gear_table()[ids] if ids.max(initial=0) < 1 << 16 else _gears(ids)
    width = 1
    while width < SPAN:  # h[i] = sum of 3**j * gear[i - j] over the last SPAN ids, by doubling
        more = rolled.copy()
        with np.errstate(over="ignore"):
            more[width:] += rolled[:-width] * np.uint64(pow(3, width, 1 << 64))
        heads = (stops[:-1, None] + np.arange(width)).ravel()
        heads = heads[heads < np.repeat(stops[1:], width)]
        more[heads] = rolled[heads]
        rolled, width = more, width * 2
    ends = np.union1d(np.flatnonzero((rolled >> np.uint64(64 - cut_bits)) == 0) + 1, stops)
    ends = ends[ends > 0]
    begins = np.concatenate(([0], ends))[:-1].astype(np.int64)
    pieces = -(-(ends - begins) // longest)
    begins = np.repeat(begins, pieces) + longest * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return begins, np.minimum(begins + longest, np.repeat(ends, pieces))


def cut_points(ids: np.ndarray, cut_bits: int = CUT_BITS, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of one id stream; the last is its length."""
    return cut_streams(ids, np.array([len(ids)]), cut_bits, longest)[1].tolist()


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if len(ids) == 0 or ids.max() < 1 << 16 else "<u4").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.uint32)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 digests; an odd last node moves up as it is."""
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def chunk_leaf(at: int, n: int, digest: bytes) -> bytes:
    return hashlib.sha256(b"\x00%d:%d:" % (at, n) + digest).digest()


def chunk_streams(streams: list[np.ndarray], end_id: int) -> Iterator[list[tuple[int, int, bytes, bytes]]]:
    """The chunks (at, n, digest, bytes) of each of the id streams with ``end_id`` behind it, all cut at once."""
    ids = np.concatenate([x for s in streams for x in (s, [end_id])]).astype(np.int32)
    stops = np.cumsum([len(s) + 1 for s in streams])
    begins, ends = cut_streams(ids, stops)
    shared = packed(ids) if ids.max() < 1 << 16 else None
    owner = np.searchsorted(stops, ends)
    at = (begins - np.concatenate(([0], stops))[owner]).tolist()
    places = itertools.pairwise(np.searchsorted(owner, np.arange(len(streams) + 1)).tolist())
    begins, ends = begins.tolist(), ends.tolist()
    for first, last in places:
        out = []
        for i in range(first, last):
            begin, end = begins[i], ends[i]
            body = shared[2 * begin : 2 * end] if shared is not None else packed(ids[begin:end])
            out.append((at[i], end - begin, hashlib.sha256(body).digest(), body))
        yield out


def _lists(column: pa.ListArray, *fields: str) -> Iterator[list[tuple]]:
    """The named fields of each list of structs."""
    flat = column.flatten()
    rows = list(zip(*[flat.field(f).to_numpy(zero_copy_only=False).tolist() for f in fields], strict=True))
    for begin, end in itertools.pairwise(np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy())))).tolist()):
        yield rows[begin:end]


def _chunked(docs: DataFrame, path: str, text: str, doc_id: str, end_id: int) -> DataFrame:
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("ord"), whole_text(text).alias("text"))
    names = [x.split()[0] for x in OCCURRENCE.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sent = Codec.at(path), OrderedDict()
        for part in parts:
            for rows, texts in batches(part, "text"):
                out: list[tuple] = []
                found = itertools.chain.from_iterable(chunk_streams(some, end_id) for some in grouped(codec.encode_all(texts)))
                for number, order, chunks in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), found, strict=True):
                    n_tokens = chunks[-1][0] + chunks[-1][1]
                    root = merkle_root([chunk_leaf(at, n, digest) for at, n, digest, _ in chunks])
                    for seq, (at, n, digest, body) in enumerate(chunks):
                        if new := digest not in sent:
                            sent[digest] = None
                            if len(sent) > SENT:
                                sent.popitem(last=False)
                        # bytes meet by address; an occurrence without them goes anywhere
                        slot = digest if new else hashlib.blake2b(b"%d:%d" % (order, seq), digest_size=8).digest()
                        out.append((number, order, seq, at, n, n_tokens if seq == 0 else None, root if seq == 0 else None, digest, body if new else None, slot))
                columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return frame.mapInArrow(run, OCCURRENCE)


def write_store(docs: DataFrame, path: str, store: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int = 1) -> str:
    """Encode ``docs``, append ``end_id`` to each, write the store and return its folder.

    Null texts are empty (only the end id). Documents lie in ascending doc_id
    order, nulls last; rows that tie on it (repeated rows) follow in input order,
    each with its own recipe. doc_id is cast to long. Other columns are not read. An
    empty table gives an empty store.
    """
    spark = docs.sparkSession
    store = store or f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    first = Window.partitionBy("slot").orderBy(F.col("ids").isNull(), "ord", "seq")
    placed = _chunked(docs, path, text, doc_id, end_id).withColumn("stored", F.col("ids").isNotNull() & (F.row_number().over(first) == 1))
    placed.withColumn("ids", F.when(F.col("stored"), F.col("ids"))).drop("slot").write.partitionBy("stored").option("compression", "zstd").parquet(f"{store}/chunks")

    def numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pos, part_id = 0, 0, TaskContext.get().partitionId()
        for part in parts:
            n = part.column(part.schema.get_field_index("n_tokens")).to_numpy()
            ends = at + np.cumsum(n)
            columns = [pa.array(np.full(len(n), part_id), pa.int64()), pa.array(np.arange(pos, pos + len(n)), pa.int64()), pa.array(ends - n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *part.columns], ["part", "pos", "local_start", *part.schema.names])
            at, pos = int(ends[-1]) if len(ends) else at, pos + len(n)

    seen = chunk_table(spark, store)
    recipes = seen.groupBy("ord", "doc_id").agg(
        F.max("n_tokens").alias("n_tokens"),
        F.max("root").alias("root"),
        F.sort_array(F.collect_list(F.struct("seq", "at", "n", "digest"))).alias("chunks"),
    )
    ranged = recipes.select(F.col("doc_id").isNull().alias("none"), "*").repartitionByRange("none", "doc_id", "ord").sortWithinPartitions("none", "doc_id", "ord").drop("none")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "pos", "local_start")] + ranged.schema.fields)
    ranged.mapInArrow(numbered, schema).write.option("compression", "zstd").parquet(f"{store}/recipes")
    _write_manifest(spark, store)
    return store


def part_roots(recipes: DataFrame) -> DataFrame:
    """part, docs, tokens, root: the Merkle tree over each part's recipes, block by block."""
    fields = ["part", "pos", "local_start", "doc_id", "ord", "n_tokens"]
    shown = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in fields])
    leaf = F.unhex(F.sha2(F.concat(F.col("root"), shown.cast("binary")), 256))
    blocks = recipes.select("part", "pos", "n_tokens", leaf.alias("leaf")).groupBy("part", F.floor(F.col("pos") / BLOCK).alias("block"))
    each = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("pos", "leaf"))).alias("leaves"))

    def rooted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            roots = [merkle_root([x for x, in leaves]) for leaves in _lists(part.column(3), "leaf")]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) for x in part.column(3)], pa.int64()), pa.array(roots, pa.binary())], ["part", "block", "tokens", "docs", "root"])

    tops = each.select("part", "block", "tokens", F.col("leaves")).mapInArrow(rooted, "part long, block long, tokens long, docs long, root binary")
    whole = tops.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("block", "root"))).alias("blocks"))

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            roots = [merkle_root([x for x, in blocks]) for blocks in _lists(part.column(3), "root")]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(roots, pa.binary())], ["part", "docs", "tokens", "root"])

    return whole.mapInArrow(joined, "part long, docs long, tokens long, root binary")


MANIFEST = "part long, docs long, tokens long, start long, root binary, top binary"


def _top(rows: list) -> bytes:
    """The root over manifest rows (part, docs, tokens, start, root) in order of part."""
    return merkle_root([hashlib.sha256(b"%d:%d:%d:%d:" % tuple(r[:4]) + bytes(r[4])).digest() for r in rows])


def _write_manifest(spark: SparkSession, store: str) -> None:
    """One row for each part of the recipes; the driver holds those only."""
    start, rows = 0, []
    for row in sorted(part_roots(spark.read.parquet(f"{store}/recipes")).collect(), key=lambda r: r["part"]):
        rows.append((row["part"], row["docs"], row["tokens"], start, bytearray(row["root"])))
        start += row["tokens"]
    top = bytearray(_top(rows))
    spark.createDataFrame([(*r, top) for r in rows], MANIFEST).coalesce(1).write.parquet(f"{store}/manifest")


def proved_manifest(spark: SparkSession, store: str) -> DataFrame:
    """part, start of the manifest, whose rows are held against ``top`` and against the recipes; a difference stops the job."""
    known = spark.read.schema(MANIFEST).parquet(f"{store}/manifest")
    rows, start = sorted(known.collect(), key=lambda r: r["part"]), 0  # a row for each part
    for r in rows:
        if r["start"] != start or bytes(r["top"]) != _top(rows):
            raise ValueError("the manifest does not lead to its Merkle root")
        start += r["tokens"]
    found = part_roots(spark.read.parquet(f"{store}/recipes")).withColumn("found", F.lit(True))
    same = F.col("f.found") & F.col("m.top").isNotNull() & (F.col("m.docs") == F.col("f.docs")) & (F.col("m.tokens") == F.col("f.tokens")) & (F.col("m.root") == F.col("f.root"))
    met = known.alias("m").join(found.alias("f"), F.col("m.part") == F.col("f.part"), "full")
    sure = F.when(F.coalesce(same, F.lit(False)), F.col("m.start")).otherwise(F.raise_error(F.lit("a part's recipes do not lead to its Merkle root")).cast("long"))
    return met.select(F.coalesce("m.part", "f.part").alias("part"), sure.alias("start"))


#: The polynomial of CRC-32, reflected.
_CRC_POLY = 0xEDB88320


def _crc_multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of reflected polynomials modulo that of CRC-32, elementwise."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(np.broadcast(a, b).shape, np.uint64)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(_CRC_POLY), np.uint64(0))
    return out


@functools.cache
def _shift(k: int) -> np.ndarray:
    """x ** (8 * 2 ** k), a shift over 2 ** k zero bytes."""
    return _crc_multiply(_shift(k - 1), _shift(k - 1)) if k else np.array([1 << 23], np.uint64)


@functools.cache
def _shift_table(k: int) -> np.ndarray:
    """Products of that shift with each value of a checksum's byte 0 to 3."""
    values = np.arange(256, dtype=np.uint64) << np.arange(0, 32, 8, dtype=np.uint64)[:, None]
    return _crc_multiply(values, np.full(values.shape, _shift(k)[0]))


def crc_shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What checksums contribute to that of a stream with ``after`` more bytes behind them."""
    out, rest, k = crc.astype(np.uint64), after.astype(np.uint64), 0
    while rest.any():
        odd = np.flatnonzero(rest & np.uint64(1))
        if len(odd):
            some, table = out[odd], _shift_table(k)
            out[odd] = np.bitwise_xor.reduce([table[i][((some >> np.uint64(8 * i)) & np.uint64(255)).astype(np.intp)] for i in range(4)])
        rest, k = rest >> np.uint64(1), k + 1
    return out


def chunk_table(spark: SparkSession, store: str) -> DataFrame:
    """The rows of chunks/, with their declared types."""
    return spark.read.schema(OCCURRENCE.rpartition(", ")[0] + ", stored boolean").parquet(f"{store}/chunks")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, ord, start, n_tokens, ids_crc32 of every document, from the files alone.

    Each chunk's bytes are held against its address, each document's addresses
    against its Merkle root, each part's recipes against the manifest and that
    against its top; a difference stops the job. doc_ids are whole numbers (others
    are cast to long when written, to null where that fails). The checksum of a document
    is put together from those of its chunks, so bytes are read once for a chunk and
    never moved.
    """
    chunks = chunk_table(spark, store).where("stored").select("digest", "n", "ids")

    def checked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests, crcs = part.column(0).to_numpy(zero_copy_only=False).tolist(), []
            for digest, n, body in zip(digests, part.column(1).to_numpy().tolist(), part.column(2).to_numpy(zero_copy_only=False).tolist(), strict=True):
                if hashlib.sha256(body).digest() != digest or len(body) not in (2 * n, 4 * n):
                    raise ValueError(f"chunk {digest.hex()} does not hold what its address says")
                crcs.append(zlib.crc32(unpacked(body, n).astype("<u4", copy=False)))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(crcs, pa.int64())], ["stored_digest", "crc"])

    sums = chunks.mapInArrow(checked, "stored_digest binary, crc long")
    recipes = spark.read.parquet(f"{store}/recipes")
    used = recipes.select("part", "local_start", "doc_id", "ord", "n_tokens", "root", F.posexplode("chunks").alias("seq", "c")).select(
        "ord", "seq", "c.digest", ((F.col("n_tokens") - F.col("c.at") - F.col("c.n")) * 4).alias("after")
    )
    met = used.join(sums, F.col("digest") == F.col("stored_digest"), "left")

    def shifted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.column(3).null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            out = crc_shifted(part.column(3).to_numpy(), part.column(2).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out)], ["ord", "digest", "crc"])

    each = met.select("ord", "digest", "after", "crc").mapInArrow(shifted, "ord long, digest binary, crc long")
    whole = each.groupBy("ord").agg(F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("found"))
    manifest = F.broadcast(proved_manifest(spark, store))  # a row for each part

    def proved(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for root, chunks in zip(part.column(4).to_pylist(), _lists(part.column(5), "at", "n", "digest"), strict=True):
                if merkle_root([chunk_leaf(*c) for c in chunks]) != root:
                    raise ValueError("a recipe does not lead to its Merkle root")
            yield part.select([0, 1, 2, 3, 6])

    heads = recipes.join(manifest, "part").select(
        "doc_id", "ord", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "root", "chunks",
        F.size("chunks").cast("long").alias("n_chunks"),
    )
    heads = heads.mapInArrow(proved, "doc_id long, ord long, start long, n_tokens long, n_chunks long")
    out = heads.join(whole, "ord")
    count = F.when(F.col("found") == F.col("n_chunks"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document lost chunks")).cast("long"))
    return out.select("doc_id", "ord", "start", "n_tokens", count.alias("ids_crc32"))


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, ord, ids (array<int>) of every document, put together from its chunks.

    Null doc_ids stay null, repeated rows have their own recipes (``ord`` tells them
    apart), an empty store gives no rows. Proofs are left to read_store.
    """
    recipes = spark.read.parquet(f"{store}/recipes").select("doc_id", "ord", F.explode("chunks").alias("c"))
    chunks = chunk_table(spark, store).where("stored").select(F.col("digest").alias("stored_digest"), "ids")
    met = recipes.select("doc_id", "ord", "c.seq", "c.n", "c.digest").join(chunks, F.col("digest") == F.col("stored_digest"))
    docs = met.groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "ids"))).alias("parts"))

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = [np.concatenate([unpacked(bytes(c["ids"]), c["n"]) for c in d]).astype(np.int32) for d in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ord", "ids"])

    return docs.mapInArrow(joined, "doc_id long, ord long, ids array<int>")

"""BPE encoding and decoding of whole texts, exact against the tokenizer library.

Where white space only separates the tokenizer's pre-tokens, a text is encoded word
by word and each distinct word once for a Python worker (a bounded cache); with a
tokenizer of another kind the library gets whole texts. A word without
any white space that is longer than ``LONG`` characters is encoded by tree
concatenation: its pre-tokens are halved down to leaves, ``THREADS`` threads encode the
leaves at the same time (the library leaves Python's lock meanwhile), and neighbours are
joined pairwise up a tree, the joins of a level again at the same time. At a join a
window of tokens around it is encoded anew and grown until its first and last tokens
agree with the old ones on both sides. In BPE a sequence whose neighbouring tokens each encode to
themselves is the encoding of the whole, so agreement there makes the join exact.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, whole_text

#: Words of more characters are encoded by tree concatenation.
LONG = 256
#: Characters of a leaf of that tree, at most, and threads that work on one.
LEAF, THREADS = 4096, 4
#: Distinct words kept by a worker; beyond, the cache starts anew.
CACHE_WORDS = 500_000
#: Characters worked on at a time.
PIECE = 1 << 21

_words = re.compile(WORD).findall
#: Texts of these characters only (no apostrophe, no "<") fall into pre-tokens that need no look around:
#: runs of letters, single digits, runs of signs.
_simple = re.compile("[\\x09-\\x0D\\x20-&(-;=-~À-ÖØ-öø-ÿ]*").fullmatch
_NO_LETTERS = "([0-9]|[^a-zß-öø-ÿ0-9\\x20]+)"


class Codec:
    """One tokenizer file, with a word cache. ``Codec.at(path)`` gives a process's own."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, long: int = LONG, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache_words, self.long, self.leaf = cache_words, long, leaf
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        #: tree concatenation needs added tokens that match plainly, and a BPE model that merges from characters
        self.plain_added = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        self.added = {a["content"]: a["id"] for a in added}
        self.split_added = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if added else None
        self.by_tree = self.plain_added and spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges") and not spec["model"].get("continuing_subword_prefix")
        if self.by_tree:
            bare = spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "truncation": None, "padding": None}
            self.end_part = Tokenizer.from_str(json.dumps(bare))
            bare["model"] = spec["model"] | {"end_of_word_suffix": None}
            self.inner_part = Tokenizer.from_str(json.dumps(bare))
        #: white space is dropped between pre-tokens, so words are encoded alone; letters and signs are pre-tokens of their own
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        rule = steps[0].get("pattern", {}).get("Regex", "")
        removed = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        self.by_word = bool(removed and rule.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") and self.plain_added)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        lowers = "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        self.in_parts = self.by_word and self.by_tree and lowers and len(steps) == 2 and steps[1].get("type") == "ByteLevel"
        if self.in_parts:
            from tokenizers import pre_tokenizers

            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))}
            self.part_model = self.end_part.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.strings = [self.tokenizer.id_to_token(i) for i in range(max(size, top))]
        self.joins = spec.get("decoder") is None
        self._clear()

    @staticmethod
    @functools.cache
    def at(path: str) -> Codec:
        return Codec(path)

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}  # words
        self.part_slot: dict[str, int] = {}  # pre-tokens of simple texts
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)

    def _make_room(self) -> None:
        if len(self.slot) + len(self.part_slot) > self.cache_words or self.used > 16 * self.cache_words:
            self._clear()

    def _store(self, words: list[str], counts: np.ndarray, ids: np.ndarray, slot: dict[str, int] | None = None) -> None:
        n, k = len(self.slot) + len(self.part_slot), len(words)
        while n + k > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.count[n : n + k] = counts
        self.begin[n : n + k] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        (self.slot if slot is None else slot).update(zip(words, range(n, n + k), strict=True))

    def _encode_each(self, words: list[str]) -> None:
        """Store words without white space, by one library call for each thousand."""
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            owner = np.array([-1 if x is None else x for x in found.word_ids], np.int64)
            counts = np.bincount(owner + 1, minlength=len(some) + 1)
            # an equal total proves nothing: a word of other white space only has no pre-token, another word several
            if len(counts) == len(some) + 1 and counts[0] == 0 and counts[1:].all() and _inside(found.offsets, owner, some):
                self._store(some, counts[1:], np.array(found.ids, np.int32))  # one pre-token for each word
            else:
                each = self.tokenizer.encode_batch(some, add_special_tokens=False)
                self._store(some, np.array([len(e.ids) for e in each], np.int64), np.array([i for e in each for i in e.ids], np.int32))

    def _learn(self, words: list[str]) -> None:
        self._encode_each([w for w in words if len(w) <= self.long or not self.by_tree])
        for w in words:
            if w not in self.slot:
                ids = np.array(self.encode_long(w), np.int32)
                self._store([w], np.array([len(ids)], np.int64), ids)

    def _encode_simple(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple texts and the number of each text's, by columns of pre-tokens.

        Each distinct pre-token is encoded once, by the library's model, in the form
        that its normaliser and byte-level step give it.
        """
        self._make_room()
        for space in "\t\n\v\f\r":
            texts = [t.replace(space, " ") for t in texts]
        lower = pc.utf8_lower(pa.array(texts, pa.string()))
        parts = pc.split_pattern(pc.replace_substring_regex(lower, pattern=_NO_LETTERS, replacement=r" \1 "), " ")
        coded = parts.values.dictionary_encode()
        own, slot = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.part_slot  # to_pylist makes a scalar of each
        found_at = np.fromiter(map(slot.get, own, itertools.repeat(-1)), np.int64, len(own))
        missing = np.flatnonzero(found_at < 0).tolist()
        new = [own[i] for i in missing]
        short = [p for p in new if p and len(p) <= self.leaf]
        for at in range(0, len(short), 1000):
            some = short[at : at + 1000]
            found = [[t.id for t in self.part_model.tokenize(p if p.isascii() else p.translate(self.bytes))] for p in some]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self._store(some, counts, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum())), slot)
        for p in new:
            if p not in slot:
                ids = np.array(self.encode_part(p.translate(self.bytes)) if p else [], np.int32)
                self._store([p], np.array([len(ids)], np.int64), ids, slot)
        found_at[missing] = [slot[p] for p in new]
        at = found_at[coded.indices.to_numpy()]
        counts = self.count[at]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.pool[np.repeat(self.begin[at] - ends[1:] + counts, counts) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.int32)
        return ids, np.diff(ends[parts.offsets.to_numpy()])

    def _gather(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        counts = self.count[at]
        ends = np.cumsum(counts)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int32), counts
        return self.pool[np.repeat(self.begin[at] - ends + counts, counts) + np.arange(ends[-1])], counts

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and the number of each word's."""
        self._make_room()
        new = set(words).difference(self.slot)
        if new:
            self._learn(sorted(new))
        return self._gather(words)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each of the texts, as the library encodes it whole."""
        if not self.by_word:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[np.ndarray] = []
        for group in grouped(texts):
            if len(group) == 1 and len(group[0]) > PIECE:
                parts = [self.encode_words(_words(p))[0] for p in _pieces(group[0])]
                out.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
                continue
            easy = [self.in_parts and _simple(t) is not None for t in group]
            done = iter(_split(*self._encode_simple([t for t, e in zip(group, easy, strict=True) if e]))) if any(easy) else iter(())
            lists = [_words(t) for t, e in zip(group, easy, strict=True) if not e]
            rest = iter(())
            if lists:
                ids, counts = self.encode_words(list(itertools.chain.from_iterable(lists)))
                ends = np.concatenate(([0], np.cumsum(counts)))
                rest = iter(_split(ids, np.diff(ends[np.cumsum([0, *map(len, lists)])])))
            out += [next(done if e else rest) for e in easy]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids, skip_special_tokens=False)."""
        if not self.joins:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        known, n = self.strings, len(self.strings)
        return " ".join([s for i in ids.tolist() if i < n and (s := known[i]) is not None])

    def encode_long(self, word: str) -> list[int]:
        """A word without white space, by tree concatenation within its pre-tokens."""
        ids: list[int] = []
        at = 0
        for m in itertools.chain(self.split_added.finditer(word) if self.split_added else (), (None,)):
            plain = word[at : m.start() if m else len(word)]
            if plain:
                normal = self.tokenizer.normalizer.normalize_str(plain) if self.tokenizer.normalizer else plain
                parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, None)]
                for part, _ in parts:
                    ids += self.encode_part(part)
            if m:
                ids.append(self.added[m.group()])
                at = m.end()
        return ids

    def encode_part(self, part: str) -> list[int]:
        """One pre-token: halves down to leaves, all encoded side by side, then joins up the tree."""
        if len(part) <= self.leaf:
            return self.end_part.encode(part, add_special_tokens=False).ids
        leaves = _halves(part, self.leaf)
        with ThreadPoolExecutor(THREADS) as pool:
            done = list(pool.map(self._leaf, leaves, [self.inner_part] * (len(leaves) - 1) + [self.end_part]))
            while len(done) > 1:
                pairs = list(itertools.zip_longest(done[::2], done[1::2]))
                done = list(pool.map(lambda k, pairs=pairs: self._join(*pairs[k], last=k + 1 == len(pairs)) if pairs[k][1] is not None else pairs[k][0], range(len(pairs))))
        return done[0]

    @staticmethod
    def _leaf(text: str, encoder) -> list[int]:
        return encoder.encode_batch([text], add_special_tokens=False)[0].ids  # a batch is encoded without Python's lock

    def _text(self, ids: list[int], last: bool) -> str:
        text = "".join(self.strings[i] for i in ids)
        suffix = self.tokenizer.model.end_of_word_suffix
        return text[: -len(suffix)] if last and suffix else text

    def _join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            ends = last and b == len(right)
            window = left[a:] + right[:b]
            encoder = self.end_part if ends else self.inner_part
            fresh = self._leaf(self._text(window, ends), encoder)
            if (a == 0 or fresh[0] == window[0]) and (b == len(right) or fresh[-1] == window[-1]):
                return left[:a] + fresh + right[b:]
            width *= 2


def _halves(text: str, most: int) -> list[str]:
    """The leaves of a text that is halved until no piece has more than ``most`` characters."""
    if len(text) <= most:
        return [text]
    middle = len(text) // 2
    return _halves(text[:middle], most) + _halves(text[middle:], most)


def _inside(offsets: list[tuple[int, int]], owner: np.ndarray, words: list[str]) -> bool:
    """Whether each token (start, end) lies in its own word of the words joined by single spaces."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes + 1) - sizes - 1
    spans = np.array(offsets, np.int64).reshape(-1, 2)
    return bool(((begin[owner] <= spans[:, 0]) & (spans[:, 1] <= (begin + sizes)[owner])).all())


def _split(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    stops = np.concatenate(([0], np.cumsum(counts))).tolist()
    return [ids[a:b] for a, b in itertools.pairwise(stops)]


def grouped(texts: list) -> Iterator[list]:
    """The texts (or arrays of ids) in runs of about PIECE characters (ids); a longer one is a run of its own."""
    group: list = []
    size = 0
    for t in texts:
        if group and size + len(t) > PIECE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _pieces(text: str) -> Iterator[str]:
    """A text cut at white space into pieces of PIECE characters or the next longer."""
    gap, at = re.compile("[\\x20\\x09-\\x0D]"), 0
    while at < len(text):
        m = gap.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def batches(frame: pa.RecordBatch, column: str, rows: int = 640) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of an Arrow batch with the texts of a column."""
    for at in range(0, frame.num_rows, rows):
        some = frame.slice(at, rows)
        yield some, some.column(some.schema.get_field_index(column)).to_pylist()


def _boxed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("box"), whole_text(text).alias("text"))


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(box, n_tokens, ids): each row's columns as a struct and its ids as array<int>.

    A null text is empty and gives no ids; repeated rows give repeated results. The
    input's columns are inside ``box``, so no name can clash.
    """
    frame = _boxed(docs, text)
    schema = T.StructType([frame.schema["box"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for part in parts:
            for rows, texts in batches(part, "text"):
                ids = codec.encode_all(texts)
                ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["box", "n_tokens", "ids"]
                )

    return frame.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(box, decoded) of the rows of encode_documents; null ids decode to null, none to an empty text."""
    schema = T.StructType([encoded.schema["box"], T.StructField("decoded", T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for part in parts:
            for rows, ids in batches(part, "ids"):
                texts = [None if i is None else codec.decode(np.array(i, np.int64)) for i in ids]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["box", "decoded"])

    return encoded.select("box", "ids").mapInArrow(run, schema)


def codec_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from its ids.

    Both ways happen in one pass, so ids and decoded texts never leave the worker.
    Null texts are empty (no ids, an empty decoded text); null doc_ids stay null.
    """
    frame = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    schema = T.StructType(
        [
            frame.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        names = list(map(str, range(len(codec.strings))))
        for part in parts:
            for rows, texts in batches(part, "text"):
                ids = codec.encode_all(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([sha(" ".join([names[x] for x in i.tolist()])) for i in ids], pa.string()),
                        pa.array([sha(codec.decode(i)) for i in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return frame.mapInArrow(run, schema)

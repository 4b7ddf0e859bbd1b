"""Token counts under a unigram model, by dynamic programming over a trie.

A pre-token is a word with a leading mark. The distinct pre-tokens that a worker has
not counted yet go into a trie; a node is a prefix, and its forward score (the best log
probability of a segmentation of that prefix, with its number of pieces) is computed
once, when the node is made, from the scores of its ancestors. The count of a
pre-token is what its last node stores, and a document's count is their sum.

Pre-tokens of up to ``LONG`` characters are sorted, so that those with a prefix in
common are neighbours, and their trie is made level by level, all nodes of a level at
once; the pieces that end at a node are followed through a trie of the vocabulary.
Longer ones are walked one by one.

The model is a public vocabulary with a fixed prior: the piece of rank r has log
probability -ln(r) - ln(H), with H the harmonic number of the vocabulary's size.
A character of no piece counts as its UTF-8 bytes.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .bpe_codec import PIECE, grouped
from .common import whole_text

MARK = "▁"
#: Nodes of a worker's trie of long pre-tokens; beyond, it starts anew (results stay the same).
NODES = 500_000
#: Counted words kept by a worker; beyond, they start anew.
WORDS = 500_000
#: Characters of a pre-token whose nodes are made level by level, and pre-tokens of such a trie.
LONG, TOGETHER = 64, 32_768
#: Cost of a character of no piece, below the least piece.
UNKNOWN_BELOW = 10.0

_gap = re.compile(rb"[\x20\x09-\x0D]")


def vocabulary(path: str) -> dict[str, float]:
    """Piece to log probability, from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    harmonic = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {piece: -math.log(rank) - harmonic for rank, piece in enumerate(pieces, 1)}


class PrefixTrie:
    """Forward scores shared by all pre-tokens with a prefix in common."""

    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        self.scores, self.limit = scores, nodes
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_BELOW
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        #: lengths of the pieces that end in one or two given characters, longest first
        self.ends = {end: tuple(sorted(sizes, reverse=True)) for end, sizes in ends.items()}
        self._clear()

    def _clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.pieces: list[int] = [0]

    def count(self, token: str) -> int:
        """Pieces of the best segmentation of a pre-token."""
        if len(self.best) > self.limit:
            self._clear()
        children, best, pieces, scores, ends = self.children, self.best, self.pieces, self.scores, self.ends
        node, path = 0, [0]
        for at, char in enumerate(token, 1):
            key = node * 0x110000 + ord(char)
            child = children.get(key)
            if child is None:
                top, number, alone = -math.inf, 0, False
                sizes = ends.get(token[max(0, at - 2) : at], ()) if at > 1 else ()
                for size in (*sizes, 1) if not sizes or sizes[-1] != 1 else sizes:
                    if size <= at and (p := scores.get(token[at - size : at])) is not None:
                        alone = alone or size == 1
                        if (score := best[path[at - size]] + p) > top:
                            top, number = score, pieces[path[at - size]] + 1
                if not alone and (score := best[node] + self.unknown) > top:
                    top, number = score, pieces[node] + len(char.encode("utf-8", "surrogatepass"))
                child = children[key] = len(best)
                best.append(top)
                pieces.append(number)
            node = child
            path.append(node)
        return pieces[node]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Pieces of the best segmentation of each pre-token."""
        order = sorted(range(len(tokens)), key=tokens.__getitem__)
        short = [i for i in order if 0 < len(tokens[i]) <= LONG]
        found = np.zeros(len(tokens), np.int64)
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            found[some] = self._together([tokens[i] for i in some])
        for i in order:
            if len(tokens[i]) > LONG:
                found[i] = self.count(tokens[i])
        return found

    @functools.cached_property
    def _pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vocabulary's trie: keys (state, character) in order, the state of each, and the scores of states.

        State 0 has no piece below it, 1 is the root.
        """
        step: dict[int, int] = {}
        scores = [-math.inf, -math.inf]
        for piece, score in self.scores.items():
            state = 1
            for char in piece:
                state = step.setdefault(state << 21 | ord(char), len(scores))
                if state == len(scores):
                    scores.append(-math.inf)
            scores[state] = score
        keys = np.array([*sorted(step), np.iinfo(np.int64).max], np.int64)  # no key is as high as the last
        return keys, np.array([*map(step.get, keys[:-1].tolist()), 0], np.int64), np.array(scores)

    def _together(self, tokens: list[str]) -> np.ndarray:
        """counts of sorted pre-tokens, none empty or long.

        Column k of a level's ``best`` and ``number`` has the forward score of each node's
        ancestor k levels up, and that of ``state`` where the k + 1 characters up to the node
        stand in the vocabulary's trie.
        """
        keys, targets, scores = self._pieces
        width = max(map(len, self.scores), default=1)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        chars = np.array(tokens, f"U{sizes.max()}").view(np.uint32).reshape(len(tokens), -1).astype(np.int64)
        found = np.zeros(len(tokens), np.int64)
        best, number, state = np.zeros((1, width)), np.zeros((1, width), np.int64), np.zeros((1, width), np.int64)
        rows, node = np.arange(len(tokens)), np.zeros(len(tokens), np.int64)  # pre-tokens that reach the level, and their nodes
        for depth in range(1, int(sizes.max()) + 1):
            reach = sizes[rows] >= depth
            rows, node = rows[reach], node[reach]
            own = chars[rows, depth - 1]
            first = np.ones(len(rows), bool)
            first[1:] = (node[1:] != node[:-1]) | (own[1:] != own[:-1])
            parent, char = node[first], own[first]
            node = np.cumsum(first) - 1
            before = np.ones((len(parent), width), np.int64)
            before[:, 1:] = state[parent, :-1]
            live = np.flatnonzero(before)
            key = before.ravel()[live] << 21 | char[live // width]
            at = np.searchsorted(keys, key)
            state = np.zeros((len(parent), width), np.int64)
            state.ravel()[live] = np.where(keys[at] == key, targets[at], 0)
            gain = scores[state]
            score = best[parent] + gain
            longest = width - 1 - np.argmax(score[:, ::-1], axis=1)  # of equal scores, that of the longest piece
            all_nodes = np.arange(len(parent))
            top, pieces = score[all_nodes, longest], number[parent, longest] + 1
            unknown = best[parent, 0] + self.unknown
            unseen = (gain[:, 0] == -math.inf) & (unknown > top)
            size = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
            top, pieces = np.where(unseen, unknown, top), np.where(unseen, number[parent, 0] + size, pieces)
            best, number = np.column_stack((top, best[parent, :-1])), np.column_stack((pieces, number[parent, :-1]))
            ends = sizes[rows] == depth
            found[rows[ends]] = pieces[node[ends]]
        return found


class WordCounts:
    """Counts of words (as UTF-8), each distinct one counted once as long as it is kept."""

    def __init__(self, trie: PrefixTrie, limit: int = WORDS):
        self.trie, self.limit = trie, limit
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        found = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            lacking = [words[i] for i in missing]
            new = list(set(lacking))
            self.known.update(zip(new, self.trie.counts([MARK + w.decode() for w in new]).tolist(), strict=True))
            found[missing] = list(map(self.known.__getitem__, lacking))
        return found

    def of_texts(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        n_words, n_tokens = [], []
        for group in grouped(texts):
            if len(group) == 1:
                parts = [self.of(p.split()) for p in _cut(group[0])]
                n_words.append(sum(map(len, parts)))
                n_tokens.append(sum(int(p.sum()) for p in parts))
                continue
            lists = [t.split() for t in group]  # of bytes: at ASCII white space only
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            ends = np.concatenate(([0], np.cumsum(self.of(list(itertools.chain.from_iterable(lists))))))
            stops = np.cumsum(sizes)
            n_words += sizes.tolist()
            n_tokens += (ends[stops] - ends[stops - sizes]).tolist()
        return n_words, n_tokens


def _cut(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of PIECE bytes or the next longer."""
    at = 0
    while at < len(text):
        m = _gap.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


@functools.cache
def _counts(path: str) -> WordCounts:
    return WordCounts(PrefixTrie(vocabulary(path)))


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens (long) of every row, over whole texts.

    Null and empty texts have no words and no tokens; null doc_ids stay null;
    repeated rows give repeated results; other columns are not read. A text of any
    length is handled word by word, and rows never leave their partition.
    """
    frame = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    schema = T.StructType([frame.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path)
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                rows = part.slice(at, 1024)
                n_words, n_tokens = counts.of_texts(rows.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return frame.mapInArrow(run, schema)

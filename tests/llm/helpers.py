"""Documents with every awkward shape, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from pathlib import Path

import public_tokenizers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, words string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    return str(Path(public_tokenizers.path(name)))


def prose(rng: random.Random, n: int) -> str:
    syllables = ("on", "the", "re", "ti", "es", "an", "la", "und", "ción", "que", "é", "ß")
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(seed: int = 5) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near and exact copies."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    base = prose(rng, 120).split(" ")
    texts += [" ".join(base), "  ".join(base) + "\n", " ".join(base).upper()]
    for i in range(6):  # near copies
        near = list(base)
        near[i * 7] = f"changed{i}"
        texts.append(" ".join(near))
    texts += ["", "   \n\t ", None, "a", "a b c d", "A B c d", "x" * 30_000, prose(rng, 20_000), "one two three four five six " * 30]
    texts += [f"{prose(rng, 30)}\n{texts[3]}\n\n{texts[3]}"]
    out = [(i, t, rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "s3", None)), None if t is None else len(t), i, bool(i % 2), "w", "d") for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[5], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else ())


def components(sets: list[frozenset]) -> list[int]:
    """Smallest index reachable, by comparing all pairs."""
    best = list(range(len(sets)))

    def find(x: int) -> int:
        while best[x] != x:
            x = best[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                best[y] = x
    return [find(i) for i in range(len(sets))]

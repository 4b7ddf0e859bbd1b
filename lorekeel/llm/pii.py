"""Personal data by candidate gradient boosting.

Base patterns always count. Beside them, high-recall generators propose spans that
may overlap (written-out e-mail addresses, numbers in the shapes of telephones,
cards, national and bank account numbers, long network addresses); boosted trees
score every candidate by its format and the words around it; a candidate is
redacted when its calibrated probability reaches its kind's threshold. Of
overlapping candidates the likeliest stays, and none overlaps a base span.

The trees are trained here on sentences from a generator with a fixed seed
(``EXAMPLES`` of them, a third held out for calibration and thresholds): people's
data in the ways it is written, and numbers that merely look like it.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .bpe_codec import batches
from .common import whole_text

#: Generated training sentences, and the precision that thresholds reach on the held-out third.
EXAMPLES, PRECISION, SEED = 9000, 0.985, 20240611

#: Kinds in their order; the base patterns know the first four.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
BASE_KINDS = KINDS[:4]

_local = re.compile("[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _local.match(text, start - 1):
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of the base patterns that pass their tests."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if any(c in text for c in "0123456789"):
        out["ip"] = [m.span() for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in _card.finditer(text) if len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _phone.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


#: Generators: kind, what must occur, pattern. Their spans may overlap each other.
GENERATORS = (
    ("email", None, re.compile(r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]{0,63}\x20?[\[({]?\x20?(?:(?i:at)|@)\x20?[\])}]?\x20?[A-Za-z0-9-]{2,63}(?:\x20?[\[({]?\x20?(?:(?i:dot)|\.)\x20?[\])}]?\x20?[A-Za-z]{2,12}){1,3}(?![\w@])")),
    ("phone", "0", re.compile(r"(?<![\w.+/@#$-])\(?[0-9]{2,4}\)?[\x20./-]{0,2}[0-9]{2,4}[\x20.-]?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4})?(?![\w/@%-])(?!\.[0-9])")),
    ("card", "0", re.compile(r"(?<![\w.+-])[0-9]{4}(?:[\x20.-]?[0-9]){9,11}(?![\w-])(?!\.[0-9])")),
    ("card", "0", re.compile(r"(?<![\w.+-])[0-9]{4}(?:[./_][0-9]{4}){3}(?![\w-])")),
    ("ssn", "0", re.compile(r"(?<![\w.+-])[0-9]{3}[-\x20.][0-9]{2}[-\x20.][0-9]{4}(?![\w-])(?!\.[0-9])")),
    ("iban", "0", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", ":", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::|[0-9A-Fa-f]{1,4})(?:[0-9A-Fa-f:]{0,20})(?![\w:])")),
)

#: Words around a candidate, by what they speak for.
CONTEXT = {
    "phone": "phone tel telephone call mobile cell fax ring dial whatsapp sms handy telefon móvil teléfono téléphone portable",
    "email": "email e-mail mail write contact reach address correo courriel",
    "card": "card visa mastercard amex credit debit cvv expires payment karte tarjeta carte",
    "ssn": "ssn social security taxpayer insurance nino",
    "iban": "iban bank account transfer konto cuenta compte bic swift",
    "ip": "ip host server address logged connection from login client ipv6",
    "against": "order invoice ref reference id serial part version isbn issn doi page tracking ticket item sku figure table chapter year since between population score total price",
}
_context = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_word = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans, overlapping ones included."""
    some_digit = any(c in text for c in "0123456789")
    out = []
    for kind, needs, pattern in GENERATORS:
        if needs == "0" and not some_digit or needs == ":" and (not some_digit or "::" not in text and text.count(":") < 4):
            continue
        if kind == "email" and "@" not in text and not _dotted(text):
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(set(out), key=lambda c: (c[1], c[2], c[0]))


_dot_word = re.compile(r"(?i:[\[({\x20]at[\])}\x20])")
_dotted = _dot_word.search


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a candidate and words within 48 characters before and 24 behind it."""
    span = text[start:end]
    digits = _digits(span)
    groups = re.findall("[0-9]+", span)
    before = [w.lower() for w in _word.findall(text[max(0, start - 48) : start])]
    after = [w.lower() for w in _word.findall(text[end : end + 24])]
    near, wide = set(before[-3:]), set(before) | set(after)
    seps = [c for c in span if not c.isalnum()]
    return [
        float(KINDS.index(kind)),
        float(len(span)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(len(seps)),
        float(len(set(seps))),
        float("(" in span or "[" in span),
        float("." in span),
        float("-" in span),
        float("@" in span),
        float(bool(re.search(r"(?i)[\[({\x20]at[\])}\x20]", span))),
        float(bool(re.search(r"(?i)[\[({\x20]dot[\])}\x20]", span))),
        float(bool(re.search(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", span))),
        float(len(digits) >= 12 and luhn(digits)),
        float(kind == "iban" and _iban_ok(span)),
        float(len(set(digits))),
        float(digits[:1] == "0"),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[\x20./-].*|.*[\x20./-](?:19|20)[0-9]{2}", span))),
        float(kind == "ssn" and digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000"),
        float(bool(near & _context[kind])),
        float(bool(wide & _context[kind])),
        float(bool(near & _context["against"])),
        float(bool(wide & _context["against"])),
        float(text[start - 1 : start] in (":", "=", "(", "<", '"') or text[max(0, start - 2) : start] in (": ", "= ")),
    ]


def _sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]], bool]:
    """A generated sentence with one span and whether the span is a person's."""
    word = lambda: "".join(rng.choice(("on", "th", "er", "re", "ti", "es", "an", "la", "und", "ción", "que")) for _ in range(rng.randint(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: word() + rng.choice(("", ".", "_")) + word()

    def carded(n: int) -> str:
        body = rng.choice(("37", "4", "51", "6011", "36"))
        body += number(n - 1 - len(body))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban() -> str:
        country, rest = rng.choice(("DE", "FR", "ES", "GB")), number(rng.choice((18, 20, 23)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        s = f"{country}{check:02d}{rest}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    kind, true = rng.choice(KINDS), rng.random() < 0.5
    lead = ""
    if true:
        lead = rng.choice(CONTEXT[kind].split()) + rng.choice((" ", ": ", " = ", " is ", " number ", " ")) if rng.random() < 0.7 else ""
        if kind == "email":
            a, d = rng.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("@", "."), (" @ ", " . "), (" (at) ", "."), ("[at]", "[dot]")))
            body = f"{name()}{a}{word()}{d}{rng.choice(('com', 'org', 'net', 'de', 'info'))}"
        elif kind == "phone":
            body = rng.choice((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"0{number(3)} {number(3)} {number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(2)} {number(4)} {number(4)}"))
            lead = lead if "(" in body or lead or rng.random() < 0.3 else "call "
        elif kind == "card":
            n = rng.choice((13, 14, 15, 15, 16))
            s = carded(n)
            body = rng.choice((s, f"{s[:4]} {s[4:10]} {s[10:]}")) if n != 16 else ".".join(s[i : i + 4] for i in range(0, 16, 4))
        elif kind == "ssn":
            body = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        elif kind == "iban":
            body = iban()
        else:
            parts = [f"{rng.randint(1, 65535):x}" for _ in range(8)]
            body = ":".join(parts) if rng.random() < 0.6 else ":".join(parts[:3]) + "::" + parts[4]
    else:
        lead = rng.choice(CONTEXT["against"].split()) + rng.choice((" ", ": ", " = ", " no. ")) if rng.random() < 0.5 else ""
        body = {
            "email": lambda: rng.choice((f"{word()} at {word()}. {word().capitalize()}", f"{word()} at {word()}.{word()}", f"{word()} at the {word()}.", f"@{word()}")),
            "phone": lambda: rng.choice((f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1900, 2030)}", number(rng.randint(6, 12)), f"{rng.randint(1900, 2020)}-{rng.randint(1900, 2030)}", f"{number(3)} {number(3)}", f"{rng.randint(1, 999)} {number(3)} {number(3)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(4)} {number(4)}")),
            "card": lambda: rng.choice((number(14), number(13), number(15), f"{rng.randint(2000, 2030)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}{number(6)}", f"978{number(10)}")),
            "ssn": lambda: rng.choice((f"{number(3)} {number(2)} {number(4)}", f"9{number(2)}-{number(2)}-{number(4)}", f"000-{number(2)}-{number(4)}")),
            "iban": lambda: f"{rng.choice(('AB', 'XK', 'DE', 'PO'))}{number(2)}{rng.choice((number(8), number(12), 'REF0' + number(8)))}",
            "ip": lambda: rng.choice((f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", ":".join(f"{rng.randint(0, 255):02x}" for _ in range(6)), f"{number(2)}:{number(2)}:{number(2)}:{number(2)}")),
        }[kind]()
    head, tail = prose(2, 8) + rng.choice((" ", ", ", ". ")), rng.choice((" ", ", ", ". ", "; ")) + prose(1, 6)
    text = head + lead + body + tail
    start = len(head) + len(lead)
    return text, [(kind, start, start + len(body))], true


@dataclass(frozen=True)
class Detector:
    model: boosting.Booster
    limits: tuple[float, ...]
    held_out: tuple[float, float]

    def added(self, text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
        """Accepted candidates that overlap no base span; of overlapping ones the likeliest."""
        found = candidates(text)
        if not found:
            return []
        taken = sorted(s for spans in base.values() for s in spans)
        free = [c for c in found if not any(a < c[2] and c[1] < b for a, b in taken)] if len(taken) < 64 else _apart(found, taken)
        if not free:
            return []
        p = self.model.probability(np.array([features(text, *c) for c in free]))
        good = sorted((-p[i], free[i]) for i in range(len(free)) if p[i] >= self.limits[KINDS.index(free[i][0])])
        return _without_overlaps([c for _, c in good])


def _apart(found: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that overlap no taken span, by one walk over both in order of start."""
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, e in taken]))
    out = []
    for c in found:
        i = int(np.searchsorted(starts, c[2])) - 1  # the last that starts before its end
        if i < 0 or ends[i] <= c[1]:
            out.append(c)
    return out


def _without_overlaps(ranked: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    import bisect

    kept: list[tuple[int, int]] = []
    out = []
    for kind, a, b in ranked:
        i = bisect.bisect_left(kept, (a, b))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
            kept.insert(i, (a, b))
            out.append((kind, a, b))
    return out


def labelled(examples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all candidates in generated sentences."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(examples):
        text, spans, true = _sentence(rng)
        base = base_spans(text)
        known = [s for v in base.values() for s in v]
        for c in candidates(text):
            if not any(a < c[2] and c[1] < b for a, b in known):
                x.append(features(text, *c))
                y.append(float(true and c in spans))
    return np.array(x), np.array(y)


@functools.cache
def detector(examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> Detector:
    """The trained detector; the same parameters give the same one."""
    x, y = labelled(examples, seed)
    cut = 2 * len(x) // 3
    model = boosting.calibrated(boosting.fit(x[:cut], y[:cut]), x[cut:], y[cut:])
    p, limits = model.probability(x[cut:]), []
    for k in range(len(KINDS)):
        own = x[cut:, 0] == k
        limits.append(max(0.5, boosting.threshold(p[own], y[cut:][own], precision)) if own.any() else 1.1)
    chosen = p >= np.array(limits)[x[cut:, 0].astype(int)]
    good = y[cut:] > 0
    return Detector(model, tuple(limits), (float(good[chosen].mean()) if chosen.any() else 1.0, float(chosen[good].mean())))


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", examples: int = EXAMPLES) -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of kind, start, end in code points).

    Both are ordered by kind as listed, then start. A null text is empty and has no
    spans; null doc_ids stay null; repeated rows give repeated results; other columns
    are not read. Texts are searched whole, in time linear in their length.
    """
    model = detector(examples)
    frame = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    schema = T.StructType([frame.schema["doc_id"], *T._parse_datatype_string(f"base {SPAN}, spans {SPAN}").fields])
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in batches(part, "text"):
                bases, everything = [], []
                for t in texts:
                    base = base_spans(t)
                    own = [(k, a, b) for k, spans in base.items() for a, b in spans]
                    more = sorted(own + model.added(t, base), key=lambda s: (rank[s[0]], s[1]))
                    bases.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                    everything.append([{"kind": k, "start": a, "end": b} for k, a, b in more])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(bases, kind_type), pa.array(everything, kind_type)], ["doc_id", "base", "spans"])

    return frame.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, text) of every row with each span replaced by its kind in brackets.

    Null texts come back empty; nulls, repeated rows and empty tables otherwise as in
    find_personal_data.
    """
    model = detector(examples)
    frame = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))

    def clean(t: str) -> str:
        base = base_spans(t)
        spans = sorted([(a, b, k) for k, v in base.items() for a, b in v] + [(a, b, k) for k, a, b in model.added(t, base)])
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [t[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in batches(part, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([clean(t) for t in texts], pa.string())], ["doc_id", "text"])

    return frame.mapInArrow(run, frame.schema)

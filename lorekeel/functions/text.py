"""Scalar text functions as column expressions; built-ins only where Spark has them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text routines see it: the White_Space property and the four information separators.
_EDGE = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def newlines(text: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_extracted(text: Column) -> Column:
    """Extraction form: LF, blanks and tabs as one blank, at most one empty line, stripped."""
    return strip(F.regexp_replace(F.regexp_replace(newlines(text), "[ \t]+", " "), "\n{3,}", "\n\n"))


def normalize_chunk(text: Column) -> Column:
    """Chunk form: LF, blanks as one blank (tabs stay: they separate cells), stripped."""
    return strip(F.regexp_replace(newlines(text), " +", " "))


def chunk_id(file_id: Column, revision: Column, locator: Column, ordinal: Column, text: Column) -> Column:
    """file_id:sha256 of identity, place and text, NUL-separated."""
    nul = "\0"
    return F.concat(file_id, F.lit(":"), F.sha2(F.concat_ws(nul, file_id, revision, locator, ordinal.cast("string"), text), 256))


def record_id(chunk: Column, root: Column) -> Column:
    """A compact JSON array of chunk and root."""
    return F.to_json(F.array(chunk, root))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def suffixed_name(name: Column, file_id: Column) -> Column:
    """stem__<8 hex of sha256(file_id)>.ext; a leading or a trailing dot makes no extension."""
    # a name of dots and one word (a dot file) has no extension, nor has one that ends in a dot
    ext = F.when(name.rlike("^[.]+[^.]*$"), F.lit("")).otherwise(F.regexp_extract(name, "[^/]([.][^./]+)$", 1))
    stem = F.left(name, F.length(name) - F.length(ext))
    return F.concat(stem, F.lit("__"), F.left(F.sha2(file_id, 256), F.lit(8)), ext)


def native_name(name: Column) -> Column:
    """The name under which a native file is materialised: with .pdf unless it has it."""
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def column_name(index: Column) -> Column:
    """1 is A, 27 is AA; three letters are enough for any sheet's width. Below 1: A."""
    letter = lambda n: F.char(F.lit(65) + n)
    i = F.greatest(index.cast("int"), F.lit(1)) - 1
    one, two = letter(F.pmod(i, F.lit(26))), letter(F.pmod(F.floor(i / 26) - 1, F.lit(26)))
    three = letter(F.pmod(F.floor((F.floor(i / 26) - 1) / 26) - 1, F.lit(26)))
    return F.when(i < 26, one).when(i < 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def with_notes(text: Column, notes: Column) -> Column:
    a, b = normalize_extracted(text), normalize_extracted(notes)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("\nNotes:\n"), b)).otherwise(F.concat(a, b))


def json_key(key: Column) -> Column:
    """.key, or ["key"] where the key is no plain name."""
    quoted = F.regexp_replace(F.to_json(F.array(key)), "^\\[|\\]$", "")
    return F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit("["), quoted, F.lit("]")))


def rfc3339(text: Column) -> Column:
    """The instant of an RFC 3339 UTC text ending in Z; null if it is none."""
    shape = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?Z$")
    return F.when(shape, F.try_to_timestamp(text))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def canonical_alias(value: str) -> str | None:
    """Stripped NFC form of a folder alias; None if it is unsafe. Spark has no NFC, and aliases are few."""
    text = unicodedata.normalize("NFC", value.strip())
    bad = text in ("", ".", "..") or "/" in text or "\\" in text or any(unicodedata.category(c)[0] == "C" for c in text)
    return None if bad else text


def alias_key(value: str) -> str | None:
    text = canonical_alias(value)
    return None if text is None else text.casefold()

"""Native structured content: documents, spreadsheets, presentations.

Content that is in a table already has nested columns and relational operators. Content
that arrives as JSON files beside the payloads is routed by its kind: SHAPES tells what
each kind holds, one check compares a file with its kind's shape, and the items that
pass become rows of the same form for all kinds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.text import normalize_extracted, with_notes
from .tabular import MAX_CELLS, sheet_blocks, sheet_lines

#: Sections, sheets or slides of one file, and bytes of text in it.
MAX_ITEMS, MAX_TEXT_BYTES = 20_000, 250 << 20
#: For each kind the list's key, and its items' keys with their types.
SHAPES = {
    "document": ("sections", {"locator": str, "text": str}),
    "spreadsheet": ("sheets", {"name": str, "rows": list}),
    "presentation": ("slides", {"number": int, "text": str, "notes": str}),
}


def _require(sure: bool, message: str) -> None:
    if not sure:
        raise CorpusError(message, "INVALID_STRUCTURED_CONTENT")


def cell_text(value: object) -> str:
    """A spreadsheet's scalar as text: nothing for null, TRUE or FALSE, numbers in their shortest form."""
    _require(value is None or isinstance(value, str | int | float), "a cell holds no scalar")
    return "" if value is None else str(value).upper() if isinstance(value, bool) else str(value)


def structured_items(raw: object) -> tuple[str, list[dict]]:
    """The kind and the items of structured content that has its kind's shape, keys and types exactly."""
    kind = raw.get("kind") if isinstance(raw, dict) else None
    _require(isinstance(kind, str) and kind in SHAPES, "the content is of no known kind")
    holder, fields = SHAPES[kind]
    _require(set(raw) == {"kind", holder} and isinstance(raw[holder], list) and len(raw[holder]) <= MAX_ITEMS, f"{holder} must be the only list, of {MAX_ITEMS} items at most")
    for item in raw[holder]:
        _require(isinstance(item, dict) and set(item) == set(fields), f"an item of {holder} has other keys")
        _require(all(isinstance(item[k], t) and not isinstance(item[k], bool) for k, t in fields.items()), f"an item of {holder} has another type")
    names = [item[next(iter(fields))] for item in raw[holder]]
    if kind == "document":
        _require(all(n.startswith("section:") for n in names), "a locator must start with section:")
    else:
        _require(len(set(names)) == len(names), f"{holder} must differ")
        _require(all(n > 0 if isinstance(n, int) else n.strip() for n in names), f"an item of {holder} has no name or number")
    return kind, raw[holder]


def structured_pieces(data: bytes, native_kind: str) -> Iterator[tuple[str, str, str | None]]:
    """(locator, text, notes) of a structured file; texts are not normalised yet."""
    try:
        raw = json.loads(data)
    except (ValueError, RecursionError) as error:
        raise CorpusError("the structured file is no JSON", "INVALID_STRUCTURED_CONTENT") from error
    kind, items = structured_items(raw)
    if kind != native_kind:
        raise CorpusError("the structured file is of another kind than announced", "INVALID_ARTIFACT")
    if kind == "spreadsheet":
        _require(all(isinstance(r, list) for s in items for r in s["rows"]), "rows must be lists")
        _require(sum(max(1, len(r)) for s in items for r in s["rows"]) <= MAX_CELLS, "too many cells")
        items = [s | {"rows": [[cell_text(c) for c in r] for r in s["rows"]]} for s in items]
        texts = [c for s in items for r in s["rows"] for c in r]
    else:
        texts = [v for item in items for v in item.values() if isinstance(v, str)]
    _require(sum(len(t.encode("utf-8", "surrogatepass")) for t in texts) <= MAX_TEXT_BYTES, "too much text")
    for item in items:
        if kind == "document":
            yield item["locator"], item["text"], None
        elif kind == "presentation":
            yield f"slide:{item['number']}", item["text"], item["notes"]
        else:
            yield from ((place, text, None) for place, text in sheet_lines(item["rows"], item["name"], True))


def piece_text(locator: Column, text: Column, notes: Column) -> Column:
    """A piece's text as a block has it: prose normalised, slides with their notes, sheets as they are."""
    return F.when(locator.startswith("slide:"), with_notes(text, notes)).when(locator.startswith("section:"), normalize_extracted(text)).otherwise(text)


def document_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of documents (file_id, revision, sections array<struct<locator,text>>)."""
    one = documents.select("file_id", "revision", F.posexplode("sections").alias("block_pos", "s"))
    return one.select("file_id", "revision", "block_pos", F.col("s.locator").alias("locator"), normalize_extracted(F.col("s.text")).alias("text"))


def presentation_blocks(presentations: DataFrame) -> DataFrame:
    """Blocks of presentations (file_id, revision, slides array<struct<number,text,notes>>)."""
    one = presentations.select("file_id", "revision", F.posexplode("slides").alias("block_pos", "s"))
    return one.select(
        "file_id", "revision", "block_pos", F.concat(F.lit("slide:"), F.col("s.number").cast("string")).alias("locator"), with_notes(F.col("s.text"), F.col("s.notes")).alias("text")
    )


def spreadsheet_blocks(spreadsheets: DataFrame) -> DataFrame:
    """Blocks of spreadsheets (file_id, revision, sheets array<struct<name,rows:array<array<string>>>>)."""
    sheets = spreadsheets.select("file_id", "revision", F.posexplode("sheets").alias("sheet_pos", "s"))
    rows = sheets.select("file_id", "revision", F.col("s.name").alias("sheet"), F.posexplode_outer("s.rows").alias("pos", "cells"))
    filled = rows.select("file_id", "revision", "sheet", (F.coalesce("pos", F.lit(0)) + 1).alias("row_no"), F.coalesce("cells", F.array().cast("array<string>")).alias("cells"))
    return sheet_blocks(filled)


def structure_violations(documents: DataFrame, presentations: DataFrame) -> DataFrame:
    """(file_id, violation): section locators, slide numbers (positive, unique) and item limits."""
    section = F.array(
        F.when(F.size("sections") > MAX_ITEMS, "too_many_sections"),
        F.when(F.exists("sections", lambda s: ~F.coalesce(s["locator"].startswith("section:"), F.lit(False))), "locator_malformed"),
        F.when(F.exists("sections", lambda s: s["text"].isNull()), "text_missing"),
    )
    numbers = F.transform("slides", lambda s: s["number"])
    slide = F.array(
        F.when(F.size("slides") > MAX_ITEMS, "too_many_slides"),
        F.when(F.exists(numbers, lambda n: n.isNull() | (n <= 0)), "slide_number_not_positive"),
        F.when(F.size(F.array_distinct(numbers)) != F.size(numbers), "slide_number_repeated"),
    )
    a = documents.select("file_id", F.explode(F.array_compact(section)).alias("violation"))
    return a.unionByName(presentations.select("file_id", F.explode(F.array_compact(slide)).alias("violation")))

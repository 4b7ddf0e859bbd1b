"""Plain text, Markdown, HTML and JSON payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import newlines, normalize_extracted, strip

#: The heading form, JSON nodes of a file, and what is rendered inline.
HEADING = "(?U)^\\s{0,3}#{1,6}\\s+(.+?)\\s*#*\\s*$"
MAX_NODES, INLINE_ITEMS, INLINE_CHARACTERS = 20_000, 25, 1_000


def text_blocks(files: DataFrame) -> DataFrame:
    """One block text:1 for each payload (file_id, revision, text); a byte order mark is dropped."""
    body = normalize_extracted(F.regexp_replace("text", "^﻿", ""))
    return files.select("file_id", "revision", F.lit(0).alias("block_pos"), F.lit("text:1").alias("locator"), body.alias("text"))


def heading_blocks(files: DataFrame) -> DataFrame:
    """Sections of Markdown payloads (file_id, revision, text): each heading carries on to the next.

    A payload is one row, so its sections are cut within the row: the places of its
    headings are the cuts between slices of its lines. Nothing is exchanged.
    """
    lines = files.select("file_id", "revision", F.split(newlines(F.regexp_replace("text", "^﻿", "")), "\n", -1).alias("lines"))
    heads = F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(HEADING), i + 1)))
    cuts = F.concat(F.array(F.lit(1)), heads, F.array(F.size("lines") + 1))

    def section(at: Column, k: Column) -> Column:
        own = F.slice(F.col("lines"), at, F.get(F.col("cuts"), k + 1) - at)
        title = F.when(k > 0, normalize_extracted(F.regexp_extract(F.get(own, F.lit(0)), HEADING, 1)))
        body = F.transform(own, lambda x, i: F.when((i == 0) & title.isNotNull(), title).otherwise(strip(x)))
        return F.struct(title.alias("title"), F.filter(body, lambda x: x != "").alias("kept"), (k == 0).alias("first"))

    cut = lines.withColumn("cuts", cuts)
    every = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), section)
    sections = cut.select("file_id", "revision", F.posexplode(F.filter(every, lambda s: F.size(s["kept"]) > 0)).alias("block_pos", "s"))
    place = F.when(F.col("s.first"), F.lit("section:Document")).otherwise(F.concat(F.lit("section:"), F.coalesce("s.title", F.lit("Untitled"))))
    return sections.select("file_id", "revision", "block_pos", place.alias("locator"), normalize_extracted(F.array_join("s.kept", "\n")).alias("text"))


_LINES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr"))
_SILENT = frozenset(("script", "style", "noscript", "template"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Lines(HTMLParser):
    """Text of headings, paragraphs, list items and table rows, nested ones under each of them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.everything: list[str] = []
        self.data: list[str] = []

    def _end_of_run(self) -> None:
        run, self.data = "".join(self.data).strip(), []
        if run and not any(t in _SILENT for t, _ in self.open):
            self.everything.append(run)
            for _, i in self.open:
                if i is not None:
                    self.found[i][1].append(run)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_of_run()
        if tag in _VOID:
            return
        silent = any(t in _SILENT for t, _ in self.open)
        if tag in _LINES and not silent:
            self.found.append((tag, []))
        self.open.append((tag, len(self.found) - 1 if tag in _LINES and not silent else None))

    def handle_endtag(self, tag: str) -> None:
        self._end_of_run()
        at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_comment(self, data: str) -> None:
        self._end_of_run()

    def handle_data(self, data: str) -> None:
        self.data.append(data)


def _collapse(text: str) -> str:
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))).strip()


def html_markdown(html: str) -> str:
    """Visible lines of a page as Markdown paragraphs; without any such line, all visible text."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_of_run()
    lines = [("# " if tag[0] == "h" else "") + text for tag, parts in parser.found if (text := _collapse(" ".join(parts)))]
    return "\n\n".join(lines) if lines else _collapse(" ".join(parser.everything))


def html_blocks(files: DataFrame) -> DataFrame:
    """Sections of HTML payloads (file_id, revision, text): parsed in Arrow batches, cut as Markdown."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [html_markdown((t or "").removeprefix("﻿")) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["file_id", "revision", "text"])

    return heading_blocks(files.select("file_id", "revision", "text").mapInArrow(run, "file_id string, revision string, text string"))


_plain_key = re.compile("[A-Za-z_][A-Za-z0-9_]*").fullmatch


def json_pieces(value: object, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, text) of a JSON value: small flat parts inline, others piece by piece, keys sorted."""
    stack = [(path, value)]
    while stack:
        place, node = stack.pop()
        if not isinstance(node, (dict, list)):
            yield place, node if isinstance(node, str) else json.dumps(node, ensure_ascii=False)
            continue
        keys = sorted(node) if isinstance(node, dict) else range(len(node))
        flat = len(node) <= INLINE_ITEMS and not any(isinstance(node[k], (dict, list)) for k in keys)
        text = json.dumps(node, ensure_ascii=False, sort_keys=True) if flat else ""
        if flat and (not node or len(text) <= INLINE_CHARACTERS):
            yield place, text
            continue
        step = (lambda k: f".{k}" if _plain_key(k) else f"[{json.dumps(k, ensure_ascii=False)}]") if isinstance(node, dict) else (lambda k: f"[{k}]")
        stack += [(place + step(k), node[k]) for k in reversed(keys)]


def count_nodes(value: object) -> int:
    stack, n = [value], 0
    while stack:
        node = stack.pop()
        n += 1
        stack += node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
    return n


def json_blocks(files: DataFrame) -> DataFrame:
    """Blocks json:<path> of JSON payloads (file_id, revision, text), with error where a payload fails."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for f, r, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                try:
                    value = json.loads((t or "").removeprefix("﻿"))
                except (ValueError, RecursionError):
                    out.append((f, r, 0, None, None, "EXTRACTION_FAILED"))
                    continue
                if count_nodes(value) > MAX_NODES:
                    out.append((f, r, 0, None, None, "EXTRACTION_LIMIT_EXCEEDED"))
                    continue
                out += [(f, r, i, f"json:{p}", x, None) for i, (p, x) in enumerate(json_pieces(value))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            names = ["file_id", "revision", "block_pos", "locator", "text", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("file_id", "revision", "text").mapInArrow(run, "file_id string, revision string, block_pos int, locator string, text string, error string")

"""Payload files to blocks: one routed pass over the files that changed.

Sizes are checked before contents are read. Every MIME type has one route; formats
whose libraries are not at hand go through a hook and are unsupported without it.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusError
from ..functions.text import normalize_extracted
from . import office
from .native import piece_text, structured_pieces
from .tabular import MAX_CELLS, sheet_lines
from .text import MAX_NODES, count_nodes, html_markdown, json_pieces

#: File sizes and MIME types.
MAX_FILE_BYTES, MAX_PDF_BYTES = 250 << 20, 32 << 20
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
PDF = "application/pdf"
TEXT, MARKDOWN = ("text/plain",), ("text/markdown", "text/x-markdown")
HTML, CSV, JSON = ("text/html", "application/xhtml+xml"), ("text/csv", "application/csv"), ("application/json", "text/json")
IMAGES = ("image/png", "image/jpeg", "image/tiff", "image/bmp", "image/webp", "image/gif")

#: Hooks for formats without a reader here: bytes to (locator, text) pairs.
Hook = Callable[[bytes], Iterator[tuple[str, str]]]


def read_payloads(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """``files`` (file_id, payload_path, …) with the bytes of their payloads and the checks on them.

    Adds content, sha256 and md5; a payload above the size limit keeps no content. The
    paths are below ``folder``, which the binary source lists once, and the size limit
    is a filter on its metadata, so large files are not read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = listed.where(F.col("length") <= MAX_FILE_BYTES).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content", "length")
    met = files.join(small, F.col("payload_path") == F.col("path"), "left")
    return met.withColumn("payload_hash", F.sha2("content", 256)).withColumn("payload_md5", F.md5("content")).drop("path")


def _decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        raise CorpusError("the payload is no UTF-8", "EXTRACTION_FAILED") from error


def _csv(data: bytes) -> Iterator[tuple[str, str]]:
    rows = list(csv.reader(io.StringIO(_decoded(data), newline="")))
    if sum(map(len, rows)) > MAX_CELLS:
        raise CorpusError("too many cells", "EXTRACTION_LIMIT_EXCEEDED")
    yield from sheet_lines(rows, "CSV", True)


def _json(data: bytes) -> Iterator[tuple[str, str]]:
    try:
        value = json.loads(_decoded(data))
    except (ValueError, RecursionError) as error:
        raise CorpusError("the payload is no JSON", "EXTRACTION_FAILED") from error
    if count_nodes(value) > MAX_NODES:
        raise CorpusError("too many JSON nodes", "EXTRACTION_LIMIT_EXCEEDED")
    yield from ((f"json:{p}", t) for p, t in json_pieces(value))


def _xlsx(data: bytes) -> Iterator[tuple[str, str]]:
    for name, rows in office.xlsx_sheets(data):
        yield from sheet_lines(rows, name, False)


def payload_blocks(data: bytes | None, mime_type: str, hooks: dict[str, Hook] | None = None) -> list[tuple[str, str]]:
    """(locator, text) of a payload; Markdown and HTML come as one block of kind md: to be cut into sections."""
    if data is None:
        raise CorpusError("the payload is missing or too large", "EXTRACTION_LIMIT_EXCEEDED")
    if hooks and mime_type in hooks:
        if mime_type == PDF and len(data) > MAX_PDF_BYTES:
            raise CorpusError("the PDF is too large", "EXTRACTION_LIMIT_EXCEEDED")
        return list(hooks[mime_type](data))
    if mime_type in TEXT:
        return [("text:1", _decoded(data))]
    if mime_type in MARKDOWN:
        return [("md:", _decoded(data))]
    if mime_type in HTML:
        return [("md:", html_markdown(_decoded(data)))]
    route = dict.fromkeys(CSV, _csv) | dict.fromkeys(JSON, _json) | {DOCX: office.docx_blocks, XLSX: _xlsx, PPTX: office.pptx_blocks}
    if mime_type not in route:
        raise CorpusError(f"no reader for {mime_type}", "UNSUPPORTED_FORMAT")
    return list(route[mime_type](data))


def read_structured(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """``files`` (file_id, structured_path, …) that have a structured file, with its bytes in ``structured``; none if it is missing or too large."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = listed.where(F.col("length") <= MAX_FILE_BYTES).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("content").alias("structured"))
    some = files.where("structured_path is not null")
    return some.join(small, F.col("structured_path") == F.col("path"), "left").drop("path")


def extract_native(structured: DataFrame) -> DataFrame:
    """found (file_id, revision, block_pos, locator, text, code) of native files (file_id, revision, native_kind, structured)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for f, r, kind, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                try:
                    if data is None:
                        raise CorpusError("the structured file is missing or too large", "EXTRACTION_FAILED")
                    out += [(f, r, i, *piece, None) for i, piece in enumerate(structured_pieces(data, kind))]
                except CorpusError as error:
                    out.append((f, r, None, None, None, None, error.code))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_id", "revision", "block_pos", "locator", "text", "notes", "code"])

    pieces = structured.select("file_id", "revision", "native_kind", "structured").mapInArrow(
        run, "file_id string, revision string, block_pos int, locator string, text string, notes string, code string"
    )
    return pieces.withColumn("text", piece_text(F.col("locator"), F.col("text"), F.col("notes"))).drop("notes")


def extract_found(payloads: DataFrame, hooks: dict[str, Hook] | None = None) -> DataFrame:
    """found (file_id, revision, block_pos, locator, text, code) of payloads (file_id, revision, mime_type, content): blocks, or a code."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for f, r, mime, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                try:
                    found = payload_blocks(data, mime, hooks)
                    out += [(f, r, i, place, text, None) for i, (place, text) in enumerate(found)]
                except CorpusError as error:
                    out.append((f, r, None, None, None, error.code))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_id", "revision", "block_pos", "locator", "text", "code"])

    return payloads.select("file_id", "revision", "mime_type", "content").mapInArrow(run, "file_id string, revision string, block_pos int, locator string, text string, code string")


def split_found(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, failures) of found rows, which should be written: both come from them.

    Blocks: file_id, revision, block_pos, locator, text. Failures: file_id, code. The
    routed pass is one map; Markdown is cut into sections by the relational operator.
    """
    from .text import heading_blocks

    plain = found.where("code is null and locator <> 'md:'").select("file_id", "revision", "block_pos", "locator", "text")
    plain = plain.withColumn("text", F.when(F.col("locator") == "text:1", normalize_extracted(F.col("text"))).otherwise(F.col("text")))
    cut = heading_blocks(found.where("locator = 'md:'").select("file_id", "revision", "text"))
    return plain.unionByName(cut), found.where("code is not null").select("file_id", "code")


def extract(payloads: DataFrame, hooks: dict[str, Hook] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, failures) of payloads; a caller with a folder writes extract_found and splits that."""
    return split_found(extract_found(payloads, hooks))

"""Sheets: rows become text blocks of 25 rows under their header."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column_name, strip

#: Rows of a block, and cells of a file.
GROUP_ROWS, MAX_CELLS = 25, 50_000


def sheet_blocks(rows: DataFrame, include_range: bool = True) -> DataFrame:
    """(file_id, revision, sheet, grp, locator, text, row_start, row_end) of sheet rows.

    ``rows``: file_id, revision, sheet, row_no (from 1; row 1 is the header), cells
    (array<string>). One shuffle by sheet serves the window and the aggregation; a
    sheet holds at most MAX_CELLS cells, so its rows may meet in one task.
    """
    sheet = Window.partitionBy("file_id", "revision", "sheet")
    line = F.regexp_replace(F.array_join("cells", "\t", ""), "(?U)[\\s\\x1c-\\x1f]+$", "")
    marked = rows.select(
        "file_id", "revision", "sheet", "row_no", line.alias("line"),
        F.max(F.size("cells")).over(sheet).alias("width"),
        F.max(F.when(F.col("row_no") == 1, line)).over(sheet).alias("header"),
        F.max("row_no").over(sheet).alias("last"),
    )
    group = F.when(F.col("row_no") == 1, F.lit(0)).otherwise(F.floor((F.col("row_no") - 2) / GROUP_ROWS)).cast("int")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("row_no") > 1, F.struct("row_no", "line")))), lambda x: x["line"]), "\n")
    grouped = marked.groupBy("file_id", "revision", "sheet", group.alias("grp"), "width", "header", "last").agg(body.alias("body"), F.max("row_no").alias("row_end"), F.count_if(F.col("row_no") > 1).alias("n"))
    start = F.when(F.col("grp") == 0, F.lit(1)).otherwise(2 + F.col("grp") * GROUP_ROWS)
    text = strip(F.when(F.col("n") > 0, F.concat("header", F.lit("\n"), "body")).otherwise(F.col("header")))
    place = F.concat(F.lit("sheet:"), "sheet", F.lit("!A"), start.cast("string"), F.lit(":"), column_name(F.col("width")), F.col("row_end").cast("string"))
    if not include_range:
        place = F.when(F.col("last") <= GROUP_ROWS + 1, F.concat(F.lit("sheet:"), "sheet")).otherwise(place)
    return grouped.select("file_id", "revision", "sheet", "grp", place.alias("locator"), text.alias("text"), start.cast("int").alias("row_start"), F.col("row_end").cast("int").alias("row_end"))


def sheet_lines(rows: list[list[str]], name: str, ranged: bool) -> Iterator[tuple[str, str]]:
    """(locator, text) of one sheet inside a payload that is parsed here; tables use sheet_blocks."""
    letters, n = "", max(map(len, rows), default=1) or 1
    while n > 0:
        n, digit = divmod(n - 1, 26)
        letters = chr(65 + digit) + letters
    data = rows[1:]
    starts = range(0, len(data), GROUP_ROWS) or range(1)
    for at in starts:
        part = data[at : at + GROUP_ROWS]
        first, last = (1 if at == 0 else at + 2), max(1, at + 1 + len(part))
        place = f"sheet:{name}!A{first}:{letters}{last}" if ranged or len(starts) > 1 else f"sheet:{name}"
        yield place, "\n".join("\t".join(r).rstrip() for r in [*rows[:1], *part]).strip()


def over_limit(rows: DataFrame) -> DataFrame:
    """(file_id, cells) of files with more cells than a file may have; each row counts one at least."""
    cells = rows.groupBy("file_id").agg(F.sum(F.greatest(F.size("cells"), F.lit(1))).alias("cells"))
    return cells.where(F.col("cells") > MAX_CELLS)


def table_rows(frame: DataFrame, columns: list[str], order: str, file_id: str, sheet: str | None = None) -> DataFrame:
    """Sheet rows of a relational table: a header row, then its rows in order.

    ``sheet`` names a column that deals the rows to several sheets.
    """
    name = F.col(sheet).cast("string") if sheet else F.lit(file_id)
    number = F.row_number().over(Window.partitionBy("sheet").orderBy("__order")) + 1
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    body = frame.select(name.alias("sheet"), F.col(order).alias("__order"), cells.alias("cells")).select("sheet", number.alias("row_no"), "cells")
    header = body.select("sheet").distinct().select("sheet", F.lit(1).alias("row_no"), F.array(*[F.lit(c) for c in columns]).alias("cells"))
    return header.unionByName(body).select(F.lit(file_id).alias("file_id"), F.lit("1").alias("revision"), "sheet", "row_no", "cells")


def csv_rows(files: DataFrame) -> DataFrame:
    """Sheet rows of CSV payloads (file_id, revision, text): ragged rows and quoted newlines survive."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, revisions, texts = (c.to_pylist() for c in part.columns)
            out = [(f, r, "CSV", i, row) for f, r, t in zip(ids, revisions, texts, strict=True) for i, row in enumerate(csv.reader(io.StringIO((t or "").removeprefix("﻿"), newline="")), 1)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_id", "revision", "sheet", "row_no", "cells"])

    return files.select("file_id", "revision", "text").mapInArrow(run, "file_id string, revision string, sheet string, row_no int, cells array<string>")

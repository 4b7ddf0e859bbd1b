"""Office payloads (DOCX, XLSX, PPTX) read with the standard library.

An archive is looked over before anything in it is opened: its directory's size, its
members' number, names, types and sizes are bounded.
"""

from __future__ import annotations

import io
import posixpath
import re
import stat
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from ..errors import CorpusError
from .tabular import MAX_CELLS

#: Bounds of an archive.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES = 10_000, 100 << 20, 250 << 20
MAX_RATIO, RATIO_FROM_BYTES, MAX_DIRECTORY_BYTES = 200, 10 << 20, 32 << 20

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _limit(what: str) -> CorpusError:
    return CorpusError(f"the archive exceeds its limit of {what}", "EXTRACTION_LIMIT_EXCEEDED")


def _broken(what: str) -> CorpusError:
    return CorpusError(f"the archive is not acceptable: {what}", "EXTRACTION_FAILED")


def _directory(data: bytes) -> tuple[int, int]:
    """Entries and bytes of the central directory, by the end records alone."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 22 - 65_535))
    if at < 0 or at + 22 > len(data):
        raise _broken("no end record")
    disk, start_disk, here, entries, size, offset, note = struct.unpack_from("<4H2LH", data, at + 4)
    if at + 22 + note != len(data) or disk or start_disk or here != entries:
        raise _broken("its end record is inconsistent")
    limit = at
    if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        if at < 20 or data[at - 20 : at - 16] != b"PK\x06\x07":
            raise _broken("no ZIP64 locator")
        (place,) = struct.unpack_from("<Q", data, at - 12)
        if place + 56 > at or data[place : place + 4] != b"PK\x06\x06":
            raise _broken("no ZIP64 end record")
        entries, size, offset = struct.unpack_from("<QQQ", data, place + 32)
        limit = place
    if offset + size > limit:
        raise _broken("its directory lies outside of it")
    return entries, size


def open_archive(data: bytes) -> zipfile.ZipFile:
    """The archive, if it passes; typed errors otherwise."""
    entries, size = _directory(data)
    if entries > MAX_MEMBERS:
        raise _limit("members")
    if size > MAX_DIRECTORY_BYTES:
        raise _limit("directory bytes")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError) as error:
        raise _broken("it cannot be read") from error
    members = archive.infolist()
    if len({m.filename for m in members}) != len(members):
        raise _broken("a name occurs twice")
    total = 0
    for m in members:
        steps = m.filename.replace("\\", "/").split("/")
        if m.filename.startswith("/") or ".." in steps or re.match("^[A-Za-z]:", m.filename) or "\0" in m.filename:
            raise _broken("a name leads out of it")
        kind = stat.S_IFMT(m.external_attr >> 16)
        if kind not in (0, stat.S_IFREG, stat.S_IFDIR):
            raise _broken("a member is no plain file")
        if m.flag_bits & 1:
            raise _broken("a member is encrypted")
        total += m.file_size
        if m.file_size > MAX_MEMBER_BYTES or total > MAX_TOTAL_BYTES:
            raise _limit("unpacked bytes")
        if m.file_size >= RATIO_FROM_BYTES and m.file_size > MAX_RATIO * m.compress_size:
            raise _limit("compression")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        body = archive.read(name)
    except KeyError:
        return None
    except (zipfile.BadZipFile, OSError, RuntimeError) as error:
        raise _broken(f"{name} cannot be read") from error
    if b"<!DOCTYPE" in body[:4096] or b"<!ENTITY" in body:
        raise _broken(f"{name} declares entities")
    try:
        return ElementTree.fromstring(body)
    except ElementTree.ParseError as error:
        raise _broken(f"{name} is no XML") from error


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id to (kind, part name)."""
    folder, name = posixpath.split(part)
    root = _xml(archive, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in root if root is not None else ():
        target = r.get("Target", "")
        where = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], where)
    return out


def _collapse(text: str) -> str:
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))).strip()


def _paragraph(p: ElementTree.Element) -> str:
    pieces = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
    return "".join(pieces[e.tag](e) for e in p.iter() if e.tag in pieces)


def docx_blocks(data: bytes) -> Iterator[tuple[str, str]]:
    """Sections by headings; table rows are lines of cells."""
    archive = open_archive(data)
    body = _xml(archive, "word/document.xml")
    styles = _xml(archive, "word/styles.xml")
    names = {s.get(f"{_W}styleId"): (s.find(f"{_W}name").get(f"{_W}val", "") if s.find(f"{_W}name") is not None else "") for s in (styles if styles is not None else ()) if s.tag == f"{_W}style"}
    place, lines = "section:Document", []
    content = body.find(f"{_W}body") if body is not None else None
    for item in content if content is not None else ():
        if item.tag == f"{_W}tbl":
            for row in item.iter(f"{_W}tr"):
                lines.append("\t".join(_collapse("\n".join(_paragraph(p) for p in c.iter(f"{_W}p"))) for c in row.iter(f"{_W}tc")))
        elif item.tag == f"{_W}p":
            style = item.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val", "") if style is not None else ""
            text = _collapse(_paragraph(item))
            if names.get(key, key).lower().startswith("heading"):
                if any(x.strip() for x in lines):
                    yield place, "\n".join(lines).strip()
                place, lines = f"section:{text or 'Untitled'}", [text] if text else []
            elif text:
                lines.append(text)
    if any(x.strip() for x in lines):
        yield place, "\n".join(lines).strip()


def _number(text: str) -> str:
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() and "e" not in text.lower() and "." not in text else str(value)


def _dated(archive: zipfile.ZipFile) -> list[bool]:
    """For each cell format, whether it shows a date."""
    root = _xml(archive, "xl/styles.xml")
    if root is None:
        return []
    own = {n.get("numFmtId"): n.get("formatCode", "") for n in root.iter(f"{_S}numFmt")}
    formats = root.find(f"{_S}cellXfs")
    ids = [x.get("numFmtId", "0") for x in formats] if formats is not None else []
    plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return [i.isdigit() and (14 <= int(i) <= 22 or 45 <= int(i) <= 47) or bool(re.search("[dmyhs]", plain(own.get(i, "")).lower())) and i in own for i in ids]


def xlsx_sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet, rows of rendered cells) of a workbook; cached values, no formulas."""
    archive = open_archive(data)
    book = _xml(archive, "xl/workbook.xml")
    shared = _xml(archive, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in shared] if shared is not None else []
    links, dated, seen = _related(archive, "xl/workbook.xml"), _dated(archive), 0
    for sheet in book.iter(f"{_S}sheet") if book is not None else ():
        root = _xml(archive, links.get(sheet.get(f"{_R}id", ""), ("", ""))[1])
        rows: list[list[str]] = []
        for r in root.iter(f"{_S}row") if root is not None else ():
            at = int(r.get("r", len(rows) + 1))
            if at > MAX_CELLS:
                raise _limit("cells")
            while len(rows) < at - 1:
                rows.append([])
            row: list[str] = []
            for c in r.iter(f"{_S}c"):
                letters = re.match("[A-Z]+", c.get("r", ""))
                column = 0
                for x in letters[0] if letters else "":
                    column = column * 26 + ord(x) - 64
                if column > MAX_CELLS:
                    raise _limit("cells")
                row += [""] * (column - 1 - len(row))
                value = c.find(f"{_S}v")
                text = value.text or "" if value is not None else ""
                kind = c.get("t", "n")
                if kind == "s":
                    text = strings[int(text)] if text else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                elif kind == "n" and text:
                    style = int(c.get("s", "0"))
                    if style < len(dated) and dated[style]:
                        text = (datetime(1899, 12, 30) + timedelta(days=float(text))).isoformat()
                    else:
                        text = _number(text)
                row.append(text)
            rows.append(row)
        width = max(map(len, rows), default=0)
        seen += width * len(rows)
        if seen > MAX_CELLS:
            raise _limit("cells")
        yield sheet.get("name", ""), [row + [""] * (width - len(row)) for row in rows]


def _shape_texts(root: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """(placeholder kind, text) of the shapes of a slide."""
    for shape in root.iter(f"{_P}sp"):
        body = shape.find(f"{_P}txBody")
        if body is not None:
            holder = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            paragraphs = ["".join("\n" if e.tag == f"{_A}br" else e.text or "" for e in p.iter() if e.tag in (f"{_A}t", f"{_A}br")) for p in body.iter(f"{_A}p")]
            yield (holder.get("type", "") if holder is not None else ""), _collapse("\n".join(paragraphs))


def pptx_blocks(data: bytes) -> Iterator[tuple[str, str]]:
    """slide:n with the text of its shapes, then its notes."""
    archive = open_archive(data)
    deck = _xml(archive, "ppt/presentation.xml")
    links = _related(archive, "ppt/presentation.xml")
    for number, entry in enumerate(deck.iter(f"{_P}sldId") if deck is not None else (), 1):
        part = links.get(entry.get(f"{_R}id", ""), ("", ""))[1]
        root = _xml(archive, part)
        text = "\n".join(t for _, t in _shape_texts(root) if t) if root is not None else ""
        notes = ""
        for kind, where in _related(archive, part).values():
            if kind == "notesSlide" and (page := _xml(archive, where)) is not None:
                notes = "\n".join(t for k, t in _shape_texts(page) if t and k == "body")
        text, notes = _collapse(text), _collapse(notes)
        yield f"slide:{number}", f"{text}\nNotes:\n{notes}" if text and notes else text or notes

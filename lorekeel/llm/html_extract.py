"""Main text of web pages, with repeated host boilerplate found by suffix arrays.

A parser cuts a page into blocks. Elements that are no article text by their name, role
or class are marked and go. Of the rest, the article with the most text (or else the
text in ``<main>``) is the page's own if it holds a fair share of the unmarked text; it
is kept as it is, repeated or not. All other unmarked text remains undecided, beside
such a part as on pages without one. The host's own pages
decide it: their token streams, less the kept parts, are concatenated, substrings of at
least ``LEAST`` tokens that are on ``PAGES`` distinct pages or more are boilerplate, the
covered tokens are cut out wherever they lie in a block, and the unique runs stay.

A host's stream is sorted in shards of a bounded number of pages. A shard's suffix
array, sorted to a depth of ``LEAST`` tokens, has all occurrences of a substring of that
length next to each other, with their number of pages; these numbers are added up over
the shards, so the result is that of one array of the whole host and does not depend on
the split. No greater depth is needed: a repeat of any greater length is covered by its
pieces of ``LEAST`` tokens, which are on the same pages, and runs of overlapping pieces
put the long substrings together again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_codec import batches
from .common import Tables

#: Tokens of a repeated substring, and distinct pages it must be on.
LEAST, PAGES = 8, 3
#: Share of a page's unmarked text that an article, or main element, must hold to be the page's own.
OWN_SHARE = 0.25
#: Pages of one suffix array.
SHARD_PAGES = 500
#: At most so many rows of a few numbers are broadcast; beyond, they are joined.
BROADCAST_ROWS = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no article text.
MARKED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe svg canvas object audio video dialog menu".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class and id words of boilerplate, of reader comments, and of what must not count as either.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar cookie cookies consent gdpr notice alert "
    "menu navbar nav navigation breadcrumb breadcrumbs masthead footer share sharing social related recommended newsletter subscribe subscription "
    "signup login popup modal overlay toolbar pagination pager widget teaser copyright disclaimer skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
NEUTRAL = frozenset("content main article body post entry page wrapper container layout with has no without".split())

_space = re.compile(r"\s+")
_host = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in MARKED:
        return True
    given = {k: v or "" for k, v in attrs}
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return True
    if given.get("role", "").lower() in ROLES:
        return True
    whole = tag in ("html", "body", "main", "article")
    for name in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        parts = [p for p in re.split("[-_]+", name) if p]
        if any(p in COMMENTS for p in parts) and not any(p in ("no", "has", "with") for p in parts):
            return True
        if not whole and parts and not NEUTRAL.intersection(parts) and (parts[0] in WORDS or parts[-1] in WORDS):
            return True
    return False


class _Blocks(HTMLParser):
    """blocks: (place, text) in page order; place is article0, article1, ..., main, open or marked."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.place = "open"
        self.articles = 0
        self.blocks: list[tuple[str, str]] = []
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            if text := _space.sub(" ", "".join(self.parts)).strip():
                self.blocks.append((self.place, text))
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for open_ in ("head", "title") if tag == "body" else ():
            if any(t == open_ for t, _ in self.stack):
                self.handle_endtag(open_)  # one that was never closed
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        place = self.place
        inside = any(t in ("article", "main") for t, _ in self.stack)
        if place != "marked":
            if _boilerplate(tag, attrs) or tag == "header" and not inside:
                place = "marked"
            elif not place.startswith("article"):
                if tag == "article":
                    place = f"article{self.articles}"
                    self.articles += 1
                elif tag == "main" or dict(attrs).get("role") == "main":
                    place = "main"
        if place != self.place:
            self.flush()
        self.stack.append((tag, self.place))
        self.place = place

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None or tag in INLINE and any(t not in INLINE for t, _ in self.stack[at + 1 :]):
            return
        place = self.stack[at][1]
        if place != self.place:
            self.flush()
        self.place = place
        del self.stack[at:]

    def handle_data(self, data: str) -> None:
        if self.place != "marked" or not self.stack or self.stack[-1][0] not in ("script", "style"):
            self.parts.append(data)


def page_blocks(html: str) -> list[tuple[str, str]]:
    """(state, text) of a page's blocks: state is kept, open (undecided) or gone; text has single spaces."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    sizes: dict[str, int] = {}
    for place, text in parser.blocks:
        if place != "marked":
            sizes[place] = sizes.get(place, 0) + len(text)
    least = OWN_SHARE * sum(sizes.values())
    first = max((p for p in sizes if p.startswith("article")), key=sizes.__getitem__, default="main")
    own = next((p for p in (first, "main") if p in sizes and sizes[p] >= least), None)

    def state(place: str) -> str:
        if place == own:
            return "kept"
        # unmarked text beside the page's own may belong to it: only the repeats tell
        return "gone" if place == "marked" else "open"

    return [(state(p), t) for p, t in parser.blocks]


def outside_stream(blocks: list[tuple[str, str]]) -> str:
    """The text that is not kept, a line for each stretch between kept blocks."""
    lines: list[list[str]] = [[]]
    for state, text in blocks:
        if state != "kept":
            lines[-1].append(text)
        elif lines[-1]:
            lines.append([])
    return "\n".join(" ".join(x) for x in lines if x)


def repeated_windows(streams: list[np.ndarray], pages: list[int], least: int = LEAST) -> list[tuple[int, int]]:
    """(start, number of distinct pages) of one occurrence of each substring of ``least`` tokens.

    ``streams`` are blocks of token numbers (0 or more), ``pages`` their pages. The
    suffix array of the concatenation is sorted by prefix doubling as far as
    ``least`` tokens; equal ranks then are equal substrings. Starts count in the
    concatenation with one separator behind each block.
    """
    if not streams:
        return []
    text = np.concatenate([np.append(s + 1 + len(streams), i) for i, s in enumerate(streams)])  # separators are all different
    owner = np.repeat(np.array(pages, np.int64), [len(s) + 1 for s in streams])
    room = np.concatenate([np.arange(len(s), -1, -1) for s in streams])  # tokens from here to the block's end
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while width < least:
        step = min(width, least - width)
        behind = np.full(len(rank), -1, np.int64)
        behind[:-step] = rank[step:]
        rank, width = np.unique(rank * (len(rank) + 1) + behind + 1, return_inverse=True)[1].astype(np.int64), width + step
    whole = np.flatnonzero(room >= least)
    order = whole[np.lexsort((owner[whole], rank[whole]))]  # the suffix array, to that depth
    if not len(order):
        return []
    first = np.append(True, rank[order][1:] != rank[order][:-1])
    fresh = first | np.append(True, owner[order][1:] != owner[order][:-1])
    starts = np.flatnonzero(first)
    return list(zip(order[starts].tolist(), np.add.reduceat(fresh.astype(np.int64), starts).tolist(), strict=True))


def window_hashes(tokens: list[str], least: int = LEAST) -> np.ndarray:
    """A 64-bit hash of every substring of ``least`` tokens, in order."""
    import xxhash

    room = len(tokens) - least + 1
    if room <= 0:
        return np.zeros(0, np.int64)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        z = np.zeros(room, np.uint64)
        for i in range(least):
            z = (z + hashed[i : i + room]) * np.uint64(0x9E3779B97F4A7C15)
            z ^= z >> np.uint64(29)
    return z.view(np.int64)


def _host_of(url: str | None) -> str:
    m = _host.match(url or "")
    return m[1].lower() if m else ""


PARSED = "host string, html_md5 binary, text string, stream string, open boolean, states array<boolean>, blocks array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url and, parsed once: the host, the text of pages without open blocks, the stream outside kept text, and the blocks of open pages.

    ``states`` tells of each such block: true kept, null open, false gone.
    """
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *T._parse_datatype_string(PARSED).fields])
    code = {"kept": True, "open": None, "gone": False}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, htmls in batches(part, "html", 64):
                out = []
                for url, html in zip(rows.column(rows.schema.get_field_index("url")).to_pylist(), htmls, strict=True):
                    blocks = page_blocks(html)
                    open_ = any(s == "open" for s, _ in blocks)
                    text = None if open_ else " ".join(t for s, t in blocks if s == "kept")
                    md5 = hashlib.md5(html.encode("utf-8", "surrogatepass")).digest()
                    states, texts = ([code[s] for s, _ in blocks], [t for _, t in blocks]) if open_ else (None, None)
                    out.append((_host_of(None if url is None else str(url)), md5, text, outside_stream(blocks), open_, states, texts))
                kinds = [pa.string(), pa.binary(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.bool_()), pa.list_(pa.string())]
                made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in ("page_id", "url")), *made], schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def _bounded(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def boilerplate_windows(streams: DataFrame, tables: Tables, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """host, window: hashes of the substrings of LEAST tokens that are on PAGES distinct pages of a host.

    ``streams`` has (host, html_md5, stream), a row for each distinct page of a host.
    Only hosts of more than ``shard_pages`` pages are cut into shards; there are few of
    them for the number of pages, so pages need no exchange to learn their shard.
    """
    sizes = streams.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > shard_pages)
    large = tables.put(sizes.select(F.col("host").alias("of"), F.ceil(F.col("n") / shard_pages).alias("shards")))
    shard = F.pmod(F.xxhash64("html_md5"), F.coalesce("shards", F.lit(1)))
    placed = streams.join(_bounded(large), F.col("host") == F.col("of"), "left").select("host", shard.alias("shard"), "stream")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, int] = {}
        hashes, streams, pages = [], [], []
        for number, stream in enumerate(group["stream"]):
            for line in stream.split("\n"):
                words = line.split(" ")
                # one hash for each start, so that starts count as in the concatenation
                hashes.append(np.append(window_hashes(words), np.zeros(min(len(words) + 1, LEAST), np.int64)))
                streams.append(np.array([names.setdefault(w, len(names)) for w in words], np.int64))
                pages.append(number)
        every = np.concatenate(hashes)
        found = repeated_windows(streams, pages)
        return pd.DataFrame({"host": group["host"].iloc[0], "window": every[[at for at, _ in found]], "pages": np.array([n for _, n in found], np.int64)})

    each = placed.groupBy("host", "shard").applyInPandas(one, "host string, window long, pages long")
    return each.groupBy("host", "window").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES).select("host", "window")


def covered_starts(open_pages: DataFrame, windows: DataFrame) -> DataFrame:
    """mark, starts: where in their streams the pages (mark, host, stream) have repeated substrings."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for mark, host, stream in zip(*(c.to_pylist() for c in part.columns), strict=True):
                at = 0
                for line in stream.split("\n"):
                    words = line.split(" ")
                    hashes = window_hashes(words)
                    n = len(hashes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([mark] * n, pa.int64()), pa.array([host] * n, pa.string()), pa.array(np.arange(at, at + n), pa.int32()), pa.array(hashes)], ["mark", "host", "at", "window"]
                    )
                    at += len(words)

    each = open_pages.select("mark", "host", "stream").mapInArrow(split, "mark long, host string, at int, window long")
    return each.join(windows, ["host", "window"], "left_semi").groupBy("mark").agg(F.collect_list("at").alias("starts"))


def _cut_out(words: list[str], covered: np.ndarray) -> list[str]:
    """A block's words without its covered runs; a run must be of LEAST words here or the whole block.

    A repeat that ends beyond a block's border often agrees with the next block's
    first word or two by chance: so few stay.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= min(LEAST, len(words)):
            out += words[at:a]
            at = b
    return out + words[at:]


def kept_text(states: list[bool | None], blocks: list[str], starts: list[int]) -> str:
    """Kept blocks whole, and of open ones the words that no repeated substring covers."""
    sizes = [0 if s else b.count(" ") + 1 for s, b in zip(states, blocks, strict=True)]
    step = np.zeros(sum(sizes) + LEAST + 1, np.int64)
    np.add.at(step, np.array(starts, np.int64), 1)
    np.add.at(step, np.array(starts, np.int64) + LEAST, -1)
    covered, at, out = np.cumsum(step) > 0, 0, []
    for state, block, size in zip(states, blocks, sizes, strict=True):
        if state:
            out.append(block)
        elif state is None:
            out += _cut_out(block.split(" "), covered[at : at + size])
        at += size
    return " ".join(out)


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Character references are decoded, white space within a block becomes one space,
    blocks follow each other in page order with one space between; text is empty
    where a page has none. A null html is empty, a null url is the empty host;
    repeated rows give repeated results, and pages of a host with the same html count
    as one; other columns are not read. An empty table gives an empty result. Nothing
    is capped.
    """
    tables = Tables(pages.sparkSession, "pages")
    frame = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = tables.put(parsed(frame).select(F.monotonically_increasing_id().alias("mark"), "*"))
    streams = rows.where("stream != ''").select("host", "html_md5", "stream").dropDuplicates(["host", "html_md5"])
    windows = tables.put(boilerplate_windows(tables.put(streams), tables))
    undecided = rows.where("open")
    starts = tables.put(covered_starts(undecided, _bounded(windows)))
    met = undecided.select("mark", "page_id", "url", "states", "blocks").join(_bounded(starts), "mark", "left")
    schema = T.StructType([frame.schema["page_id"], frame.schema["url"], T.StructField("text", T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            states, blocks, starts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("states", "blocks", "starts"))
            texts = [kept_text(s, b, a or []) for s, b, a in zip(states, blocks, starts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("page_id", "url")), pa.array(texts, pa.string())], schema.names)

    decided = met.mapInArrow(run, schema)
    out = rows.where("not open").select("page_id", "url", "text").unionByName(decided)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""HTML extraction with host suffix arrays.

A page's visible text is cut into blocks.  Menus, footers, forms and other elements
whose kind or whole name says so are furniture.  Where a page marks its article, the
article's blocks are its main text, elsewhere all blocks are.  What the marks leave
open is told from text by repetition: the token streams of a host's pages are
concatenated, a suffix array over them finds runs of ``GRAM`` or more tokens that
stand on several distinct pages, covered tokens are removed and unique runs are
kept.  A stream holds the blocks outside of articles and the boxed blocks inside of
them (see ``html_blocks``); a boxed block shorter than a gram is a run of its own.

The paragraphs of a marked article are never removed for being repeated: articles
may be copies of each other and quote each other, and nothing else may be dropped.
For the same reason pages with the same article text count as one page, with the
least of their streams; pages without an article count by their streams.

A host may be large, so suffix arrays are built over bounded chunks of its distinct
streams; equal streams are made one over the whole table first.
Each chunk reports every distinct ``GRAM``-token prefix class of its array with
the number of pages that hold it, and the counts of a host's chunks are added with
partial aggregation: the result is that of one array over the whole host.

Defined results: null html counts as empty; a page without text gives the empty
string; a null or odd URL belongs to the host ''; repeated rows are each
extracted, and count once for repetition; an empty table gives no rows; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import scratch
from larkspur.llm.html_blocks import blocks

#: Tokens of the shortest removable run; a power of two, as ranks double.
GRAM = 8
#: A run is removed if it stands on at least this many distinct pages of the host;
#: above two, so that a text and its one copy do not remove each other.
MIN_PAGES = 3
#: Shares that the pages of one run are dealt into.
SHARES = 16
#: Marks the gram of a whole short block; no token holds it.
_BOX = "\x00box"
#: Tokens of one suffix array.
CHUNK_TOKENS = 1 << 18


def suffix_ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling up to ``depth`` tokens.

    Returns the suffix order and the rank of each suffix; suffixes that share
    their first ``depth`` tokens share a rank.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, width = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while width < depth and n:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:]
        order = np.lexsort((second, rank))
        new = np.empty(n, np.int64)
        a, b = rank[order], second[order]
        new[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank, width = new, width * 2
    return order, rank


def repeated(streams: list[list[str]], gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(page, place, pages that hold it) of one instance of each gram in the streams."""
    lengths = [len(s) for s in streams]
    if not sum(max(0, n - gram + 1) for n in lengths):
        return []
    known: dict[str, int] = {}
    parts: list[int] = []
    for k, stream in enumerate(streams):
        parts += [known.setdefault(t, len(known)) for t in stream]
        parts.append(-1 - k)  # a separator that no other page has
    order, rank = suffix_ranks(np.asarray(parts, np.int64), gram)
    ends = np.cumsum([n + 1 for n in lengths])
    page = np.searchsorted(ends, order, side="right")
    start = order - np.concatenate(([0], ends))[page]
    whole = start + gram <= np.asarray(lengths)[page]
    order, page, start = order[whole], page[whole], start[whole]
    classes = rank[order]
    pair = np.unique(np.stack((classes, page)), axis=1)
    _, first, count = np.unique(pair[0], return_index=True, return_counts=True)
    lead = np.unique(classes, return_index=True)[1]
    return [(int(page[i]), int(start[i]), int(n)) for i, n in zip(lead, count)]


def gram_key(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(tokens).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())


@dataclass
class Parsed:
    """One page: its parts in order, and the stream that repetition is judged by."""

    #: (text, 0, 0) as it is, or ("", start, end) of the stream.
    parts: list[tuple[str, int, int]]
    tokens: list[str]
    #: (gram, start, end) of the short boxed blocks of the stream.
    boxes: list[tuple[int, int, int]]
    #: Names the page's article, or its stream where it has none.
    article: int

    def spots(self) -> list[tuple[int, int, int]]:
        """(gram, start, end) of everything that repetition may remove."""
        return [(gram_key(self.tokens[i : i + GRAM]), i, i + GRAM) for i in range(len(self.tokens) - GRAM + 1)] + self.boxes


def parse(page: str) -> Parsed:
    found = blocks(page)
    marked = any(b.main for b in found)
    parts: list[tuple[str, int, int]] = []
    tokens: list[str] = []
    boxes: list[tuple[int, int, int]] = []
    body: list[str] = []
    for b in found:
        kept = not b.furniture and b.main == marked
        if kept and marked:
            body.append(b.text)
        if kept and marked and not b.boxed:
            parts.append((b.text, 0, 0))
            continue
        words, at = b.text.split(" "), len(tokens)
        tokens += words
        if b.boxed and len(words) < GRAM:
            boxes.append((gram_key([_BOX, *words]), at, len(tokens)))
        if kept:
            parts.append(("", at, len(tokens)))
    return Parsed(parts, tokens, boxes, gram_key(body or tokens))


_SPOT = pa.struct([("gram", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page, read once: its text if that is settled, else what decides it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for page_id, url, page in _pages(iter([part])):
                p = parse(page or "")
                open_parts = any(end for *_, end in p.parts)
                stream = " ".join(p.tokens) if len(p.tokens) >= GRAM or p.boxes else None
                text = None if open_parts else " ".join(t for t, *_ in p.parts)
                key = gram_key([repr(page_id), url or "", page or ""]) if open_parts else 0
                rows.append((page_id, url, text, host_of(url), p.article, stream, [g for g, *_ in p.boxes], key, p.tokens if open_parts else [], p.parts if open_parts else [], p.spots() if open_parts else []))
            kinds = [part.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.string()), pa.list_(_PART), pa.list_(_SPOT)]
            yield pa.RecordBatch.from_arrays([pa.array([_packed(x, k) for x in column], k) for column, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], _NAMES)


_PART = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_NAMES = ["page_id", "url", "text", "host", "article", "stream", "boxes", "key", "tokens", "parts", "spots"]
_SCHEMA = "page_id {kind}, url string, text string, host string, article long, stream string, boxes array<long>, key long, tokens array<string>, parts array<struct<text:string,start:int,end:int>>, spots array<struct<gram:long,start:int,end:int>>"


def _packed(value, kind: pa.DataType):
    """Tuples of a list of structs as dicts."""
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        names = [f.name for f in kind.value_type]
        return [dict(zip(names, x)) for x in value]
    return value


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list[str]]]]:
    """(host, streams) in chunks of bounded size."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stream = text.split(" ")
            held.setdefault(host, []).append(stream)
            size += len(stream)
            if size >= CHUNK_TOKENS:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for host, streams in _chunks(batches):
        rows = repeated(streams)
        if rows:
            texts = [gram_key(streams[p][s : s + GRAM]) for p, s, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(rows)), pa.array(texts, pa.int64()), pa.array([n for *_, n in rows], pa.int64())], ["host", "gram", "pages"])


def _texts(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = (schema.field(0).type, schema.field(1).type, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "url", "text"])


def uncovered(parts: list[dict], tokens: list[str], removed: list[dict]) -> str:
    """Settled parts, and of the others the tokens that no removed run covers."""
    change = np.zeros(len(tokens) + 1, np.int32)
    for r in removed:
        change[r["start"]] += 1
        change[r["end"]] -= 1
    covered = np.cumsum(change) > 0
    texts = [p["text"] or " ".join(tokens[i] for i in range(p["start"], p["end"]) if not covered[i]) for p in parts]
    return " ".join(t for t in texts if t)


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "parts", "tokens", "removed")]
        rows = [(page_id, url, uncovered(parts, tokens, removed or [])) for page_id, url, parts, tokens, removed in zip(*columns)]
        yield _texts(rows, pa.schema([batch.schema.field("page_id"), batch.schema.field("url")]))


def removable(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and gram of the runs that stand on enough distinct pages of the host."""
    streams = parsed.filter("stream is not null").groupBy("host", "article").agg(F.min(F.struct("stream", "boxes")).alias("least")).select("host", "least.*")
    grams = streams.select("host", "stream").mapInArrow(_grams, "host string, gram long, pages long")
    short = streams.select("host", F.explode(F.array_distinct("boxes")).alias("gram"), F.lit(1).cast("long").alias("pages"))
    return grams.unionByName(short).groupBy("host", "gram").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= min_pages).select("host", "gram")


def extract(pages: DataFrame, *, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url and main text of every page; each page is parsed once."""
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    parsed = scratch.cut(rows.mapInArrow(_parsed, _SCHEMA.format(kind=kind)))
    open_pages = parsed.filter("text is null")
    # A run may stand on very many pages of a host, so both sides are dealt in shares.
    known = removable(parsed, min_pages).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    asked = open_pages.dropDuplicates(["key"]).select("host", "key", F.inline("spots")).withColumn("share", F.pmod("key", F.lit(SHARES)).cast("int"))
    found = asked.join(known, ["host", "gram", "share"]).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("removed"))
    rest = open_pages.select("page_id", "url", "key", "parts", "tokens").join(found, "key", "left").mapInArrow(_uncovered, f"page_id {kind}, url string, text string")
    return parsed.filter("text is not null").select("page_id", "url", "text").unionByName(rest)

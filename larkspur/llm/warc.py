"""WARC archives: one gzip member a record, written and read sequentially.

Writing marks each page as ``response`` or ``revisit``.  Of pages with equal
payloads of at least ``min_revisit_bytes``, the one with the largest id is the
response and the others revisit it.  A revisit keeps the HTTP header of its
response, payload length included, and its payload digest, but no payload.

Reading feeds file chunks through an incremental zlib decompressor, a member at a
time, frames records by Content-Length and checks block and payload digests.

Defined results: null html counts as an empty payload; a null page id compares
below every other; rows that repeat the largest id with the same payload are each
responses; control characters in a URL are percent-encoded in the header; an
empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import scratch
from larkspur.llm.words import binary_texts

CHUNK = 64 << 10
#: Fixed so that a task that is run again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    value = record_id[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def _header_safe(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int = 6) -> bytes:
    """One record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_safe(url)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """Content of each gzip member in turn; holds one member and one chunk."""
    data = source.read(chunk)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data:
                raise ValueError("the archive ends inside a member")
            parts.append(unpack.decompress(data))
            data = unpack.unused_data if unpack.eof else source.read(chunk)
        yield b"".join(parts)
        data = data or source.read(chunk)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, lower-case names, and the block framed by Content-Length."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("content-length does not frame the record")
    block = rest[:size]
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    return fields, block


def read_records(source, chunk: int = CHUNK) -> Iterator[dict]:
    """Records of an archive with verified digests."""
    for member in members(source, chunk):
        fields, block = parse(member)
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
            raise ValueError("payload digest differs")
        yield {
            "page_id": _page_id(fields["warc-record-id"]),
            "url": fields["warc-target-uri"],
            "record_type": fields["warc-type"],
            "payload_bytes": size,
            "payload_digest": digest,
            "refers_to": _page_id(fields["warc-refers-to"]) if revisit else None,
            "payload": None if revisit else payload,
        }


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def classify(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, first: the id of the response of each payload.

    Payload groups are reduced to their largest id before the join, and the join
    on the digest is one that adaptive execution can split when a payload is hot.
    """
    rows = pages.select("page_id", "url", "html").withColumns({"digest": F.sha1(_payload()), "size": F.octet_length(_payload())})
    largest = rows.groupBy(F.col("digest").alias("d"), F.col("size").alias("n")).agg(F.max("page_id").alias("largest"))
    joined = rows.join(largest, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("n")), "left")
    own = (F.col("size") < min_revisit_bytes) | F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", F.when(own, F.col("page_id")).otherwise(F.col("largest")).alias("refers_to"), (~own).alias("revisit"))


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    uri, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
    with scratch.open_output(uri) as out:
        while first is not None:
            columns = (first.column(0).to_pylist(), first.column(1).to_pylist(), binary_texts(first.column(2)), first.column(3).to_pylist(), first.column(4).to_pylist())
            for page_id, url, html, refers_to, revisit in zip(*columns):
                out.write(record(page_id, url, html or b"", refers_to, revisit))
                n += 1
            first = next(batches, None)
    yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([n], pa.int64())})


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> list[str]:
    """One archive a task; returns their URIs, one short row each."""

    def task(batches):
        return _write(batches, folder)

    return sorted(r.uri for r in classify(pages, min_revisit_bytes).mapInArrow(task, "uri string, records long").collect())


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows, size = [], 0
            with scratch.open_input(uri) as source:
                for row in read_records(source):
                    rows.append(row)
                    size += len(row["payload"] or b"") if payload else 0
                    if len(rows) >= 10_000 or size >= 16 << 20:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)


def read(spark: SparkSession, archives: list[str], *, payload: bool = True) -> DataFrame:
    """Records of the archives; each archive is read by one task, front to back."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    if not archives:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(a,) for a in archives], "uri string").repartition(len(archives))

    def task(batches):
        return _read(batches, payload)

    return table.mapInArrow(task, schema)

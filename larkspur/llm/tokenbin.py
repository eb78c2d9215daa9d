"""Token-ID files: independent zstandard frames with a trailing seek table.

Layout of one shard::

    frame*        zstandard frames; each holds the ids (little-endian unsigned
                  32-bit) of one document, or a part of a very long one
    index         skippable frame 0x184D2A5D: for each document its id (int64,
                  the least value for null), first frame (uint32) and id count
                  (uint64)
    seek table    skippable frame 0x184D2A5E in the public seekable layout: for
                  each frame compressed size, decompressed size and the low 32
                  bits of XXH64 of its content, then frame count, descriptor
                  0x80 and magic 0x8F92EAB1

Readers load the two tables from the end of the file and decompress only the
frames of the documents asked for; each frame is checked against its checksum.

Defined results: null text counts as empty, and an empty document has its end id
alone; equal document ids stand in the order of a hash of their texts; a null
document id sorts first; an empty table writes no shard.  A document of more than
``FRAME_BYTES`` of ids has several frames, so no size overflows the seek table.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import scratch
from larkspur.llm.words import binary_texts

END_ID = 2
#: Most bytes of ids in one frame.
FRAME_BYTES = 1 << 28
LEVEL = 1
#: A task goes on to its next shard once one holds this many ids.
SHARD_IDS = 256 << 20
#: Fixed values of the public seekable format.
SEEK_MAGIC, SKIP_SEEK, SKIP_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D
NULL_ID = -(1 << 63)
#: Bytes of parts of texts and their ids remembered by one Python worker, with what
#: a dictionary entry takes beside them.
MEMO_BYTES = 128 << 20
ENTRY_BYTES = 230
#: Documents encoded together, and characters after which a group takes no more.
GROUP = 64
GROUP_CHARS = 1 << 20
_ENTRY = struct.Struct("<qIQ")


#: Signs whose normal form is their lower case, and the tokenizer's split on them.
_PLAIN = re.compile(r"[\t\n\r\x0b\x0c\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: Only for tokenizers of these fixed rules.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")

#: A part that stands between others where many are encoded as one text.
_BETWEEN = "0"


class ChunkEncoder:
    """Encodes through the tokenizers library, remembering parts of texts.

    The tokenizer lower-cases, drops white space and splits texts into letter runs,
    single digits and runs of other signs before it encodes, so the ids of a text
    are those of its parts in order.  Texts of plain signs and precomposed Western
    letters, which normalisation only lower-cases, are split that finely; others at
    blanks; texts that may hold a special token's string are encoded whole, and so
    is every text where the tokenizer's rules are others.
    """

    def __init__(self, path: str):
        # Each task has one core; the library's own threads would only wait.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(self.tokenizer.to_str())
        normalizer, splits = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
        model = rules["model"]
        self.splits = normalizer.get("normalizers") == _NORMALIZER and splits.get("pretokenizers", [None])[0] == _SPLIT and len(splits["pretokenizers"]) == 2 and splits["pretokenizers"][1]["type"] == "ByteLevel" and not splits["pretokenizers"][1]["add_prefix_space"] and model["type"] == "BPE" and not model.get("dropout")
        # Parts of plain texts are normal and one piece each, so they go to the same model without
        # the normaliser's and the splitter's patterns, many in one text with a part between that
        # is one id, which no other part has.
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids if self.splits else []
        self.splits = len(self.between) == 1 and rules["truncation"] is None
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _plain_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of plain texts, none of them ``_BETWEEN``."""
        text = f" {_BETWEEN} ".join(parts)
        ids = np.asarray(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at, body = (np.flatnonzero(ids == self.between[0]) * 4).tolist(), ids.tobytes()
        if len(at) != len(parts) - 1:
            raise ValueError("the tokenizer splits parts of plain texts")
        return [body[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(body)])]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if len(group) == GROUP or size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        """One call of the library for the parts of a group that are new."""
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        split, new, plain = [], set(), set()
        for text in texts:
            if not self.splits or any(s in text for s in self.special):
                parts = None
            elif _PLAIN.fullmatch(text):
                parts = _PARTS.findall(text.lower())
                plain.update(parts)
            else:
                parts = text.replace("\n", " ").split(" ")
                new.update(parts)
            split.append(parts)
        if _BETWEEN in plain:
            plain.remove(_BETWEEN)
            new.add(_BETWEEN)
        for wanted, ids_of in ((list(plain.difference(memo)), self._plain_ids), (list(new.difference(memo)), self._ids)):
            if not wanted:
                continue
            found = ids_of(wanted)
            memo.update(zip(wanted, found))
            self.held += sum(map(len, wanted)) + sum(map(len, found)) + ENTRY_BYTES * len(wanted)
        for text, parts in zip(texts, split):
            yield self._ids([text])[0] if parts is None else b"".join(map(memo.__getitem__, parts))


class ShardWriter:
    """Writes one shard; documents are appended in order."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[bytes] = []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append(_ENTRY.pack(NULL_ID if doc_id is None else doc_id, len(self.frames), len(ids) // 4))
        for at in range(0, len(ids), self.frame_bytes):
            body = ids[at : at + self.frame_bytes]
            packed = self.codec.compress(body)
            self.out.write(packed)
            self.frames.append((len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.ids += len(ids) // 4

    def close(self) -> None:
        index = b"".join(self.index)
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(table)) + table)


@dataclass
class Entry:
    doc_id: int | None
    frame: int
    n: int


class ShardReader:
    """Reads the tables of a shard and single frames on demand."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        seek_start = end - (n * 12 + 17)
        source.seek(seek_start)
        head = struct.unpack("<II", source.read(8))
        if head != (SKIP_SEEK, n * 12 + 9):
            raise ValueError("damaged seek table")
        self.frames = list(struct.iter_unpack("<III", source.read(n * 12)))
        self.offsets = np.concatenate(([0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)))
        source.seek(int(self.offsets[-1]))
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIP_INDEX or int(self.offsets[-1]) + 8 + size != seek_start:
            raise ValueError("damaged document index")
        self.entries: list[Entry] = []
        for doc_id, k, n_ids in _ENTRY.iter_unpack(source.read(size)):
            self.entries.append(Entry(None if doc_id == NULL_ID else doc_id, k, n_ids))
        self.codec = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.offsets[k]))
        packed, size, check = self.frames[k]
        body = self.codec.decompress(self.source.read(packed), max_output_size=size)
        if len(body) != size or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return body

    def documents(self, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """Ids of the wanted documents, or of all, decompressing no other frame."""
        wanted = None if wanted is None else set(wanted)
        for e in self.entries:
            if wanted is None or e.doc_id in wanted:
                parts, held, frame = [], 0, e.frame
                while held < e.n * 4:
                    parts.append(self.frame(frame))
                    held, frame = held + len(parts[-1]), frame + 1
                yield e.doc_id, np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), "<u4")


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    number, encoder, end = TaskContext.get().partitionId(), _encoder(tokenizer), struct.pack("<I", end_id)

    def documents() -> Iterator[tuple[int | None, bytes]]:
        for batch in batches:
            texts = (x.decode("utf-8", "replace") if x else "" for x in binary_texts(batch.column(1)))
            doc_ids = iter(batch.column(0).to_pylist())
            for ids in encoder.encode(texts):
                yield next(doc_ids), ids + end

    ready, part = documents(), 0
    document = next(ready, None)
    while document is not None:
        uri = f"{folder}/shard-{number:06d}-{part:06d}.zst"
        with scratch.open_output(uri) as out:
            writer = ShardWriter(out)
            while document is not None and writer.ids < SHARD_IDS:
                writer.add(*document)
                document = next(ready, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()), "uri": [uri], "n_docs": pa.array([len(writer.index)], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})
        part += 1


def write(docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, partitions: int | None = None) -> list[tuple[str, int, int]]:
    """Write shards in ascending document order; returns (uri, documents, ids) of each.

    Documents are range-partitioned by id, and by a hash of the text within an id,
    so each task holds one document and one shard's tables.  What comes back to the
    driver is one row a shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def task(batches):
        return _write_shard(batches, folder, tokenizer, end_id)

    made = ordered.mapInArrow(task, "shard int, part int, uri string, n_docs long, n_ids long").collect()
    return [(r.uri, r.n_docs, r.n_ids) for r in sorted(made, key=lambda r: (r.shard, r.part))]


def _read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            with scratch.open_input(uri) as source:
                for doc_id, ids in ShardReader(source).documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(rows) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    starts = np.concatenate(([0], np.cumsum([s[2] for s in shards], dtype=np.int64)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([(s[0], int(at)) for s, at in zip(shards, starts)], "uri string, start long")
    return table.repartition(len(shards)).mapInArrow(_read_shard, schema)

"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ``window`` consecutive benchmark words is one pattern; an item
with fewer words, but not none, is a single pattern.  Documents are scanned once
over normalised text, and hits are mapped back to code-point offsets of the
original text.

Defined results: a null or empty text has no words and is clean; a benchmark row
with null text or no words adds no window; one with a null id marks words but names
no item; rows that repeat an item add nothing new; rows that repeat a document are each reported; an empty
benchmark leaves every document clean; other columns are passed through, and an
input column named like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import phrases, scratch
from larkspur.llm.words import WORD, binary_texts, padded, words_of

WINDOW = 10

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def windows(text: bytes | None, size: int = WINDOW) -> Iterator[str]:
    """Padded texts of an item's windows."""
    words = words_of(text)
    for k in range(max(1, len(words) - size + 1) if words else 0):
        yield padded(words[k : k + size])


def window_rows(benchmark: DataFrame, item_id: str, item_text: str, size: int) -> DataFrame:
    """Distinct window and item of a benchmark."""

    def task(batches):
        for batch in batches:
            items, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
                for w in windows(text, size):
                    items.append(item), found.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], ["item", "window"])

    return benchmark.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).mapInArrow(task, "item string, window string").distinct()


def pattern_shards(rows: DataFrame, max_bytes: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Patterns in shards of about ``max_bytes``, dealt by a hash of the window; the
    driver holds one shard at a time."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).first()[0]
    n = max(1, -(-total // max_bytes))
    for k in range(n):
        found: dict[str, list[str]] = {}
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        for r in part.orderBy("window", "item").toLocalIterator():
            of = found.setdefault(r.window, [])
            if r.item is not None:
                of.append(r.item)
        yield list(found.items())


def scan_text(text: bytes | None, matcher) -> tuple[int, int, list[str], list[dict]]:
    """(words, hit words, sorted items, original spans) of one text."""
    words = words_of(text)
    hits = phrases.places(matcher, padded(words))
    if not hits:
        return len(words), 0, [], []
    change = np.zeros(len(words) + 1, np.int64)
    for first, n, _ in hits:
        change[first] += 1
        change[first + n] -= 1
    hit = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(hit))
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
    return len(words), int(hit.sum()), sorted({i for *_, ids in hits for i in ids}), spans


def _scan(batches: Iterator[pa.RecordBatch], text: str, out: str, patterns, spans_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    key, found = patterns.value
    matcher = phrases.automaton(key, found)
    for batch in batches:
        rows = [scan_text(x, matcher) for x in binary_texts(batch.column(batch.schema.get_field_index(text)))]
        report = pa.array([dict(zip(("n_words", "n_hit", "items", "spans"), r)) for r in rows], spans_type)
        keep = [i for i, name in enumerate(batch.schema.names) if name != out]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), report], [*(batch.schema.names[i] for i in keep), out])


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "contamination", max_bytes: int = phrases.MAX_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items, spans.

    Windows are made in Spark.  While they stay below ``max_bytes`` they form one
    broadcast automaton; a larger benchmark is split into shards, each scanned in a
    pass of its own, and the reports are merged.
    """
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    parts = pattern_shards(scratch.cut(window_rows(benchmark, item_id, item_text, window)), max_bytes)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    result = docs
    for k, part in enumerate(parts):
        name = out if k == 0 else f"{out}__{k}"
        patterns = spark.sparkContext.broadcast((phrases.key_of(part), part))
        schema = T.StructType([f for f in result.schema.fields if f.name != name] + [T.StructField(name, REPORT)])

        def pass_over(batches, name=name, patterns=patterns):
            return _scan(batches, text, name, patterns, kind)

        result = result.mapInArrow(pass_over, schema)
        if k:
            result = scratch.cut(_merged(result, text, out, name))
    return result


def _merged(df: DataFrame, text: str, left: str, right: str) -> DataFrame:
    """Union of two reports of the same rows; overlapping spans are joined."""
    spans = F.array_sort(F.concat(f"{left}.spans", f"{right}.spans"))
    joined = F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    inside = F.transform(joined, lambda s: F.size(F.regexp_extract_all(F.substring(F.col(text), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"))))
    n_hit = F.aggregate(inside, F.lit(0).cast("long"), lambda a, n: a + n)
    return df.withColumn(left, F.struct(F.col(f"{left}.n_words").alias("n_words"), n_hit.alias("n_hit"), F.array_sort(F.array_union(f"{left}.items", f"{right}.items")).alias("items"), joined.alias("spans"))).drop(right)

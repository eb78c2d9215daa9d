"""Substring dedup: passages that repeat across documents, by seed and extend.

1. Every text is winnowed: of the hashes of ``ANCHOR`` words that begin in a window of
   ``min_words`` words the least is an anchor, so equal windows have the same anchor at
   the same place.  Anchors meet in Spark; those that several documents hold are seeds.
2. A seed is extended both ways, over all windows that chose it.  Equal extensions (the
   copies of a passage) are one row with their smallest document; only the different
   extensions of a seed are taken apart into windows, which meet on (anchor, window).
3. A window is a repeat where a document with a smaller id has it.  Overlapping and
   touching windows of a document are joined into maximal repeats.

Filters of fixed size keep most anchors of one document out of step 2, seeds with one
extension out of the comparison of windows, and texts that keep all their words out of
the last join; what passes a filter by chance is settled by the exact steps.  Two windows are equal if 128 bits of hashes
(their anchor's and their own) are.  No step pairs the documents of a seed, so rows stay
linear in the words, and a seed that very many documents share is aggregated on the map
side or joined to a single row.

Defined results: a null or empty text has no words; a text below ``min_words`` words has
no window; a row without an id is left as it is and takes nothing from others; rows that
share an id never take from each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import bitfilter, scratch
from larkspur.llm.words import binary_texts

MIN_WORDS = 13
#: Words of an anchor.
ANCHOR = 6
#: Bytes of text that are split at a time, and words that are hashed together.
STRIP = 1 << 20
HELD_WORDS = 1 << 18

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Words in strips of about ``STRIP`` bytes."""
    at, end = 0, len(text or b"")
    while at < end:
        cut = _SPACE.search(text, min(end, at + STRIP))
        to = cut.start() if cut else end
        yield text[at:to].split()
        at = to


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    of = xxhash.xxh3_64_intdigest
    return np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(of, part), np.uint64, len(part)) for part in words_of(text))])


def _chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; the last n - 1 places have none."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += hashes[k : k + m]
        out *= _ODD
        out ^= out >> _SHIFT
    return out


class Winnowed:
    """Seeds of several texts whose word hashes stand one after another.

    ``first`` and ``last`` are the windows that chose each anchor, as places in the
    joined words; ``doc`` tells whose they are.
    """

    def __init__(self, texts: list[np.ndarray], min_words: int):
        sizes = np.array([len(x) for x in texts], np.int64)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *texts])
        self.begins = np.cumsum(sizes) - sizes
        anchor = min(ANCHOR, min_words)
        grams = _chained(self.hashes, anchor)
        m = max(0, len(self.hashes) - min_words + 1)
        best, at = grams[:m].copy(), np.arange(m)
        for k in range(1, min_words - anchor + 1):
            other = grams[k : k + m]
            less = other < best
            best[less] = other[less]
            at[less] = np.flatnonzero(less) + k
        doc = np.repeat(np.arange(len(texts)), sizes)
        # Windows that lie in one text.
        inside = np.flatnonzero(doc[:m] == doc[min_words - 1 :]) if m else np.zeros(0, np.int64)
        chosen, of = at[inside], doc[inside]
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])] if len(inside) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        self.first = inside[begin]
        self.last = inside[np.r_[begin[1:], len(inside)] - 1] if len(begin) else self.first
        self.anchor = best[self.first]
        self.doc = of[begin]
        self.min_words = min_words

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the seeds ``at``: offsets of each seed's list, and window hashes."""
        sizes = self.last[at] - self.first[at] + 1
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(self.first[at], sizes)
        out = np.zeros(total, np.uint64)
        for k in range(self.min_words):
            out += self.hashes[place + k]
            out *= _ODD
            out ^= out >> _SHIFT
        return np.r_[0, ends], out


def _groups(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with the word hashes of their texts, about ``HELD_WORDS`` words at a time."""
    for batch in batches:
        begin, held, size = 0, [], 0
        for row, value in enumerate(binary_texts(batch.column(text))):
            held.append(word_hashes(value))
            size += len(held[-1])
            if size >= HELD_WORDS:
                yield batch.slice(begin, row + 1 - begin), held
                begin, held, size = row + 1, [], 0
        if held:
            yield batch.slice(begin), held


def _anchors(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Each anchor once for each text."""
    for _, held in _groups(batches, 0):
        found = Winnowed(held, min_words)
        # Equal anchors of a text stand together after a sort by text and anchor.
        order = np.lexsort((found.anchor, found.doc))
        anchor, doc = found.anchor[order], found.doc[order]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])] if len(order) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64))], ["anchor"])


def _seeds(batches: Iterator[pa.RecordBatch], min_words: int, filtered, full: bool) -> Iterator[pa.RecordBatch]:
    """Seeds that the filter may hold: where they stand, or the hashes of their windows."""
    for batch, held in _groups(batches, 2):
        found = Winnowed(held, min_words)
        at = np.flatnonzero(bitfilter.maybe(filtered.value, found.anchor))
        offsets, windows = found.windows(at)
        place = np.arange(len(windows)) - np.repeat(offsets[:-1], np.diff(offsets))
        sums = (windows ^ (windows >> _SHIFT)) * (_ODD + place.astype(np.uint64) * np.uint64(2))
        extent = np.add.reduceat(sums, offsets[:-1]) if len(at) else sums
        keys = [pa.array(found.anchor[at].view(np.int64)), pa.array(extent.view(np.int64))]
        if full:
            yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(windows.view(np.int64)))], ["anchor", "extent", "windows"])
            continue
        rows = pa.array(found.doc[at])
        first = (found.first[at] - found.begins[found.doc[at]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*keys, batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first), pa.array(np.diff(offsets).astype(np.int32))], ["anchor", "extent", "id", "print", "first", "size"])


def _among(batches: Iterator[pa.RecordBatch], filtered, wanted: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose key (the last column) the filter may hold, or the others."""
    for batch in batches:
        held = bitfilter.maybe(filtered.value, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
        yield batch.filter(pa.array(held if wanted else ~held))


def covered(n: int, seeds: list[dict], min_words: int) -> np.ndarray:
    """Which of n words the windows that the seeds mark cover."""
    change = np.zeros(n + 1, np.int64)
    for seed in seeds:
        for k in range(seed["mask"].bit_length()):
            if seed["mask"] >> k & 1:
                change[seed["first"] + k] += 1
                change[seed["first"] + k + min_words] -= 1
    return np.cumsum(change[:-1]) > 0


def _removed(batches: Iterator[pa.RecordBatch], min_words: int, spans: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, found, kept = [], [], []
        for text, seeds in zip(binary_texts(batch.column(1)), batch.column(2)):
            words = [w for part in words_of(text) for w in part]
            sizes.append(len(words))
            if not (seeds := seeds.as_py()):
                found.append([]), kept.append(b" ".join(words))
                continue
            gone = covered(len(words), seeds, min_words)
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            found.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
            kept.append(b" ".join(words[i] for i in np.flatnonzero(~gone).tolist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, spans), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "repeats", "kept"])


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, repeats (start and end of each, in words) and the kept text.

    A word goes if a window of ``min_words`` words over it also begins in a document with
    a smaller id; windows are judged on the input.
    """
    if not 1 <= min_words <= ANCHOR + 56:
        raise ValueError("the windows of an anchor must fit into 57 bits")
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    known = rows.filter("id is not null and text is not null").select("id", "print", "text")

    def anchors(batches):
        return _anchors(batches, min_words)

    shared = known.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    repeated = bitfilter.built(shared, "anchor")

    def placed(batches):
        return _seeds(batches, min_words, repeated, False)

    def few(df: DataFrame, key: Column, held) -> DataFrame:
        """Rows whose key the filter may hold."""

        def task(batches):
            return _among(batches, held, True)

        keyed = df.withColumn("key", key)
        return keyed.mapInArrow(task, keyed.schema).drop("key")

    with scratch.Tables(spark) as table:
        seeds = table(known.mapInArrow(placed, "anchor long, extent long, id long, print long, first int, size int"), "seeds")
        extents = table(seeds.groupBy("anchor", "extent").agg(F.min("id").alias("low"), F.max("id").alias("high")), "extents")
        # Only seeds with several extensions have windows that other extensions may share.
        crowded = bitfilter.built(extents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchor")

        def opened(batches):
            return _seeds(batches, min_words, crowded, True)

        different = known.mapInArrow(opened, "anchor long, extent long, windows array<long>").groupBy("anchor", "extent").agg(F.first("windows").alias("windows"))
        bounded = different.join(few(extents, F.col("anchor"), crowded), ["anchor", "extent"])
        windows = table(bounded.select("anchor", "extent", "low", "high", F.posexplode("windows").alias("at", "window")), "windows")
        least = windows.groupBy("anchor", "window").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("anchor", "window", "least")
        judged = windows.select("anchor", "extent", "at", "window").join(least, ["anchor", "window"]).groupBy("anchor", "extent").agg(F.collect_list(F.struct("at", "least")).alias("judged"))
        whole = extents.filter("low < high").select("anchor", "extent", "low")
        marks = table(whole.join(judged, ["anchor", "extent"], "full"), "marks")
        table.drop(extents, windows)
        marked = bitfilter.built(marks.select(F.xxhash64("anchor", "extent").alias("key")), "key")
        # One bit for each window of the seed that a smaller document has: all of them if it
        # has the whole extension.
        mask = F.expr("if(coalesce(low < id, false), shiftleft(1L, size) - 1L, aggregate(coalesce(judged, array()), 0L, (m, w) -> m + if(w.least < id, shiftleft(1L, w.at), 0L)))")
        taken = few(seeds, F.xxhash64("anchor", "extent"), marked).join(marks, ["anchor", "extent"]).select("id", "print", "first", mask.alias("mask")).filter("mask > 0")
        # Equal rows of a document give equal seeds, so a set holds no more than its words.
        found = scratch.cut(taken.groupBy("id", "print").agg(F.collect_set(F.struct("first", "mask")).alias("seeds")))
    # Most texts keep all their words and are not moved for the join.
    touched = bitfilter.built(found.select(F.xxhash64("id", "print").alias("key")), "key")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("repeats", span), T.StructField("kept", T.StringType())])

    def wanted(batches):
        return _among(batches, touched, True)

    def others(batches):
        return _among(batches, touched, False)

    def remove(batches):
        return _removed(batches, min_words, kind)

    keyed = rows.withColumn("key", F.xxhash64("id", "print"))
    moved = keyed.mapInArrow(wanted, keyed.schema).join(found, ["id", "print"], "left").select("id", "text", "seeds")
    stay = keyed.mapInArrow(others, keyed.schema).select("id", "text", F.lit(None).cast(moved.schema["seeds"].dataType).alias("seeds"))
    return stay.unionByName(moved).mapInArrow(remove, out)

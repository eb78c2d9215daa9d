"""Collocations of two to four words, by language.

1. Words are counted by language; those below ``MIN_COUNT`` cannot be part of a
   frequent phrase.  The others are numbered in one range-sorted pass: the dictionary.
2. Texts are encoded once, as 32-bit ids with 0 where a piece ends or a rare word
   stands.  A dictionary of ``DICTIONARY_BYTES`` at most is broadcast; a larger one is
   joined to the words of the pieces.
3. Each task packs its id n-grams into keys of 16 bytes (two longs), counts equal ones,
   and passes on key and count.  Keys are range-partitioned and sorted, which Spark does
   by radix on their leading bytes, and runs of equal keys are added up.
4. Pairs come first; longer n-grams are counted only where all their pairs may be
   frequent, by a bit filter of fixed size.  What it lets through is counted exactly.
5. Cuts, absorption and ranks are joins and aggregates over the frequent n-grams.

Defined results: a null or empty text has no words; a null language is ``und``; rows that
repeat a document count again; equal scores and counts are ranked by phrase; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.rownumbers import numbered
from larkspur.llm import bitfilter, scratch
from larkspur.llm.words import binary_texts

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
SCALE = 2_000_000
#: A longer phrase absorbs a shorter one from so many percent of its count on.
ABSORB_PERCENT = 80
DICTIONARY_BYTES = 48 << 20
#: Different words, and n-grams, that a task holds before it passes their counts on.
HELD_WORDS = 200_000
HELD_GRAMS = 1 << 21

#: Ends of pieces become line feeds and tabs spaces; A-Z become lower case before.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with a line feed where a piece ends."""
    return [t for t in text.lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ") if t]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter[bytes]] = {}

    def flushed() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, words in held.items() for word, n in words.items() if word != b"\n"]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
            if text:
                held.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield flushed()
    yield flushed()


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n of every word of ``texts`` (lang, text)."""
    return texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


_held: dict[str, dict[str, dict[bytes, int]]] = {}


def _encoded(batches: Iterator[pa.RecordBatch], dictionary) -> Iterator[pa.RecordBatch]:
    key, table = dictionary.value
    if key not in _held:
        _held.clear()
        found: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "id"))):
            found.setdefault(lang, {})[word.encode()] = i
        _held[key] = found
    for batch in batches:
        ids = []
        for lang, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
            get = _held[key].get(lang, {}).get
            ids.append(np.array([get(t, 0) for t in tokens(text)], "<u4").tobytes() if text else b"")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, found = [], []
        for lang, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
            for piece in (text or b"").lower().translate(_ENDS).split(b"\n"):
                if words := [w for w in piece.split(b" ") if w]:
                    langs.append(lang), found.append(words)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], ["lang", "words"])


def encode(texts: DataFrame, dictionary: DataFrame, max_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """ids: little-endian 32-bit ids of each text, or of each of its pieces.

    ``dictionary`` has lang, word, id.  Beyond ``max_bytes`` of words it is joined: pieces
    get numbers in a checkpoint, their words meet the dictionary, and each piece is put
    together again, which holds one piece at a time.
    """
    spark = texts.sparkSession
    if dictionary.agg(F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0))).first()[0] <= max_bytes:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, dictionary.select("lang", "word", "id").toArrow()))

        def task(batches):
            return _encoded(batches, sent)

        return texts.mapInArrow(task, "ids binary")
    pieces = scratch.cut(texts.mapInArrow(_pieces, "lang string, words array<string>").withColumn("piece", F.monotonically_increasing_id()))
    words = pieces.select("piece", "lang", F.posexplode("words").alias("at", "word"))
    found = words.join(dictionary.select("lang", "word", "id"), ["lang", "word"], "left").select("piece", "at", F.coalesce("id", F.lit(0)).cast("int").alias("id"))
    rows = found.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("w")).select(F.transform("w", lambda x: x["id"]).alias("w"))

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(w, "<u4").tobytes() for w in batch.column(0).to_pylist()], pa.binary())], ["ids"])

    return rows.mapInArrow(packed, "ids binary")


_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def packed_grams(ids: np.ndarray, sizes: tuple[int, ...], held: np.ndarray | None = None, starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys (high, low) of the n-grams without a 0 that begin at the first ``starts``
    places; with a filter, of those whose pairs it may hold."""
    wide = ids.astype(np.uint64)
    pairs = (wide[:-1] << _HALF) | wide[1:]
    good = (ids[:-1] > 0) & (ids[1:] > 0)
    if held is not None:
        at = np.flatnonzero(good)
        good[at] = bitfilter.maybe(held, mixed(pairs[at]))
    high, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for n in sizes:
        m = min(len(ids) - n + 1, len(ids) if starts is None else starts)
        if m <= 0:
            continue
        whole = good[:m].copy()
        for k in range(1, n - 1):
            whole &= good[k : k + m]
        at = np.flatnonzero(whole)
        high.append(pairs[at])
        low.append(np.zeros(len(at), np.uint64) if n == 2 else wide[at + 2] << _HALF if n == 3 else pairs[at + 2])
    return np.concatenate(high), np.concatenate(low)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of pair keys for the filter."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run lengths of sorted keys."""
    begins = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.zeros(0, np.int64)
    return high[begins], low[begins], np.add.reduceat(n, begins) if len(high) else n


def _grams(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], filtered) -> Iterator[pa.RecordBatch]:
    """Counts of equal keys, of about ``HELD_GRAMS`` keys at a time."""
    held = None if filtered is None else filtered.value
    waiting: list[np.ndarray] = []

    def counted(ids: np.ndarray, starts: int | None = None) -> pa.RecordBatch:
        high, low = packed_grams(ids, sizes, held, starts)
        order = np.argsort(high) if sizes == (2,) else np.lexsort((low, high))
        found = runs(high[order], low[order], np.ones(len(high), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["high", "low", "n"])

    size, gap = 0, np.zeros(1, np.uint32)
    for batch in batches:
        for ids in batch.column(0).to_pylist():
            part = np.frombuffer(ids, "<u4")
            while len(part) > HELD_GRAMS:
                # The words after the last place belong to n-grams that begin before them.
                yield counted(part[: HELD_GRAMS + MAX_WORDS - 1], HELD_GRAMS)
                part = part[HELD_GRAMS:]
            waiting += [part, gap]
            size += len(part) + 1
            if size >= HELD_GRAMS:
                yield counted(np.concatenate(waiting))
                waiting, size = [], 0
    if waiting:
        yield counted(np.concatenate(waiting))


def _added(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Run-length counts over sorted batches; a run may go on in the next batch."""
    kept = (np.zeros(0, np.int64),) * 3

    def out(part) -> pa.RecordBatch:
        often = part[2] >= least
        return pa.RecordBatch.from_arrays([pa.array(x[often]) for x in part], ["high", "low", "n"])

    for batch in batches:
        if batch.num_rows:
            joined = runs(*(np.concatenate((a, c.to_numpy())) for a, c in zip(kept, batch.columns)))
            kept = tuple(x[-1:] for x in joined)
            yield out(tuple(x[:-1] for x in joined))
    yield out(kept)


def frequent(ids: DataFrame, sizes: tuple[int, ...], filtered=None, least: int = MIN_COUNT) -> DataFrame:
    """high, low, n of the n-grams of these sizes that occur often enough."""

    def task(batches):
        return _grams(batches, sizes, filtered)

    def add(batches):
        return _added(batches, least)

    keys = ids.mapInArrow(task, "high long, low long, n long")
    return keys.repartitionByRange("high", "low").sortWithinPartitions("high", "low").mapInArrow(add, "high long, low long, n long")


def _parts(high: Column, low: Column) -> Column:
    """The ids of a key."""
    word = lambda c, shift: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.filter(F.array(word(high, 32), word(high, 0), word(low, 32), word(low, 0)), lambda w: w > 0)


def _key(ids: Column) -> list[Column]:
    """high, low of an array of one to four ids."""
    at = lambda k: F.coalesce(F.get(ids, F.lit(k)), F.lit(0)).cast("long")
    return [F.shiftleft(at(0), 32).bitwiseOR(at(1)).alias("high"), F.shiftleft(at(2), 32).bitwiseOR(at(3)).alias("low")]


def scored(counts: DataFrame) -> DataFrame:
    """high, low, a, l, r, score of the phrases in ``counts`` (high, low, n; words too).

    The score of a phrase is that of its lowest-scoring cut, the first of equals.
    """
    several = counts.select("high", "low", F.col("n").alias("a"), _parts(F.col("high"), F.col("low")).alias("ids")).filter(F.size("ids") > 1)
    cuts = several.select("high", "low", "a", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    sides = cuts.select("high", "low", "a", "k", F.struct(*_key(F.slice("ids", F.lit(1), F.col("k")))).alias("first"), F.struct(*_key(F.slice("ids", F.col("k") + 1, F.size("ids")))).alias("rest"))
    left, right = (counts.select(F.struct("high", "low").alias(f"of_{x}"), F.col("n").alias(x)) for x in "lr")
    both = sides.join(left, F.col("first") == F.col("of_l")).join(right, F.col("rest") == F.col("of_r"))
    # Whole decimals: the product passes 64 bits in a large corpus, the quotient can't.
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").cast("long")
    best = both.withColumn("score", score).groupBy("high", "low").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("high", "low", "a", "cut.l", "cut.r", "cut.score")


def absorbing(counts: DataFrame) -> DataFrame:
    """high, low, most: the largest count of a longer phrase that holds the phrase."""
    longer = counts.select("n", _parts(F.col("high"), F.col("low")).alias("ids")).filter(F.size("ids") > 2)
    lengths = F.sequence(F.lit(2), F.size("ids") - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda at: F.slice("ids", at, m))))
    return longer.select("n", F.explode(inner).alias("part")).select("n", *_key(F.col("part"))).groupBy("high", "low").agg(F.max("n").alias("most"))


def _ranked(df: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language; languages are dealt in 64 shares first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shared = df.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("_share")


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all
    words of the language.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words = scratch.cut(word_counts(texts))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.filter(F.col("n") >= min_count)
    dictionary = scratch.cut(numbered(often.repartitionByRange(F.desc("n"), "lang", "word").sortWithinPartitions(F.desc("n"), "lang", "word"), "id", first=1))
    ids = scratch.cut(encode(texts, dictionary, dictionary_bytes))
    pairs = scratch.cut(frequent(ids, (2,), least=min_count))
    mix = bitfilter.built(pairs.mapInArrow(_mixed_keys, "h long"), "h")
    longer = scratch.cut(frequent(ids, tuple(range(3, MAX_WORDS + 1)), mix, min_count))
    single = dictionary.select(F.shiftleft(F.col("id"), 32).alias("high"), F.lit(0).cast("long").alias("low"), "n")
    counts = scratch.cut(single.unionByName(pairs).unionByName(longer))
    several = counts.filter("low > 0 or (high & 4294967295) > 0")
    free = scored(counts).join(absorbing(several), ["high", "low"], "left").filter(f"most is null or 100 * cast(most as decimal(20,0)) < {ABSORB_PERCENT} * cast(a as decimal(20,0))").drop("most")
    spelled = free.select("*", F.posexplode(_parts(F.col("high"), F.col("low"))).alias("at", "id")).join(dictionary.select("id", "lang", "word"), "id")
    rows = spelled.groupBy("high", "low", "a", "l", "r", "score", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    best = _ranked(rows, top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _mixed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["h"])

"""Spelling variants: words one edit away from a much more frequent word.

1. Words are counted in Spark.  The table of words is range-partitioned, and each
   task packs its sorted words into compact tries of ``SHARD_WORDS`` words at most.
2. Tries are broadcast in passes of ``PASS_BYTES`` at most.  Every word's automaton
   of Levenshtein distance one is intersected with every trie depth-first: while no
   edit is used it branches at each node of the word's own path; after the edit
   each state has one transition left, so the walk follows a single edge.
3. Each (word, trie) gives one row with the number of accepted neighbours and the
   best of them; these are reduced by word.  Forms are then followed to their root
   by doubling steps of joins.

Defined results: null and empty texts have no words; rows that repeat a document
count again; a null document id reads as an empty one in the checksum that plants
typing errors; equal counts prefer the smaller word in code-point order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import scratch
from larkspur.llm.words import binary_texts

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Of so many pairs of document and word, one loses a code point.
TYPO_EVERY = 199
SHARD_WORDS = 100_000
PASS_BYTES = 32 << 20
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 200_000


def typed(doc_id: str, run: str) -> str:
    """The run as a document has it: some runs lose a code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    # Runs only get shorter, so shorter ones need not be looked at.
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    held: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
            own = Counter(m.group() for m in runs.finditer(text.lower().decode("utf-8", "replace"))) if text else {}
            for run, n in own.items():
                word = typed("" if doc_id is None else doc_id, run)
                if len(word) >= least:
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield flushed()
    yield flushed()


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""

    def task(batches):
        return _counted(batches, min_length)

    found = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string")).mapInArrow(task, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Trie:
    """Sorted distinct words in level order.

    ``labels`` holds each node's code point, and the children of a node stand side
    by side from ``first[node]`` to ``first[node + 1]``, so a child is found by
    searching that part of the string.
    """

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        labels, self.first, self.word = ["\0"], array("I"), array("i")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for low, high in level:
                self.first.append(len(labels))
                ends = low < high and len(words[low]) == depth
                self.word.append(low if ends else -1)
                at = low + ends
                while at < high:
                    c, begin = words[at][depth], at
                    while at < high and words[at][depth] == c:
                        at += 1
                    labels.append(c)
                    below.append((begin, at))
            level, depth = below, depth + 1
        self.first.append(len(labels))
        self.labels = "".join(labels)

    def rest(self, node: int, word: str, at: int) -> int:
        """The word reached from a node by exactly ``word[at:]``, or -1."""
        find, first = self.labels.find, self.first
        for c in word[at:]:
            node = find(c, first[node], first[node + 1])
            if node < 0:
                return -1
        return self.word[node]

    def near(self, word: str) -> set[int]:
        """Places of the words at distance exactly one."""
        found, node, labels, first = set(), 0, self.labels, self.first
        for at in range(len(word) + 1):
            low, high = first[node], first[node + 1]
            if at < len(word):
                found.add(self.rest(node, word, at + 1))
            own = word[at] if at < len(word) else None
            for child in range(low, high):
                found.add(self.rest(child, word, at))
                if own is not None and labels[child] != own:
                    found.add(self.rest(child, word, at + 1))
            node = labels.find(own, low, high) if own is not None else -1
            if node < 0:
                break
        found.discard(-1)
        return found


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted words in runs of ``most``, each one row."""
    words, counts = [], []

    def packed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([words[:most]], pa.list_(pa.string())), pa.array([counts[:most]], pa.list_(pa.int64()))], ["words", "counts"])
        del words[:most], counts[:most]
        return out

    for batch in batches:
        words += batch.column(0).to_pylist()
        counts += batch.column(1).to_pylist()
        while len(words) >= most:
            yield packed()
    if words:
        yield packed()


_tries: dict[str, list[Trie]] = {}


def _searched(batches: Iterator[pa.RecordBatch], shards) -> Iterator[pa.RecordBatch]:
    """word, n_near, (n, word) of the best neighbour, for each word and trie with any."""
    key, packed = shards.value
    if key not in _tries:
        _tries.clear()
        _tries[key] = [Trie(words, counts) for words, counts in packed]
    for batch in batches:
        words, sizes, best = [], [], []
        for word in batch.column(0).to_pylist():
            for trie in _tries[key]:
                if near := trie.near(word):
                    n, least = max((trie.counts[i], -i) for i in near)
                    words.append(word), sizes.append(len(near)), best.append((n, trie.words[-least]))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(sizes, pa.int64()), pa.array([n for n, _ in best], pa.int64()), pa.array([w for _, w in best], pa.string())], ["word", "n_near", "best_n", "best"])


def neighbours(counts: DataFrame, *, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, n_near, best_n, best for each word with a neighbour at distance one."""
    spark = counts.sparkSession

    def pack(batches):
        return _shards(batches, shard_words)

    shards = scratch.cut(counts.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(pack, "words array<string>, counts array<long>"))
    found = None

    def searched(held: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, held))

        def task(batches):
            return _searched(batches, sent)

        return scratch.cut(counts.select("word").mapInArrow(task, "word string, n_near long, best_n long, best string"))

    held, size = [], 0
    for row in shards.select("words", "counts", F.expr("aggregate(words, 0L, (a, w) -> a + octet_length(w) + 8)").alias("size")).toLocalIterator():
        if held and size + row["size"] > pass_bytes:
            part = searched(held)
            found = part if found is None else found.unionByName(part)
            held, size = [], 0
        held.append((row["words"], row["counts"]))
        size += row["size"]
    part = searched(held)
    found = part if found is None else found.unionByName(part)
    # Of equal counts the smaller word: the largest count is kept apart from the word.
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: each word's last form.  Counts grow along a chain, so none is a ring.

    Each turn doubles the length of the chains that are settled.
    """
    now = scratch.cut(links.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("at"), F.col("root").alias("up"))
        turned = scratch.cut(now.join(up, F.col("root") == F.col("at"), "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        now = turned.select("word", "root")
        if turned.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    counts = scratch.cut(word_counts(docs, doc_id=doc_id, text=text, min_length=min_length, min_count=min_count))
    near = neighbours(counts, shard_words=shard_words, pass_bytes=pass_bytes)
    takes = F.col("best_n") >= ratio * F.col("n")
    rows = scratch.cut(counts.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")))
    return rows.join(roots(rows.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))

"""Repeated passages against a search over all windows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import queries, repeats, scratch
from larkspur.llm.sql import ORACLES

DOCS = "id string, doc_id long, text string, print long, seeds string, kept string"


def brute(rows, n):
    """(doc_id, words, spans, kept) of each row, by every window of every row."""
    least = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for p in range(len(words) - n + 1):
            key = tuple(words[p : p + n])
            if doc_id is not None:
                least[key] = min(doc_id, least.get(key, doc_id))
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - n + 1):
            if doc_id is not None and least[tuple(words[p : p + n])] < doc_id:
                gone[p : p + n] = [True] * n
        spans, at = [], 0
        while at < len(words):
            end = at
            while end < len(words) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = max(end, at + 1)
        out.append((doc_id is not None, doc_id or 0, len(words), spans, " ".join(w.decode() for w, g in zip(words, gone) if not g)))
    return sorted(out)


def found(spark, rows, n):
    docs = spark.createDataFrame([("mine", d, t, 1, "s", "k") for d, t in rows], DOCS)
    got = repeats.without_repeats(docs, min_words=n).collect()
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, [(s.start, s.end) for s in r.repeats], r.kept) for r in got)


def fixture(seed, n_docs=60, vocabulary=400):
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    passages = [prose(rng.randrange(8, 40)) for _ in range(6)]
    rows = []
    for k in range(n_docs):
        words = prose(rng.randrange(0, 30))
        for _ in range(rng.randrange(3)):
            part = list(rng.choice(passages))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "changed"
            words += part + prose(rng.randrange(5))
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("n", [13, 8, 3, 1])
def test_against_all_windows(spark, n):
    rows = fixture(n)
    rows += [(None, rows[0][1]), (None, rows[5][1]), (3, rows[5][1]), (7, rows[7][1]), (100, None), (101, ""), (102, " \t\r\n"), (103, rows[4][1]), (-5, rows[4][1]), (104, "short text")]
    assert found(spark, rows, n) == brute(rows, n)


def test_common_words_and_periodic_texts(spark):
    rows = [(k, " ".join(["a b"] * (4 + k))) for k in range(12)] + [(20, "a " * 40), (21, "a " * 13), (22, "a " * 12), (23, "A " * 20), (24, "x\x0by\x0cz " * 9), (25, "z x y " * 9)]
    assert found(spark, rows, 13) == brute(rows, 13)


def test_very_long_text_and_words_in_strips(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRIP", 64)
    monkeypatch.setattr(repeats, "HELD_WORDS", 50)
    assert [w for part in repeats.words_of(b"  a bb\tccc " + b"d" * 200 + b" e\n") for w in part] == [b"a", b"bb", b"ccc", b"d" * 200, b"e"]
    long = " ".join(f"v{k}" for k in range(50_000))
    rows = [(1, long), (2, "start " + long + " end"), (2, "start " + long + " end")]
    got = found(spark, rows, 13)
    assert [x[3] for x in got] == [[], [(1, 50_001)], [(1, 50_001)]] and [x[4] for x in got[1:]] == ["start end"] * 2


def test_repeated_words_that_lie_close_are_one_repeat(spark):
    first = [f"p{k}" for k in range(20)]
    rows = [(1, " ".join(first)), (2, " ".join(first[:13] + first[7:20]))]
    assert found(spark, rows, 13)[1][3] == [(0, 26)]


def test_empty_table_and_refused_sizes(spark):
    empty = spark.createDataFrame([], DOCS)
    assert repeats.without_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(empty, min_words=0)


def test_query_digests_what_the_operator_keeps(spark, tmp_path):
    rows = fixture(99)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op11_substring_dedup(spark, str(tmp_path)).collect()}
    want = spark.createDataFrame([(d, k) for _, d, _, _, k in brute(rows, 13)], "doc_id long, kept string").select("doc_id", F.sha2("kept", 256).alias("s")).collect()
    assert {k: r.kept_sha256 for k, r in got.items()} == {r.doc_id: r.s for r in want}
    assert {k: r.n_removed for k, r in got.items()} == {d: sum(b - a for a, b in spans) for _, d, _, spans, _ in brute(rows, 13)}
    assert "op11_substring_dedup" in ORACLES


def test_texts_reach_workers_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    repeats.without_repeats(docs.limit(10)).collect()

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

    found = [r.bytes for r in docs.mapInArrow(sizes, "bytes long").collect()]
    assert sum(found) > 16e6 and max(found) < 2 * scratch.BATCH_BYTES
    # A limit that the session names is left as it is.
    spark.conf.set(name, "1000000")
    scratch.bounded_batches(spark)
    assert spark.conf.get(name) == "1000000"
    spark.conf.unset(name)

"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import bitfilter, collocations

DOCS = "text string, lang string, id string, n long, word string"


def brute(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                for p in range(len(words) - n + 1):
                    f[lang, tuple(words[p : p + n])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inner = {}
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for p in range(len(w) - m + 1):
                inner[lang, w[p : p + m]] = max(a, inner.get((lang, w[p : p + m]), 0))
    out = {}
    for (lang, w), a in cand.items():
        if 100 * inner.get((lang, w), 0) >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def fixture(seed, n_docs=80):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "État", "in", "a-b", "x y", "Straße"]
    rows = []
    for k in range(n_docs):
        text = ""
        for _ in range(rng.randrange(40)):
            text += rng.choice(words + ["new york city council", f"rare{rng.randrange(500)}"]) + rng.choice([" ", " ", " ", "\t", ". ", ", ", "\n", "\r\n", "  ", "\x0b", "?"])
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "en"), ("!!! ...", "fr"), (rows[0][0], rows[0][1])]


def found(spark, rows, least, top, **more):
    docs = spark.createDataFrame([(t, lang, "mine", 7, "w") for t, lang in rows], DOCS)
    got = collocations.phrases(docs, min_count=least, top=top, **more)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (2, 4)])
def test_against_plain_counting(spark, least, top):
    rows = fixture(least)
    want = brute(rows, least, top)
    assert want and found(spark, rows, least, top) == want


def test_a_dictionary_that_is_joined_gives_the_same(spark):
    rows = fixture(5)
    assert found(spark, rows, 3, 2000, dictionary_bytes=0) == brute(rows, 3, 2000)


def test_small_batches_and_long_texts(spark, monkeypatch):
    rows = fixture(6) + [("one two three four " * 400, "en"), ("one two three four " * 100 + ".", "en")]
    ids = np.array([1, 2, 3, 1, 2, 3, 4, 0, 1, 2, 3, 4], "<u4")
    monkeypatch.setattr(collocations, "HELD_GRAMS", 4)

    def counts(parts):
        total = Counter()
        for b in collocations._grams(iter(parts), (3, 4), None):
            for high, low, n in zip(*(c.to_pylist() for c in b.columns)):
                total[high, low] += n
        return total

    import pyarrow as pa

    cut = counts([pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])])
    monkeypatch.setattr(collocations, "HELD_GRAMS", 1 << 21)
    assert cut == counts([pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])]) and cut[(1 << 32) + 2, 3 << 32] == 3
    assert found(spark, rows, 3, 2000) == brute(rows, 3, 2000)


def test_runs_go_on_over_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["high", "low", "n"]) for cols in (([1, 1], [0, 0], [2, 1]), ([1, 2], [0, 0], [1, 1]), ([], [], []), ([2, 2], [0, 5], [4, 1]))]
    got = [tuple(c[i].as_py() for c in b.columns) for b in collocations._added(iter(batches), 1) for i in range(b.num_rows)]
    assert got == [(1, 0, 4), (2, 0, 5), (2, 5, 1)]


def test_large_counts_are_exact(spark):
    key = 1 << 32
    counts = spark.createDataFrame([(key + 2, 0, 9 * 10**12), (key, 0, 10**13 + 1), (2 * key, 0, 9 * 10**12 + 1)], "high long, low long, n long")
    r = collocations.scored(counts).first()
    assert (r.a, r.l, r.r, r.score) == (9 * 10**12, 10**13 + 1, 9 * 10**12 + 1, 2_000_000 * 9 * 10**12 // (19 * 10**12 + 2))


def test_filter_never_loses_a_hash(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 500)
    held = bitfilter.built(spark.createDataFrame([(int(x),) for x in hashes], "h long"), "h", bits=12).value
    assert bitfilter.maybe(held, hashes.view(np.uint64)).all()


def test_empty_table(spark):
    assert collocations.phrases(spark.createDataFrame([], DOCS)).count() == 0

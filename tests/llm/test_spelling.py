"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from larkspur.llm import queries, spelling

DOCS = "doc_id long, text string, word string, n long, root string"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows, least=6, often=5, ratio=5):
    """(word, n, n_near, form, form_n, root) by comparing every two words."""
    counts = Counter()
    for doc_id, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += len(run) >= least
    counts = {w: n for w, n in counts.items() if n >= often and len(w) >= least}
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w, ""), counts[form[w]] if w in form else 0, root(w)) for w, n in counts.items())


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def fixture(spark, seed=1):
    rng = random.Random(seed)
    stems = ["garden", "window", "Straßen", "écoutez", "longerword", "aaaaaa", "abcabc", "coope÷rate"]
    pool = []
    for k, stem in enumerate(stems):
        pool += [stem] * (300 if k % 2 else 60)
        for _ in range(6):
            w = list(stem)
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.pop(at), lambda: w.insert(at, "e"), lambda: w.__setitem__(at, "x")])()
            pool += ["".join(w)] * rng.choice([5, 11, 12, 60])
    rng.shuffle(pool)
    rows = [(k, " ".join(pool[at : at + 50])) for k, at in enumerate(range(0, len(pool), 50))]
    rows += [(None, "garden window"), (900, None), (901, ""), (902, "short GARDEN, Garden1garden"), (0, rows[0][1]), (0, rows[0][1])]
    return rows, spark.createDataFrame([(d, t, "mine", 1, "r") for d, t in rows], DOCS)


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 3, "pass_bytes": 60}])
def test_against_all_pairs(spark, sizes):
    rows, docs = fixture(spark)
    want = brute(rows)
    assert sum(x[2] for x in want) > 20 and any(x[3] for x in want)
    assert got(spelling.variants(docs, **sizes)) == want


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert len(want) > 100 and got(queries.op13_spelling_variants(spark, sf)) == want


def test_chains_lead_to_the_last_form(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(23)] + [("x", "w20")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert set(found.values()) == {"w23"} and len(found) == 24


def test_automaton_finds_every_kind_of_edit():
    words = sorted({"abcdef", "abcde", "abcdeff", "xabcdef", "abxcdef", "bcdef", "abcdex", "abdcef", "abcdefgh", "abccdef", ""})
    trie = spelling.Trie(words, [1] * len(words))
    for w in [*words, "zzz", "abcdeg"]:
        assert {words[i] for i in trie.near(w)} == {v for v in words if one_apart(w, v)}


def test_empty_table_and_long_text(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "g" * 200_000 + " garden" * 100_000)]
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)

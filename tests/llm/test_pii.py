"""Contextual personal data: bootstrapping over turns, long texts, whole queries, edge cases."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from larkspur.llm import pii, queries
from tests_llm_base import KINDS, base_of

DOCS = "doc_id long, text string"


def spans_of(rows):
    return {r.id: [(s.kind, s.start, s.end) for s in r.spans] for r in rows}


def test_a_second_turn_discovers_what_the_first_cannot(spark):
    seeds = [f"call desk: +1 (0{k:02d}) 555-{1000 + k} now" for k in range(8)]
    # Unseen numbers in the seeds' context, which then stand in a context of their own.
    bridge = [f"call desk: 555 {200 + k} 98{10 + k} now" for k in range(6)]
    own = [f"hotline equals 555 {200 + k} 98{10 + k} thanks" for k in range(6)]
    last = ["hotline equals 555 777 1234 thanks", "version is 555 777 1234 maybe"]
    texts = [*seeds, *bridge, *own, *last]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = spans_of(pii.find(docs).collect())
    assert all(got[i] for i in range(8 + 6 + 6)) and got[20] == [("phone", 15, 27)]
    assert got[21] == []


def test_long_tokens_and_contexts_are_whole(spark):
    long = "x" * 500
    seeds = [f"{long}: +1 (0{k:02d}) 555-{1000 + k} now" for k in range(8)]
    docs = spark.createDataFrame(list(enumerate([*seeds, f"{long}: {long}5551234567 now"])), DOCS)
    rows = {r.key: r for r in pii.base_spans(docs).collect()}
    candidates = [c for r in rows.values() for c in r.candidates]
    assert [c.value for c in candidates] == [f"{long}5551234567"]
    assert all(any(p.startswith(long) for p in b.patterns) for r in rows.values() for b in r.base)


def test_very_many_tokens_in_one_text(spark):
    n = 30_000
    text = " ".join(f"t{i}x4" if i % 3 else f"a{i}@b.c" for i in range(n))
    began = time.time()
    row = pii.find(spark.createDataFrame([(1, text)], DOCS)).first()
    assert len(row.base) == 10_000 and [(b.kind, b.start, b.end) for b in row.base] == [(k, a, e) for k, a, e in base_of(text)]
    masked = pii.mask(spark.createDataFrame([(1, text)], DOCS)).first().text
    assert masked == " ".join(f"t{i}x4" if i % 3 else "<email>" for i in range(n))
    assert time.time() - began < 120


def test_query_against_plain_expressions(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_pii(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_of(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind, _ in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) or not want


def test_masking_keeps_rows_columns_nulls_and_overlaps(spark):
    rows = [(1, None, "k"), (2, "", "k"), (None, "me@x.org", "k"), (1, "card 4111 1111 1111 1111, +1 (017) 555-7713 😀 10.0.0.1", "k"), (1, "card 4111 1111 1111 1111, +1 (017) 555-7713 😀 10.0.0.1", "k"), (5, "+4111111111111111 x", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.mask(docs)
    assert got.columns == docs.columns
    assert sorted("null" if r.text is None else r.text for r in got.collect()) == sorted(["null", "", "<email>", *["card <card>, <phone> 😀 <ip>"] * 2, "+<card> x"])
    assert pii.mask(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 1000])
def test_values_before_each(spark, n):
    df = spark.createDataFrame([([k * 7 % 11 for k in range(n)],)], "x array<long>")
    row = df.select(pii._before_each(F.col("x"), lambda a, b: a + b).alias("s"), pii._before_each(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).first()
    values = [k * 7 % 11 for k in range(n)]
    assert row.s == [sum(values[:k]) for k in range(n)] and row.m == [max([0, *values[:k]]) for k in range(n)]

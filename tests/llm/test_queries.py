"""Whole queries and pipeline stages against brute force on small tables."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, licenses, minhash, quality, queries, sentencepiece_fst, tokenbin
from tests_llm_base import base_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    texts = texts_of(spark)
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in queries.op4_token_binary(spark, SF).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        r = rows[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards_of_a_task_and_long_documents(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(k, "word " * (k * 40), 1, "x") for k in range(12)] + [(None, None, 1, "x")], "doc_id long, text string, start long, ids string")
    path = queries.tokenizer_path("word_bpe_49k.json")
    whole = tokenbin.write(docs, str(tmp_path / "a"), path, partitions=1)
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.read(spark, whole).collect())
    assert [x[3] for x in rows] == [1, 1, *[k * 40 + 1 for k in range(1, 12)]] and len(whole) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenbin.read(spark, tokenbin.write(empty, str(tmp_path / "b"), path)).count() == 0


def test_another_tokenizer_is_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, " ": 2, "ab": 3, "b ": 4}, merges=[("a", "b"), ("b", " ")]))
    made.pre_tokenizer = pre_tokenizers.Split("zzz", "isolated")
    made.save(str(tmp_path / "t.json"))
    encoder = tokenbin.ChunkEncoder(str(tmp_path / "t.json"))
    assert not encoder.splits
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(["bb ab", ""])] == [made.encode("bb ab").ids, []]


def test_licenses_against_plain_search(spark):
    texts = texts_of(spark)
    phrases = [(p.split(), label) for p, label in licenses.BASE.items()]
    rows = {r.doc_id: r for r in queries.op5_licenses(spark, SF).collect()}
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        hits = sorted((i, label) for i in range(len(words)) for p, label in phrases if words[i : i + len(p)] == p)
        r = rows[doc_id]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_verdicts_in_the_query_columns(spark):
    texts = ["SPDX-License-Identifier: MIT OR GPL-2.0-only\nrest", "// SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "SPDX-License-Identifier: (MIT AND", None, "", "x " * 100_000 + "all rights reserved"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(0, texts[0], "c")], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license.expressions, r.license.permissive, r.license.labels) for r in licenses.scan(docs).collect())
    assert got[0] == got[1] == (0, ["(gpl-2.0-only or mit)"], True, ["gpl-2.0-only", "mit"])
    assert got[2] == (1, ["gpl-2.0 with classpath-exception-2.0"], False, ["gpl-2.0"])
    assert got[3][1:3] == ([], None) and got[4][3] == [] and got[6][3] == ["reserved"]


def test_piece_query_against_the_library(spark):
    import sentencepiece

    texts = texts_of(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for r in queries.op10_sentencepiece(spark, SF).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_ids == len(r.ids)


def test_long_unbroken_strings_are_not_remembered():
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    fst, library = sentencepiece_fst.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["q" * 500 + f" a{k} " + "é7" * 90 for k in range(5)] + ["z" * 300]
    assert [np.frombuffer(fst.encode(t), "<i4").tolist() for t in texts] == library.encode(texts)
    assert max(map(len, [*fst.words, *fst.memo])) <= sentencepiece_fst.MEMO_LENGTH


def test_votes_against_brute_force():
    rng = np.random.default_rng(5)
    terms = np.abs(rng.normal(size=(80, quality.WIDTH))).astype(np.float32)
    terms[10:40] = terms[9]
    labels = (rng.random(80) < 0.5).astype(float)
    model = quality.fit(terms, labels, dims=8)
    asked = np.concatenate((terms[5:12], np.abs(rng.normal(size=(9, quality.WIDTH))).astype(np.float32)))
    cosines = model.project(asked) @ model.latent.T
    for i, got in enumerate(model.score(asked)):
        near = sorted(range(80), key=lambda j: (-cosines[i, j], j))[: model.k]
        votes = [min(1.0, max(1e-3, float(cosines[i, j]))) ** quality.SHARPNESS for j in near]
        assert got == pytest.approx(sum(v * labels[j] for v, j in zip(votes, near)) / sum(votes))


def test_training_rows_are_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 60, k % 2) for k in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, max_train=20)
    assert 0 < len(model.labels) <= 20
    got = quality.score(docs.withColumn("score", F.lit("mine")), model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 400
    assert quality.score(docs.limit(0), model).count() == 0


def small_docs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, prose(60), "en", "s", 0) for k in range(20)]
    rows += [(20, rows[3][1], "en", "s", 0), (21, rows[4][1] + " more", "fr", "s", 0), (22, "mail me@x.org or 10.0.0.1", "en", "s", 0), (23, None, None, None, None), (24, "", "en", "s", 0), (25, "leak " + prose(5) + " q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 end", "en", "s", 0), (22, "mail me@x.org or 10.0.0.1", "en", "s", 0)]
    return spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], DOCS), rows


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    import sentencepiece

    docs, rows = small_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    # Without labels nothing is rejected.
    assert P.quality_filter(spark, docs, sf).count() == len(rows)
    kept = {r.doc_id for r in P.near_dedup(spark, docs, sf).collect()}
    assert kept == set(range(26)) - {20, 21}
    clean = P.decontamination(spark, docs, sf)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(26)) - {25}
    for r in P.mask_pii(spark, docs, sf).collect():
        if r.doc_id == 22:
            assert (r.text, r.n_chars) == ("mail <email> or <ip>", 20)
        else:
            assert r.text == rows[r.doc_id][1] and not base_of(r.text)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in P.run(spark, sf).collect()}
    want = {k: rows[k][1] or "" for k in set(range(25)) - {20, 21}} | {22: "mail <email> or <ip>"}
    assert got == {k: library.encode(t) for k, t in want.items()}


def test_pipeline_stages_bound_their_batches(spark):
    from larkspur.llm import decontaminate, minhash, quality, scratch, sentencepiece_fst

    name, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([], "doc_id long, text string, quality int, item_id string")
    for stage in (lambda: quality.train(docs, docs), lambda: minhash.near_duplicates(docs), lambda: decontaminate.scan(docs, docs), lambda: sentencepiece_fst.encode(docs, queries.tokenizer_path("piece_bpe_32k.model"))):
        spark.conf.unset(name)
        stage()
        assert int(spark.conf.get(name).rstrip("b")) == scratch.BATCH_BYTES


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts_and_repeated_rows(spark):
    long = " ".join(f"v{k}" for k in range(120_000))
    docs = spark.createDataFrame([(1, long, 7), (1, long, 7), (2, long + " end", 7)], "doc_id long, text string, component_id int")
    bench = spark.createDataFrame([(5, " ".join(f"v{k}" for k in range(60_000, 60_010)))], "item_id long, text string")
    assert [r.contamination.n_hit for r in decontaminate.scan(docs, bench).collect()] == [10, 10, 10]
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_stages_pass_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P

    docs, rows = small_docs(spark)
    names = ["_text", "_before", "_id", "_n", "_row", "_shorter", "_score", "_contamination", "_base", "_spans", "_key", "row", "score", "contamination", "kept", "print"]
    mine = docs.withColumns({c: F.lit(f"mine {c}") for c in names})
    spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage, n in ((P.quality_filter, len(rows)), (P.near_dedup, len(rows) - 3), (P.decontamination, len(rows) - 1), (P.mask_pii, len(rows))):
        got = stage(spark, mine, str(tmp_path))
        assert got.columns == mine.columns and got.count() == n
        assert {tuple(r) for r in got.select(*names).distinct().collect()} == {tuple(f"mine {c}" for c in names)}
    masked = P.mask_pii(spark, mine.filter("doc_id = 22"), str(tmp_path)).first()
    assert masked.text == "mail <email> or <ip>" and "@" not in str(masked)


def test_vectors_of_each_length_are_searched(spark):
    from larkspur.llm import ann

    rng = np.random.default_rng(8)
    vectors = {k: rng.normal(size=4 if k % 3 else 6).tolist() for k in range(240)}
    rows = [(k, v) for k, v in vectors.items()] + [(900, [1.0]), (901, None), (902, [float("inf")] * 4), (903, [0.0] * 6)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    # The only vector of one component has no other row to find.
    assert set(got) == {k for k in range(240) if k % 20 == 0}
    hits = 0
    for q, found in got.items():
        want = sorted((-float(np.dot(vectors[q], v)), k) for k, v in vectors.items() if k != q and len(v) == len(vectors[q]))[:20]
        assert [r for r, *_ in sorted(found)] == list(range(1, len(want) + 1))
        hits += len({k for _, k, _ in found} & {k for _, k in want}) / len(want)
    assert hits / len(got) >= 0.9

"""Operators against brute force on small fixtures with nulls, ties and empty tables."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import ann, decontaminate, html_extract, licenses, minhash, phrases, pii, quality, queries, scratch, sentencepiece_fst, tokenbin, warc
from larkspur.llm.html_blocks import blocks
from tests_llm_base import base_of

DOCS = "doc_id long, text string, lang string, contamination string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "mine") for i, t in enumerate(texts)], DOCS)


def prose(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["the", "of", "erth", "ing", "tion", "and", "shin", "blest", "onth", "re"]) + str(rng.randrange(40)) for _ in range(n)]


def test_decontamination_spans_and_clashing_names(spark):
    bench = spark.createDataFrame([(1, " ".join("abcdefghijkl")), (2, "Two words"), (None, "z z"), (3, None), (4, "!!")], "item_id long, text string")
    texts = ["É x A, b c d e f g h i j K. l y", "say two WORDS two words", None, "", "abc"]
    rows = decontaminate.scan(frame(spark, texts), bench).orderBy("doc_id").collect()
    assert [(r.contamination.n_words, r.contamination.n_hit, list(r.contamination["items"])) for r in rows] == [(15, 12, ["1"]), (5, 4, ["2"]), (0, 0, []), (0, 0, []), (1, 0, [])]
    s = rows[0].contamination.spans[0]
    assert texts[0][s.start : s.end] == "A, b c d e f g h i j K. l"


def test_windows_of_an_item_without_an_id_mark_words(spark):
    bench = spark.createDataFrame([(None, "nine lives"), (4, "nine lives"), (None, "two")], "item_id long, text string")
    row = decontaminate.scan(frame(spark, ["it has nine lives two"]), bench).first().contamination
    assert (row.n_hit, list(row["items"])) == (3, ["4"])


def test_decontamination_in_shards_agrees(spark):
    bench = spark.createDataFrame([(k, " ".join(prose(14, k))) for k in range(6)], "item_id long, text string")
    docs = frame(spark, [" ".join(prose(14, k) + prose(9, k + 50) + prose(14, k + 1)) for k in range(6)] + [None])
    one = decontaminate.scan(docs, bench).orderBy("doc_id").collect()
    many = decontaminate.scan(docs, bench, max_bytes=400).orderBy("doc_id").collect()
    assert [r.contamination for r in one] == [r.contamination for r in many]


def test_empty_tables(spark):
    docs, pages = spark.createDataFrame([], DOCS), spark.createDataFrame([], "page_id long, url string, html string")
    assert decontaminate.scan(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    assert pii.find(docs).count() == 0
    assert licenses.scan(docs).count() == 0
    assert html_extract.extract(pages).count() == 0
    assert warc.write(pages, scratch.fresh_dir(spark, "t")) == []
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    texts = [" ".join(prose(120, k)) for k in range(12)]
    for k in range(40):
        words = texts[k % 3].split()
        for _ in range(k % 9):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), "one two", "one two", None, "", "  ", None]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, texts), shingle=3, percent=85).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_rows_that_share_an_id_share_links(spark):
    a, b = " ".join(prose(50, 1)), " ".join(prose(50, 2))
    docs = spark.createDataFrame([(5, a), (7, a), (7, b), (9, b), (None, a), (5, a)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False)]


def test_near_copies_of_a_class_whose_least_id_has_other_texts(spark):
    a, b = prose(80, 1), prose(80, 2)
    near = [[*x[:70], f"new{k}", *x[71:]] for k, x in enumerate((a, b))]
    for x, y, y_near in ((a, b, near[1]), (b, a, near[0])):
        rows = [(5, x), (5, y), (7, y), (9, y_near), (11, prose(80, 3)), (12, prose(80, 4)), (13, [*prose(80, 4), "end"])]
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
        assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True), (12, 12, True), (13, 12, False)]


def test_dedup_keeps_one_row_of_repeated_and_of_null_ids(spark):
    import corpus_pipeline

    a, b, c = (" ".join(prose(60, k)) for k in range(3))
    rows = [(5, a), (5, a), (5, a + " end"), (7, a), (8, b), (None, a), (None, a), (None, c), (None, None), (None, ""), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([(5, a + " end"), (8, b), (-1, a), (-1, c), (-1, ""), (9, "")])


def test_least_matches_follow_the_posterior():
    steps = minhash.least_matches(0.85)
    assert [n for n, _ in steps] == [32, 64, 96, 128] and all(0.4 * n < m < 0.85 * n for n, m in steps)


def test_base_identifiers_against_plain_expressions(spark):
    texts = ["a@b.c_d@e.f x..y@z.q. 1.2.3.4.5.6.7.8 999.1.1.1 É 4111 1111-1111 1111, +1 (017) 555-7713 ok", "😀 mail me@x.org+2 a@b", "0001.2.3.255 +12 +1 2345678.9 ", None, "", "7" * 3000 + "@", "a" * 20000, "4111111111111111" * 3, "+1 ....", "x@y-.z. ++1 234567890"]
    got = pii.find(frame(spark, texts)).collect()
    by = {r.id: [(s.kind, s.start, s.end) for s in r.base] for r in got}
    assert by == {i: base_of(t) for i, t in enumerate(texts)}


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1", "at 0.0.0.0, 00.1.1.1 and 127.0.0.1", "192.168.0.1 000.00.0.0255 0256.0.0.1 0.0.0.256", "0" * 3000 + ".0.0." + "0" * 3000 + "9"]
    by = {r.id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find(frame(spark, texts)).collect()}
    assert by == {i: base_of(t) for i, t in enumerate(texts)} and [len(by[i]) for i in range(4)] == [1, 3, 2, 1]


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"please reach phone: +1 (0{k:02d}) 555-{1000 + k} now" for k in range(12)]
    texts = [*seeds, "reach phone: 555 123 9876 now", "version: 555 123 9876 now", "nothing here"]
    got = {r.id: [(s.kind, s.start) for s in r.spans] for r in pii.find(frame(spark, texts)).collect()}
    assert got[12] == [("phone", 13)] and got[13] == [] and got[14] == []


def test_masking(spark):
    row = spark.createDataFrame([("ab me@x.org cd",)], "t string").select(pii.masked(F.col("t"), F.expr("array(named_struct('start', 3L, 'rank', 0, 'kind', 'email', 'end', 11L))"))).first()
    assert row[0] == "ab <email> cd"


def test_token_shards_round_trip():
    out, rng = io.BytesIO(), np.random.default_rng(1)
    docs = [(k, rng.integers(0, 50_000, n).astype("<u4")) for k, n in enumerate([5, 0, 4000, 1, 300_000])] + [(None, np.array([2], "<u4"))]
    writer = tokenbin.ShardWriter(out, frame_bytes=8000)
    for k, ids in docs:
        writer.add(k, ids.tobytes())
    writer.close()
    reader = tokenbin.ShardReader(out)
    assert [(k, zlib.crc32(v)) for k, v in reader.documents()] == [(k, zlib.crc32(v)) for k, v in docs]
    assert [v.tolist() for _, v in reader.documents([3])] == [docs[3][1].tolist()]
    out.seek(3)
    out.write(b"\xff\xff")
    with pytest.raises(Exception):
        list(tokenbin.ShardReader(out).documents())


def test_chunked_encoding_equals_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    texts = ["It's á TEST of  ÉCOLE…", "", " x\n\ny ", "<|endoftext|> a<|startoftext|>", "naïve 12.5% don't\tстоп", "a\x1cb"]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenbin.ChunkEncoder(path).encode(texts)] == [e.ids for e in want]


def test_plain_parts_are_encoded_together(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    every = "".join(chr(c) for c in [9, 10, 11, 12, 13, *range(32, 127), *range(192, 256)] if c not in (215, 247))
    texts = ["0", "0 0 x0 10 0s", "it's 0're ''s don't", every, " ".join(every), every[::-1], *[" ".join(prose(50, k)) for k in range(150)], "Стоп 0 x"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoder, calls, own = tokenbin.ChunkEncoder(path), [], tokenbin.ChunkEncoder._ids
    monkeypatch.setattr(tokenbin.ChunkEncoder, "_ids", lambda self, parts: calls.extend(parts) or own(self, parts))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    # The full rules run for other texts and for the part that stands between.
    assert set(calls) == {"0", "Стоп"}


def test_transducer_equals_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    texts = ["", "a    b", "  ", "\n\n  x", "x" + " " * 40 + "y", "日本語 😀 nb\tTab", "def f(x):\n    return x_1+2", "12345 67.89 ².5", "á̂b ſß\x00", "the" * 50, " lead\n trail ", "A.B.C...D +++--"]
    fst, lib = sentencepiece_fst.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [np.frombuffer(fst.encode(t), "<i4") for t in texts]
    assert [x.tolist() for x in ids] == lib.encode(texts)
    assert [fst.decode(x) for x in ids] == texts
    rows = sentencepiece_fst.decode(sentencepiece_fst.encode(frame(spark, [*texts, None]), path), path).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == [*texts, ""]


def test_license_expressions():
    assert licenses.evaluate(licenses.postfix("(MIT OR GPL-2.0) AND Apache-2.0 WITH x rest"))[1] == {"mit", "gpl-2.0", "apache-2.0"}
    assert licenses.evaluate(licenses.postfix("MIT OR GPL-2.0"))[2] and not licenses.evaluate(licenses.postfix("MIT AND GPL-2.0"))[2]
    assert licenses.postfix("MIT OR") == ["MIT"] and licenses.postfix("OR MIT") == [] and licenses.postfix("") == []
    matcher = phrases.automaton("t", licenses.patterns())
    row = licenses.scan_text(b"CC-BY cc by; General  Public LICENSE. All rights\nreserved", matcher)
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (4, 0, 7, ["cc-by", "gpl", "reserved"])


def test_html_blocks_and_extraction(spark):
    page = '<title>t</title><nav>menu</nav><article><h1>Head</h1><p>a&amp;b<b>c</b><div class="ad">buy</div><p>d&nbsp; e<script>"</p>"</script></article><footer>f</footer>'
    assert [b.text for b in blocks(page) if b.main and not b.furniture] == ["Head", "a&bc", "d e"]
    shared = "this very long notice stands on each of the pages here"
    rows = [(1, "http://h/1", page), (2, None, None), *[(k, f"http://h/{k}", f"<div>{shared}</div><div>w{k} text {k}</div>") for k in (3, 4, 5, 6)], (6, "http://h/6", f"<div>{shared}</div><div>w6 text 6</div>"), (7, "http://h/7", "<article><p>" + shared + "</p></article>")]
    got = sorted((r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "Head a&bc d e"), (2, ""), (3, "w3 text 3"), (4, "w4 text 4"), (5, "w5 text 5"), (6, "w6 text 6"), (6, "w6 text 6"), (7, shared)]


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class=no-comments", "div id='nav-fixed'", "div class='post share-enabled'", "div class=sidebar", "form action='/'", "section class='widget'><div class='nav menu'"])
def test_articles_in_wrappers_named_like_furniture(wrapper):
    page = f"<{wrapper}><nav>n</nav><article class='post has-comments'><header>Head</header><p>body</p><div class='ad'>buy</div><div id='ad-2' class=x>b</div><form>f</form><div class='share cookie-banner'>s</div></article><aside><article>other</article></aside></div>"
    assert [b.text for b in blocks(page) if b.main and not b.furniture] == ["Head", "body"]
    assert [b.text for b in blocks("<article class='comments'>a</article><div class='sidebar'>b</div><main class='widget'>c</main><article hidden>d</article>") if b.main and not b.furniture] == ["a", "c"]


def test_copies_of_unmarked_pages_count_once_in_any_partitioning(spark):
    text = "a page without an article whose exact copies stand at many places of a host"
    shared = "this very long notice stands on each of the pages here"
    rows = [(k, "http://h/same", f"<div>{text}</div>") for k in range(8)] + [(k, f"http://h/{k}", f"<div>{shared}</div><div>w{k} text</div>") for k in range(8, 12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 12):
        got = {r.page_id: r.text for r in html_extract.extract(pages.repartition(parts)).collect()}
        assert got == {k: text if k < 8 else f"w{k} text" for k in range(12)}


def test_suffix_array_grams_against_counting():
    rng = random.Random(5)
    streams = [[rng.choice("ab") for _ in range(40)] for _ in range(5)]
    want: dict = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - 7):
            want.setdefault(tuple(s[i : i + 8]), set()).add(p)
    assert {tuple(streams[p][i : i + 8]): n for p, i, n in html_extract.repeated(streams)} == {k: len(v) for k, v in want.items()}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000), (None, "u", "<p>é"), (2, "again", "<p>é")]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch.fresh_dir(spark, "warc-test"))
    got = warc.read(spark, archives).collect()
    payload = {r.page_id: bytes(r.payload) for r in got if r.payload is not None}
    assert sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in got) == [(-1, "revisit", 2, 5), (1, "revisit", 2, 5), (2, "response", None, 5), (2, "response", None, 5), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 300_000)]
    assert payload[2] == "<p>é".encode() and payload[5] == b"z" * 300_000
    damaged = bytearray(warc.record(1, "u", b"abc", None, False))
    with pytest.raises(Exception):
        damaged[-9] ^= 255
        list(warc.read_records(io.BytesIO(bytes(damaged))))


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 8))
    vectors[100:140] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0]), (2080, [None] * 8), (7, vectors[7].tolist())]
    got: dict = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, max_leaves=32).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 1500, 20)) and got[0][1:] == sorted(got[0][1:])
    hits = total = 0
    for q, found in got.items():
        scores = (vectors * vectors[q]).sum(1)
        best = [i for i in sorted(range(1500), key=lambda i: (-scores[i], i)) if i != q][:20]
        hits += len(set(best) & set(found))
        total += 20
        assert len(found) == len(set(found)) == 20 and q not in found
    assert hits / total >= 0.9


def test_nearest_finds_enough_beyond_small_leaves(spark):
    rng = np.random.default_rng(4)
    # Tight clusters that fill their leaves, one of a repeated id, and one row far out.
    middles = rng.normal(size=(40, 6)) * 30
    vectors = np.concatenate([m + rng.normal(size=(15, 6)) * 0.01 for m in middles])
    vectors[0] = 40 * np.ones(6)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(700, (1000 * np.eye(6)[0] + rng.normal(size=6) * 0.01).tolist()) for _ in range(60)]
    got: dict = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, target=0.0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {*range(0, 600, 20), 700}
    assert all(len(found) == len(set(found)) == 20 and q not in found for q, found in got.items())


def test_quality_separates_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    rows = queries.op2_quality(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    blank = quality.score(frame(spark, [None, "", "x" * 300_000]), quality.fit(np.zeros((0, quality.WIDTH), np.float32), np.zeros(0))).collect()
    assert [r.score for r in blank] == [0.5, 0.5, 0.5]


def test_items_digest_of_clean_documents(spark):
    rows = queries.op1_decontaminate(spark, "/root/testdata/sf0.001").filter("not contaminated").limit(1).collect()
    assert rows[0].items_sha256 == hashlib.sha256(b"").hexdigest()

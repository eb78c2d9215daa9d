"""Near-duplicate detection: banded MinHash with sequential Bayesian verification.

1. Every text is turned into its set of word shingles, a 128-bit fingerprint of
   the set and a signature of ``HASHES`` minima.  Texts with equal sets form a
   class, represented by its smallest document id.
2. Signatures are cut into bands so that a pair at the threshold shares no band
   with probability ``MISS`` at most.  In each shared band every representative is
   paired with the smallest one there: a star, not all pairs.
3. A pair's signatures are compared in batches; after each batch the pair is
   dropped if the posterior probability of reaching the threshold, from a uniform
   prior, is below ``MISS``.
4. Survivors are verified exactly on their full sets; verified links form
   components.
5. Bands that still hold several components are searched fully: their members are
   dealt into tiles of bounded size, each tile verifies its pairs of different
   components as in 3 and 4 and reports only links that join components.

Links are therefore found between all texts that share a band, while rows stay
linear in the documents.

Defined results: null text, empty text and text of white space have an empty set,
``n_shingles`` 0, and are linked with nothing; fewer words than a shingle form one
shingle; rows that share a document id are one document and share their links; a
null document id is linked with nothing, has a null component and is kept; ties go
to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import scratch
from larkspur.llm.components import components
from larkspur.llm.words import binary_texts

HASHES = 128
BATCH = 32
MISS = 1e-6
TILE = 512
#: log2 of the bits of the candidate filter; 16 MB whatever the input.
FILTER_BITS = 27

_rng = np.random.default_rng(20240131)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Words hashed at a time; bounds the temporary arrays of a very long text.
_STRIP = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: Powers of an odd base, for hashes of byte runs from prefix sums.
_base = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(1 << 16, _base, np.uint64))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word, in order."""
    words = text.lower().split()
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(words), _STRIP):
        part = words[at : at + _STRIP]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        long = {int(i): int.from_bytes(blake2b(part[i], digest_size=8).digest(), "little") for i in np.flatnonzero(lengths > len(_POWERS))}
        for i in long:
            part[i], lengths[i] = b"-", 1
        body = np.frombuffer(b"".join(part), np.uint8).astype(np.uint64)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(body)) - np.repeat(starts, lengths)
        hashes = np.add.reduceat((body + np.uint64(1)) * _POWERS[place], starts)
        for i, value in long.items():
            hashes[i] = value
        out.append(hashes)
    return _mixed(np.concatenate(out))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = word_hashes(text or b"")
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        total = _mixed(total * _ODD + words[k : k + n] + np.uint64(k + 1))
    return np.unique(total)


def fingerprint(items: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return np.array([items.sum(dtype=np.uint64) + np.uint64(len(items)), _mixed(items * _ODD).sum(dtype=np.uint64)], "<u8").tobytes()


def signature(items: np.ndarray) -> np.ndarray:
    low = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        block = low[at : at + 256, None] * _MULTIPLY + _ADD
        block ^= block >> np.uint32(15)
        block *= np.uint32(0x2C1B3C6D)
        np.minimum(out, block.min(0), out=out)
    return out


def banding(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the longest rows that lose a pair at the threshold rarely enough."""
    rows = max(r for r in range(1, HASHES + 1) if r == 1 or (1 - threshold**r) ** (HASHES // r) <= miss)
    return rows, HASHES // rows


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after each batch.

    With a uniform prior the similarity after m of n matches is Beta(m+1, n-m+1);
    P(similarity >= t) is then a binomial tail.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, needed = 0.0, 0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                needed = m
                break
        out.append((n, needed))
    return out


def survive(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signatures (row by row) pass every batch."""
    alive, matches, before = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, needed in steps:
        matches[alive] += (a[alive, before:n] == b[alive, before:n]).sum(1)
        alive, before = alive[matches[alive] >= needed], n
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, prints, signatures = [], [], []
        for text in binary_texts(batch.column(1)):
            items = shingles(text, size)
            counts.append(len(items))
            prints.append(fingerprint(items) if len(items) else None)
            signatures.append(signature(items).tobytes() if len(items) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n", "print", "signature"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        total = np.full(len(signatures), b + 1, np.uint64) * _ODD
        for k in range(rows):
            total = _mixed(total * _ODD + signatures[:, b * rows + k])
        keys[:, b] = total
    return keys.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch], rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column(1)), rows, bands)
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], ["key", "id"])


def _compared(batches: Iterator[pa.RecordBatch], steps) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            alive = pa.array(survive(_matrix(batch.column(2)), _matrix(batch.column(3)), steps))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], ["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch], size: int, bits) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the documents that the filter may hold."""
    held = bits.value
    for batch in batches:
        hashes = batch.column(2).to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
        wanted = np.flatnonzero((held[hashes >> np.uint64(3)] >> (hashes & np.uint64(7)).astype(np.uint8)) & 1)
        for at in range(0, len(wanted), 1000):
            rows = pa.array(wanted[at : at + 1000])
            items = [shingles(x, size) for x in binary_texts(batch.column(1).take(rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([fingerprint(x) for x in items], pa.binary()), pa.array([x.tobytes() for x in items], pa.binary())], ["doc", "print", "items"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        keep = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["u", "v"])


def tile_links(ids: np.ndarray, labels: np.ndarray, signatures: np.ndarray, items: list[bytes], sides: np.ndarray, key: int, rows: int, bands: int, percent: int, steps) -> list[tuple[int, int]]:
    """Links that join components within one tile.

    ``sides`` has bit 1 for members of the first block and bit 2 for the second;
    pairs are taken across the sides.  A pair that shares an earlier band than
    ``key`` is left to the tile of that band.
    """
    keys = band_keys(signatures, rows, bands)
    band = int(np.flatnonzero((keys == key).all(0))[0])
    parent = {int(x): int(x) for x in np.unique(labels)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sets = [np.frombuffer(x, np.uint64) for x in items]
    out = []
    right = np.flatnonzero(sides & 2)
    for i in np.flatnonzero(sides & 1):
        own = root(int(labels[i]))
        others = right[ids[right] > ids[i]] if (sides[i] & 2) else right
        others = others[[root(int(x)) != own for x in labels[others]]] if len(others) else others
        if band and len(others):
            others = others[~(keys[others, :band] == keys[i, :band]).any(1)]
        for j in others[survive(np.broadcast_to(signatures[i], (len(others), HASHES)), signatures[others], steps)] if len(others) else ():
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a != b and linked(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _candidate_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id, items of the wanted representatives (id, doc, print).

    A fixed-size bit filter lets one pass over the texts build sets for the wanted
    documents and few others; a join then keeps exactly the wanted ones.
    """
    spark = docs.sparkSession
    places = wanted.select(F.expr(f"xxhash64(doc) & {(1 << FILTER_BITS) - 1}L").alias("h"))
    words = places.groupBy(F.expr("h div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63L as int)))").alias("bits"))
    held = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found = words.toArrow()
    held[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    bits = spark.sparkContext.broadcast(held.view(np.uint8))

    def task(batches):
        return _sets(batches, size, bits)

    sets = docs.select("id", "text", F.xxhash64("id").alias("h")).filter("id is not null").mapInArrow(task, "doc long, print binary, items binary")
    return scratch.cut(wanted.join(sets, ["doc", "print"]).dropDuplicates(["id"]).select("id", "items"))


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Texts are linked if 100 * intersection >= percent * union of their shingle
    sets; ``component_id`` is the smallest document id that links reach.
    """
    scratch.bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows, bands = banding(percent / 100)
    steps = least_matches(percent / 100)

    def signed(batches):
        return _signed(batches, shingle)

    def banded(batches):
        return _banded(batches, rows, bands)

    def compared(batches):
        return _compared(batches, steps)

    def verified(batches):
        return _verified(batches, percent)

    signatures = scratch.cut(docs.mapInArrow(signed, "id long, n long, print binary, signature binary"))
    usable = signatures.filter("id is not null and n > 0")
    classes = usable.groupBy("print").agg(F.min("id").alias("rep"))
    # Representatives: the join key holds the id, so a class of many copies is spread.
    # ``id`` names the class, ``doc`` is its smallest document id.
    reps = scratch.cut(usable.join(classes.select(F.col("print").alias("p"), F.col("rep")), (F.col("print") == F.col("p")) & (F.col("id") == F.col("rep"))).select("id", F.col("id").alias("doc"), "print", "signature").dropDuplicates(["print", "id"]))
    # Ids of rows with several texts may be the smallest of several classes; classes
    # then get numbers of their own, and links are named by document for components.
    several = scratch.cut(usable.groupBy("id").agg(F.min("print").alias("least"), F.max("print").alias("most")).filter("least <> most").select("id"))
    torn = not several.isEmpty()
    if torn:
        reps = scratch.cut(reps.select(F.monotonically_increasing_id().alias("id"), "doc", "print", "signature"))

    def by_document(edges: DataFrame) -> DataFrame:
        if not torn:
            return edges
        u, v = (reps.select(F.col("id").alias(f"class_{x}"), F.col("doc").alias(f"doc_{x}")) for x in "uv")
        return edges.join(u, F.col("u") == F.col("class_u")).join(v, F.col("v") == F.col("class_v")).select(F.col("doc_u").alias("u"), F.col("doc_v").alias("v"))

    spread = reps.select("id", "signature").mapInArrow(banded, "key long, id long")
    stars = spread.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("far")).filter("hub <> far").select("key", "hub")
    # A band may hold very many representatives, so joins on bands are dealt in shares.
    shared = scratch.cut(scratch.dealt(spread, stars, ["key"], "id").select("key", "hub", "id"))
    pairs = shared.filter("hub <> id").groupBy(F.col("hub").alias("u"), F.col("id").alias("v")).agg(F.lit(1).alias("one")).select("u", "v")
    short = reps.select(F.col("id").alias("s"), "signature")
    both = pairs.join(short, F.col("u") == F.col("s")).select("u", "v", F.col("signature").alias("a")).join(short, F.col("v") == F.col("s")).select("u", "v", "a", F.col("signature").alias("b"))
    likely = scratch.cut(both.mapInArrow(compared, "u long, v long"))
    # Bands with two members or fewer are settled by their star.
    crowded = shared.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 2").select("key")
    wanted = likely.select(F.col("u").alias("id")).unionByName(likely.select(F.col("v").alias("id"))).unionByName(scratch.dealt(shared, crowded, ["key"], "id", how="left_semi").select("id")).distinct()
    sets = _candidate_sets(docs, reps.select("id", "doc", "print").join(wanted, "id", "left_semi"), shingle)
    side = sets.select(F.col("id").alias("s"), "items")
    texts = likely.join(side, F.col("u") == F.col("s")).select("u", "v", F.col("items").alias("a")).join(side, F.col("v") == F.col("s")).select("u", "v", "a", F.col("items").alias("b"))
    links = by_document(scratch.cut(texts.mapInArrow(verified, "u long, v long")))
    if torn:
        links = links.unionByName(usable.join(several, "id", "left_semi").join(classes, "print").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct())
    first = scratch.cut(components(links))
    labels = first
    if torn:
        by_doc = first.select(F.col("node").alias("d"), "component")
        labels = reps.join(by_doc, F.col("doc") == F.col("d"), "left").select(F.col("id").alias("node"), F.coalesce("component", "doc").alias("component"))
    more = _rest(shared, crowded, labels, reps, sets, rows, bands, percent, steps)
    final = components(links.unionByName(by_document(more))) if not more.isEmpty() else first
    named = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    joined = signatures.select("id", "n", "print").join(named, "print", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return joined.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _rest(shared: DataFrame, crowded: DataFrame, found: DataFrame, reps: DataFrame, sets: DataFrame, rows: int, bands: int, percent: int, steps) -> DataFrame:
    """Links between different components of crowded bands that no star tested."""
    labelled = scratch.dealt(shared, crowded, ["key"], "id", how="left_semi").filter("hub <> id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    labelled = scratch.cut(labelled)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("members")).filter("a <> b").select("key", F.ceil(F.col("members") / TILE).cast("int").alias("blocks"))
    members = scratch.dealt(labelled, mixed, ["key"], "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A member stands in the tiles of its own block with every block.
    dealt = members.select("key", "id", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", "id", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    full = dealt.join(reps.select("id", "signature"), "id").join(sets, "id")

    def tile(table: pa.Table) -> pa.Table:
        found = tile_links(
            table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("signature").combine_chunks()), table.column("items").to_pylist(), table.column("side").to_numpy(), table.column("key")[0].as_py(), rows, bands, percent, steps
        )
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return scratch.cut(full.groupBy("key", "i", "j").applyInArrow(tile, "u long, v long"))

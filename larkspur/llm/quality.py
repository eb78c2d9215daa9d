"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Each whole text becomes a term vector: hashed byte trigrams of the lower-cased
text, and structural terms (thermometer codes of letter case, symbols, digits,
repeated words and repeated lines).  A truncated singular value decomposition of
at most ``max_train`` labelled vectors gives the latent space; the labelled latent
vectors are broadcast (``max_train * dims`` floats at most) and every document is
compared with all of them in exact blocked cosine products.  The labels of the
``k`` nearest vote, weighted by a power of their similarity.

Defined results: null text counts as empty and is still scored; rows with a null
label or id do not teach, rows that repeat a label are averaged, of documents that
repeat a labelled id the one with the least term vector teaches; without any label
every score is 0.5; ties between neighbours go to the earlier training row, in byte
order of the term vectors; repeated document rows are each scored; other columns are passed through,
and one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import scratch
from larkspur.llm.words import binary_texts

HASHED = 1024
MAX_TRAIN = 4000
DIMS = 64
NEIGHBOURS = 11
SHARPNESS = 8
STRUCTURE_WEIGHT = 1.0
#: Rows compared at a time; bounds the similarity block.
BLOCK = 512
#: Bytes hashed at a time; bounds the temporary arrays of a very long text.
STRIP = 1 << 20

#: Steps of each thermometer code.
STEPS = {
    "upper": (0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8),
    "symbol": (0.005, 0.015, 0.03, 0.045, 0.06, 0.08, 0.1, 0.13, 0.17, 0.22, 0.3),
    "digit": (0.02, 0.05, 0.1, 0.2, 0.4),
    "repeat": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98),
    "run": (0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8),
    "lines": (0.05, 0.15, 0.3, 0.45, 0.6, 0.8),
    "length": (1, 4, 16, 64, 256, 1024, 4096),
}
WIDTH = HASHED + sum(map(len, STEPS.values()))

_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_LETTER | _DIGIT)


def _shares(text: bytes, counts: np.ndarray) -> dict[str, float]:
    size = max(1, len(text))
    words = text.lower().split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x]
    runs = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    distinct = len(set(words))
    # A long clean text repeats its common words; the expected share of distinct
    # words falls slowly with length, so it is compared with a power of it.
    expected = n**0.9 if n else 1.0
    return {
        "upper": counts[_UPPER].sum() / max(1, counts[_LETTER].sum()),
        "symbol": counts[_SYMBOL].sum() / size,
        "digit": counts[_DIGIT].sum() / size,
        "repeat": 1 - min(1.0, distinct / expected) if n else 0.0,
        "run": runs / max(1, n),
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "length": n,
    }


def term_vector(text: bytes | None) -> np.ndarray:
    """Term frequencies of one whole text, before inverse document weights."""
    text = text or b""
    out = np.zeros(WIDTH, np.float32)
    counts = np.zeros(256, np.int64)
    grams = np.zeros(HASHED, np.int64)
    low = np.frombuffer(text.lower(), np.uint8)
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(text), STRIP):
        counts += np.bincount(raw[at : at + STRIP], minlength=256)
        part = low[at : at + STRIP + 2].astype(np.uint32)
        if len(part) > 2:
            key = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            key *= np.uint32(2654435769)
            grams += np.bincount(key >> np.uint32(22), minlength=HASHED)
    out[:HASHED] = np.log1p(grams)
    shares, at = _shares(text, counts), HASHED
    for name, steps in STEPS.items():
        out[at : at + len(steps)] = np.greater_equal(shares[name], steps)
        at += len(steps)
    return out


@dataclass
class Model:
    """What a scoring task needs: term weights, projection, latent rows, labels."""

    weights: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    labels: np.ndarray
    k: int = NEIGHBOURS

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = _weighted(terms, self.weights) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        k = min(self.k, len(self.labels))
        cosines = self.project(terms) @ self.latent.T
        near = self._nearest(cosines, k)
        votes = np.clip(np.take_along_axis(cosines, near, 1), 1e-3, 1).astype(np.float64) ** SHARPNESS
        return np.clip((votes * self.labels[near]).sum(1) / votes.sum(1), 0, 1)


    @staticmethod
    def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
        """The k nearest training rows of each line, ties to the earlier row."""
        if k == cosines.shape[1]:
            return np.broadcast_to(np.arange(k), cosines.shape)
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cosines, near, 1).min(1, keepdims=True)
        # A partition keeps any of the rows that tie at its border.
        for i in np.flatnonzero((cosines >= least).sum(1) > k):
            near[i] = np.argsort(-cosines[i], kind="stable")[:k]
        return near


def _weighted(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = terms * weights
    grams = out[:, :HASHED]
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-12)
    out[:, HASHED:] *= STRUCTURE_WEIGHT / np.sqrt(WIDTH - HASHED) * 3
    return out


def fit(terms: np.ndarray, labels: np.ndarray, dims: int = DIMS, k: int = NEIGHBOURS) -> Model:
    """Latent-semantic model of labelled term vectors."""
    if not len(labels):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)
    seen = (terms > 0).sum(0)
    weights = (np.log((1 + len(terms)) / (1 + seen)) + 0.1).astype(np.float32)
    weights[HASHED:] = 1
    matrix = _weighted(terms, weights)
    values, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    top = np.argsort(-values)[: min(dims, len(labels))]
    model = Model(weights, vectors[:, top].astype(np.float32), np.zeros((0, len(top)), np.float32), labels.astype(np.float64), k)
    model.latent = model.project(terms)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _terms_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.ascontiguousarray(term_vector(x), "<f4").tobytes() for x in binary_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["label", "id", "terms"])


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, **options) -> Model:
    """Model from at most ``max_train`` labelled rows outside the held-out fold.

    The rows are the first in the order of a hash of their ids, so the sample
    does not depend on how the tables are laid out.
    """
    scratch.bounded_batches(docs.sparkSession)
    taught = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.avg("label").alias("label"))
        .filter(~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train)
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(taught), "id")
    vectors = texts.select("label", "text", F.xxhash64("id").alias("id")).mapInArrow(_terms_only, "label double, id long, terms binary")
    rows = vectors.groupBy("id").agg(F.min(F.struct("terms", "label")).alias("least")).select("least.*").collect()
    found = sorted((bytes(r.terms), r.label) for r in rows)
    terms = np.frombuffer(b"".join(t for t, _ in found), "<f4").reshape(-1, WIDTH) if found else np.zeros((0, WIDTH), np.float32)
    return fit(terms, np.array([x for _, x in found]), **options)


def _score(batches: Iterator[pa.RecordBatch], text: str, out: str, shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for batch in batches:
        texts = binary_texts(batch.column(batch.schema.get_field_index(text)))
        parts = [model.score(np.stack([term_vector(x) for x in texts[a : a + BLOCK]])) for a in range(0, len(texts), BLOCK)]
        scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        keep = [i for i, name in enumerate(batch.schema.names) if name != out]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), scores], [*(batch.schema.names[i] for i in keep), out])


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column: 0 to 1, higher where label 1 is likelier."""
    scratch.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def task(batches):
        return _score(batches, text, out, shared)

    return docs.mapInArrow(task, schema)

"""Quality classification by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from columnade.llm.common import batch, bounded_sample, map_batches

#: Terms: hashed word cores, then hashed word shapes, then one for a word that repeats the one before it.
_CORES, _SHAPES = 2048, 1024
TERMS = _CORES + _SHAPES + 1
_REPEAT = TERMS - 1
_MEMO = 500_000
_RUNS = re.compile(rb"(AA)A+|(aa)a+|(00)0+")
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_TERM_ROWS = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.float32()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def _terms(words: list[bytes]) -> np.ndarray:
    """The core (letters and digits, lower case) and the shape (classes of characters, runs cut to two) of each word, hashed."""
    together = b"\n".join(words)
    shapes = _RUNS.sub(rb"\1\2\3", together.translate(_CLASS)).split(b"\n")
    cores = [w.strip(_MARKS) for w in together.lower().split(b"\n")]
    out = np.empty((len(words), 2), np.int32)
    out[:, 0] = np.fromiter(map(zlib.crc32, cores), np.uint32, len(words)) % _CORES
    out[:, 1] = _CORES + np.fromiter(map(zlib.crc32, shapes), np.uint32, len(words)) % _SHAPES
    return out


class Terms:
    """Term numbers of words, remembered."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((4096, 2), np.int32)

    def _learn(self, new: list[bytes]) -> None:
        first = len(self.at)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(new)] = _terms(new)
        self.at.update(zip(new, range(first, first + len(new)), strict=True))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How often each term (column) occurs in each text (row)."""
        if len(self.at) > _MEMO:
            self.at.clear()
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        new = [w for w in set().union(*split) if w not in self.at]
        if new:
            self._learn(new)
        out = np.zeros((len(texts), TERMS), np.float32)
        for k, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
                out[k] = np.bincount(self.rows[at].ravel(), minlength=TERMS)
                out[k, _REPEAT] += np.count_nonzero(at[1:] == at[:-1])
        return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights; that of repetition is the share of words that repeat the one before, three times the rest's length."""
    x = np.log1p(counts) * idf
    x[:, _REPEAT] = 3 * counts[:, _REPEAT] / np.maximum(counts[:, :_CORES].sum(1), 1) * np.linalg.norm(x[:, :_REPEAT], axis=1)
    return x


@dataclass
class Neighbours:
    """Labelled vectors in the latent space (unit length), their labels, and the map into it."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Documents' term counts (rows) to unit vectors; no term: zero."""
        x = weighed(counts, self.idf) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, by a weight that grows with the cosine.

        Labelled vectors as near as the last of the k nearest all vote, so that
        ties need no order.
        """
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cos = x @ self.vectors.T
        k = min(self.k, cos.shape[1])
        last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
        row, near = np.nonzero(cos >= last[:, None])
        weight = np.maximum(cos[row, near], 0.0).astype(np.float64) ** 8
        good, all_ = (np.bincount(row, w, len(x)) for w in (weight * self.labels[near], weight))
        return (good + 0.05 * self.prior) / (all_ + 0.05)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, dims: int = 64, k: int = 15) -> Neighbours:
    """Learn from at most ``rows`` labelled documents, chosen by a hash of doc_id.

    Several labels of one document: their mean, 1 from a half on. Null labels
    and ids teach nothing. What reaches the driver (and is broadcast after) is
    bounded by rows x terms. No labelled row: every score is 0.5.
    """
    mean = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    chosen = bounded_sample(mean, "doc_id", rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                found = terms.counts(b.column(2).slice(i, 256).to_pylist())
                held = [np.flatnonzero(c) for c in found]
                yield batch(_TERM_ROWS, b.column(0).slice(i, 256), b.column(1).slice(i, 256), [h.astype(np.int32) for h in held], [c[h] for c, h in zip(found, held, strict=True)])

    got = sorted(map_batches(texts, run, "doc_id long, quality double, terms array<int>, counts array<float>").collect(), key=lambda r: (r.doc_id, r.terms))
    if not got:
        return Neighbours(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, k)
    counts = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        counts[i, r.terms] = r.counts
    y = np.array([float(r.quality >= 0.5) for r in got])
    idf = (np.log((1 + len(got)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    a = weighed(counts, idf)
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(7)
    q = rng.standard_normal((TERMS, min(dims + 16, TERMS))).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    model = Neighbours(idf, (q @ vt.T[:, :dims]).astype(np.float32), np.zeros((0, 1), np.float32), y, float(y.mean()), k)
    model.vectors = model.project(counts).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Neighbours, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text.

    Cosines with every labelled vector are exact and made block by block. A
    null or empty text has the zero vector, and so the labelled rows' share of
    label 1. Neighbours that tie with the last of the nearest vote too. Repeated rows give repeated rows; a null doc_id stays null; no
    rows give no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), held.value
        for b in batches:
            texts = b.column(1)
            for i in range(0, len(texts), 256):
                score = np.clip(m.score(m.project(terms.counts(texts.slice(i, 256).to_pylist()))), 0.0, 1.0)
                yield batch(_OUT, b.column(0).slice(i, 256), score, (score >= threshold).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Neighbours, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns, of any name but a second ``text``) whose text scores ``threshold`` or more.

    Null and empty texts score the labelled rows' share of label 1. Repeated
    rows stay or go together; no rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), held.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array(m.score(m.project(terms.counts(part.column(at).to_pylist()))) >= threshold))

    return map_batches(docs, run, docs.schema)

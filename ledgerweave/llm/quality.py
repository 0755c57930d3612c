"""Quality by nearest-neighbour voting over latent-semantic vectors.

A score is a function of the text to the last bit: term weights, axes and vectors are whole numbers (in float64), so
scaled that all sums stay below 2^53 and are exact in any order; what is not a sum is one correctly rounded operation.

Terms of a document are the shapes of its tokens (letter case, digits and marks, runs collapsed), its lower-cased
word, and whether it repeats the token before, hashed to ``TERMS`` columns. Document frequencies are counted over all documents. The latent space is the
truncated SVD of the weighted terms of a bounded sample of labelled documents; their vectors and labels are
broadcast (at most MOST_LABELLED, of DIMENSIONS numbers, whatever the input), and every document's cosine with all of them is
computed exactly, block by block. The score is the mean label of the nearest, weighted by similarity.

Null and empty texts have no terms and score the share of label 1 in the sample, as do all texts when nothing is
labelled (then 0.5). Of neighbours with equal cosines those that come first in the sample (by doc_id) vote. Rows with a null doc_id are scored, with a null held_out. Ids, labels, lang and source are no
inputs of a score. Texts of any length are scored whole; repeated rows, and rows with equal texts, get equal scores; a
score of exactly 0.5 counts as label 1. Other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import chunked
from .labelled import sample
from .words import span_hashes, spans

#: Hashed term columns, latent dimensions, neighbours that vote.
TERMS, DIMENSIONS, NEIGHBOURS = 4096, 48, 21
#: Labelled vectors of each label, at most.
MOST_LABELLED = {0: 2048, 1: 2048}
#: Weight of a shape against a word, and columns that shapes have for themselves.
SHAPE_WEIGHT, SHAPE_TERMS = 2.0, 1024

#: Steps of 1 in logarithms of counts, in inverse document frequencies and in axes; length of vectors.
COUNT_STEPS, IDF_STEPS, AXIS_STEPS, UNIT = 1 << 10, 1 << 7, 1 << 12, 1 << 20

_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term column) of every token: its shape, its word, and column 0 if it repeats the one before."""
    starts, ends = spans(data, at)
    doc = np.searchsorted(at, starts, side="right") - 1
    kind = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hashes(kind[keep], place[starts], place[ends], None) % np.uint64(SHAPE_TERMS - 1) + np.uint64(1)
    word = span_hashes(data, starts, ends)
    again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1])) + 1
    word = word % np.uint64(TERMS - SHAPE_TERMS) + np.uint64(SHAPE_TERMS)
    return np.concatenate([doc, doc, doc[again]]), np.concatenate([shape, word, np.zeros(len(again), np.uint64)]).astype(np.int64)


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    doc, term = terms(data, at)
    n = len(at) - 1
    return np.bincount(doc * TERMS + term, minlength=n * TERMS).reshape(n, TERMS)


_LOGARITHM = np.array([round(math.log1p(n) * COUNT_STEPS) for n in range(1 << 16)], float)


def whole_weights(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights as whole numbers below 2^29: a table gives the logarithms, so that they hang on nothing but the count."""
    out = _LOGARITHM[np.minimum(count, len(_LOGARITHM) - 1).astype(np.int64)]
    for at in zip(*np.nonzero(count >= len(_LOGARITHM)), strict=True):
        out[at] = round(math.log1p(float(count[at])) * COUNT_STEPS)
    return out * idf


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each term, over all rows, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch, data, at in chunked(batches):
            doc, term = terms(data, at)
            total[:TERMS] += np.bincount(np.unique(doc * TERMS + term) % TERMS, minlength=TERMS)
            total[TERMS] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(total)], ["term", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # TERMS + 1 rows
    out = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


@dataclass
class Neighbours:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, count: np.ndarray) -> np.ndarray:
        """Whole-number vectors of length UNIT, or zeros."""
        x = whole_weights(count, self.idf) @ self.axes  # below 2^29 * 64 * 2^12 = 2^47
        x = np.rint(x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1) * UNIT)
        return np.rint(x * UNIT / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1))

    def score(self, count: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(count), self.prior)
        filled = np.flatnonzero(count.any(axis=1))
        if not len(self.labels):
            return out
        k = min(k, len(self.labels))
        for i in range(0, len(filled), 256):
            rows = filled[i : i + 256]
            cosine = self.latent(count[rows]) @ self.vectors.T
            key = cosine.astype(np.int64) * len(self.labels) - np.arange(len(self.labels))  # no two are equal
            near = np.argpartition(key, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) / (UNIT * UNIT)
            weight = weight * weight
            weight = np.rint(weight * weight * 2.0**40) + 1
            out[rows] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(count: np.ndarray, labels: np.ndarray, frequency: np.ndarray, total: int, dimensions: int = DIMENSIONS) -> Neighbours:
    """Randomised SVD with power iterations of the sample's weighted terms."""
    idf = np.log((1 + total) / (1 + frequency)) + 0.1
    idf[:SHAPE_TERMS] *= SHAPE_WEIGHT
    idf[0] *= SHAPE_WEIGHT  # repetition tells most about quality
    idf = np.rint(idf * IDF_STEPS)
    if not len(labels):
        return Neighbours(idf, np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    x = whole_weights(count, idf).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rank = min(dimensions, *x.shape)
    q = x.T @ np.random.default_rng(7).standard_normal((len(x), rank + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, axes = np.linalg.svd(x @ q, full_matrices=False)
    made = Neighbours(idf, np.rint((q @ axes[:rank].T).astype(float) * AXIS_STEPS), np.zeros((0, rank)), labels.astype(float), float(labels.mean()))
    made.vectors = made.latent(count)
    return made


def train(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, most: dict[int, int] = MOST_LABELLED) -> Neighbours:
    frequency, total = document_frequencies(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunked(batches):
            count = counts(data, at)
            sparse = [(np.flatnonzero(c).astype("<i2").tobytes(), c[c > 0].astype("<i8").tobytes()) for c in count]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array([s[k] for s in sparse], pa.binary()) for k in (0, 1))], ["doc_id", "label", "term", "n"])

    got = sample(docs, labels, "quality", parts, held, most).mapInArrow(rows, "doc_id long, label int, term binary, n binary").toArrow().sort_by("doc_id")
    count = np.zeros((got.num_rows, TERMS), np.int32)
    for i, (term, n) in enumerate(zip(got.column("term").to_pylist(), got.column("n").to_pylist(), strict=True)):
        count[i, np.frombuffer(term, "<i2")] = np.frombuffer(n, "<i8")
    return fit(count, got.column("label").to_numpy(), frequency, total)


def scored(docs: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunked(batches, limit=1 << 19):
            parts = [shared.value.score(counts(data[at[i] : at[min(i + 256, batch.num_rows)]], at[i : min(i + 256, batch.num_rows) + 1] - at[i])) for i in range(0, batch.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double")


def op8_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned outside fold 1 of 3."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

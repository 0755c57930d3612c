"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored, and a noisy-or joins them.

A sentence's score is a logistic function of the distinct words and word beginnings in it; a document is toxic if any sentence is:
P = 1 - prod(1 - p_sentence). Weights are learned from document labels alone through that noisy-or, on a bounded
sample of labelled rows; every document is then scored on its whole text, and the sentences that caused the score
are located.

Words are runs of letters and digits, lower-cased for A-Z and Latin-1, so marks stuck to a word do not hide it. Sentences end at
``.``, ``!``, ``?`` and line ends. Null and empty texts have no sentence and score 0. Rows with a null doc_id are scored
(held_out is null) and never trained on. With no labelled rows of both kinds, every score is the share of label 1
(0.0 without labels). Ids, labels, lang and source are no inputs of a score. Texts of any length are scored whole;
repeated rows, and rows with equal texts, get equal scores; a score of exactly 0.5 counts as toxic. Other columns are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import chunked, mix64
from .labelled import sample
from .words import small_latin, span_hashes, spans

#: Labelled documents of each label that the model is fitted on, at most.
MOST_LABELLED = {0: 2500, 1: 2000}
#: Hashed features; bytes of the word beginnings that are features too; epochs; documents that a feature must be in, at least and,
#: where toxic documents are many, one for each so many of these, at most.
FEATURES, BEGINNINGS, EPOCHS, LEAST_DOCS, DOCS_EACH, MOST_DOCS = 1 << 18, (4, 5), 250, 4, 50, 8

_NO_WORD = np.ones(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _NO_WORD[_low:_high] = False
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def sentence_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence) of each distinct word or beginning in a sentence, then document and byte range of each sentence."""
    data = small_latin(data)
    starts, ends = spans(data, at, _NO_WORD)
    mark = _END[data] if len(data) else np.zeros(0, bool)
    border = np.zeros(len(data) + 1, np.int32)
    border[np.flatnonzero(mark) + 1] = 1
    border[at] = 1
    number = np.cumsum(border)[starts]
    _, sentence = np.unique(number, return_inverse=True)
    pairs = []
    for n in (None, *BEGINNINGS):
        mine = np.flatnonzero(ends - starts > n) if n else np.arange(len(starts))
        key = span_hashes(data, starts[mine], starts[mine] + n if n else ends[mine]) + np.uint64(n or 0)
        pairs.append(sentence[mine] * FEATURES + (mix64(key) % np.uint64(FEATURES)).astype(np.int64))
    pair = np.unique(np.concatenate(pairs))
    first = np.searchsorted(sentence, np.arange(sentence[-1] + 1 if len(sentence) else 0))
    low = starts[first]
    high = ends[np.append(first[1:], len(starts)) - 1] if len(first) else starts
    doc = np.searchsorted(at, low, side="right") - 1
    return pair % FEATURES, pair // FEATURES, doc, np.stack([low, high], axis=1).reshape(-1, 2)


@dataclass
class NoisyOr:
    """Sentence weights and bias; without training pairs, a constant."""

    weights: np.ndarray
    bias: float
    constant: float | None = None

    def sentences(self, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(sentence, self.weights[feature], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def documents(self, scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(scores, 1 - 1e-12)), n))


def loss_slope(p: np.ndarray, doc: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slope of the weighted mean log loss of the noisy-or by each sentence's logit; p: sentence scores."""
    toxic = -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)))
    pull = np.where(labels > 0, -(1 - toxic) / np.maximum(toxic, 1e-9), 1.0)  # of the loss by -log(1 - p)
    return p * (pull * weights)[doc] / len(labels)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 3e-4) -> NoisyOr:
    """bags: (label, features, sentence of each feature). Full-batch Adam on the log loss of the noisy-or.

    The rarer label weighs more, by the root of its odds, and the number of documents that a feature must be in follows
    the number of toxic ones, so that few labels still leave features.
    """
    labels = np.array([b[0] for b in bags], float)
    if not len(bags) or labels.min() == labels.max():
        return NoisyOr(np.zeros(FEATURES), -30.0, float(labels.mean()) if len(bags) else 0.0)
    counts = np.zeros(FEATURES, np.int64)
    for _, feature, _ in bags:
        counts[np.unique(feature)] += 1
    used = counts >= min(MOST_DOCS, max(LEAST_DOCS, int(labels.sum()) // DOCS_EACH))
    known = np.flatnonzero(used)
    dense = np.cumsum(used) - 1
    sizes = np.array([int(b[2].max()) + 1 if len(b[2]) else 0 for b in bags])
    base = np.cumsum(sizes) - sizes
    feature = np.concatenate([dense[b[1][used[b[1]]]].astype(np.int32) for b in bags])
    sentence = np.concatenate([(b[2] + s)[used[b[1]]].astype(np.int32) for b, s in zip(bags, base, strict=True)])
    doc, n = np.repeat(np.arange(len(bags)), sizes), int(sizes.sum())
    share = labels.mean()
    weights = np.where(labels > 0, np.sqrt((1 - share) / share), 1.0)
    weights /= weights.mean()
    w, bias = np.zeros(len(known)), float(np.log(share / max(1.0, sizes.mean())))
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[feature], n) + bias, -30, 30)))
        slope = loss_slope(p, doc, labels, weights)
        grad = np.append(np.bincount(feature, slope[sentence], len(w)) + decay * w, slope.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    learned = np.zeros(FEATURES)
    learned[known] = w
    return NoisyOr(learned, bias)


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, most: dict[int, int] = MOST_LABELLED) -> NoisyOr:
    """The model of a bounded sample of labelled rows outside the held-out fold."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunked(batches):
            feature, sentence, doc, _ = sentence_words(data, at)
            cut = np.searchsorted(doc[sentence] if len(sentence) else sentence, np.arange(batch.num_rows + 1))
            first = np.searchsorted(doc, np.arange(batch.num_rows))
            columns = [[], []]
            for i in range(batch.num_rows):
                columns[0].append(feature[cut[i] : cut[i + 1]].astype("<i4").tobytes())
                columns[1].append((sentence[cut[i] : cut[i + 1]] - first[i]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array(c, pa.binary()) for c in columns)], ["doc_id", "label", "feature", "sentence"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["label"], r["feature"], r["sentence"]) for b in batches for r in b.to_pylist())
        model = fit([(y, np.frombuffer(f, "<i4"), np.frombuffer(s, "<i4")) for _, y, f, s in rows])
        constant = pa.array([model.constant], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), constant], ["weights", "bias", "constant"])

    rows = sample(docs, labels, "toxic", parts, held, most).mapInArrow(bags, "doc_id long, label int, feature binary, sentence binary")
    # the sample is bounded, so one task holds it; the driver gets the model alone
    got = rows.repartition(1).mapInArrow(learn, "weights binary, bias double, constant double").first()
    return fit([]) if got is None else NoisyOr(np.frombuffer(got["weights"], float), got["bias"], got["constant"])


def scored(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """(doc_id, score, sentences): every document's score and its sentences with a score of 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers, whatever the input
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, at in chunked(batches):
            feature, sentence, doc, place = sentence_words(data, at)
            p = model.sentences(feature, sentence, len(doc))
            total = model.documents(p, doc, batch.num_rows)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(p >= 0.5).tolist():
                i = int(doc[k])
                found[i].append({"start": int(place[k, 0] - at[i]), "end": int(place[k, 1] - at[i]), "score": float(p[k])})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(found, kind)], ["doc_id", "score", "sentences"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(score, "doc_id long, score double, sentences array<struct<start: long, end: long, score: double>>")


def without_toxic(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, at in chunked(batches):
            feature, sentence, doc, _ = sentence_words(data, at)
            total = model.documents(model.sentences(feature, sentence, len(doc)), doc, batch.num_rows)
            yield batch.filter(pa.array(total < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside fold 0 of 5."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"), "sentences")

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerweave.llm import quality

from .helpers import ODD, documents


def corpus(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdrst") for _ in range(rng.randint(2, 7)))
    texts = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        texts.append(" ".join(w + rng.choice(["***", "$$$", "!!"]) for w in words) if k % 3 == 0 else " ".join([words[0]] * 40 + words[:5]) if k % 7 == 0 else " ".join(words).capitalize() + ".")
    return texts, [(k, int(k % 3 != 0 and k % 7 != 0)) for k in range(n)]


def test_held_out_and_odd_rows(spark):
    texts, labels = corpus(400)
    docs = documents(spark, [*texts, *ODD], [*range(len(texts)), *range(1000, 1000 + len(ODD) - 1), None])
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    import zlib

    held = [(got[k], y) for k, y in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.95 * len(held)
    assert len(got) == len(texts) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    assert abs(got[1000] - model.prior) < 1e-9  # a null text


def test_blocked_products_are_exact(spark):
    texts, labels = corpus(120, 5)
    docs = documents(spark, texts)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    raw = [t.encode() for t in texts]
    count = quality.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    cosine = model.latent(count) @ model.vectors.T
    for row, score in zip(cosine, model.score(count), strict=True):
        row = row / quality.UNIT**2
        assert -1.00001 < row.min() and row.max() < 1.00001
        near = np.argsort(-row, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(row[near], 0) ** 4 + 1e-12
        assert abs(score - (weight * model.labels[near]).sum() / weight.sum()) < 1e-6


def test_frequencies_count_all_rows(spark):
    frequency, total = quality.document_frequencies(documents(spark, ["a b a", "b", None, ""]))
    assert total == 4 and sorted(frequency[quality.SHAPE_TERMS :][frequency[quality.SHAPE_TERMS :] > 0].tolist()) == [1, 2]


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark, ["a b", None])
    assert {r["score"] for r in quality.scored(docs, quality.train(docs, none)).collect()} == {0.5}
    empty = documents(spark, [])
    assert quality.scored(empty, quality.train(empty, none)).count() == 0


def test_repeated_rows_and_clashing_labels(spark):
    texts, labels = corpus(60, 2)
    docs = documents(spark, [*texts, texts[0], texts[0]], [*range(len(texts)), 0, None])
    marked = spark.createDataFrame([(k, y, "x", "y") for k, y in [*labels, labels[0]]], "doc_id long, quality int, text string, score string")
    got = quality.scored(docs, quality.train(docs, marked)).collect()
    assert len(got) == len(texts) + 2 and len({r["score"] for r in got if r["doc_id"] in (0, None)}) == 1


def test_scores_do_not_hang_on_the_block(spark):
    """Bit for bit: alone, among others, in another order; also beyond the table of logarithms."""
    texts, labels = corpus(300, 8)
    model = quality.train(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"))
    raw = [t.encode() for t in [*texts, "ab " * 70000, "ab " * 70001]]
    count = quality.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    scores = model.score(count)
    assert all(model.score(count[i : i + 1])[0] == scores[i] for i in range(len(raw)))
    order = np.random.default_rng(1).permutation(len(raw))
    assert (model.score(count[order]) == scores[order]).all()
    x = quality.whole_weights(count, model.idf)
    assert (x == np.rint(x)).all() and (np.abs(x) @ np.abs(model.axes)).max() < 2**53


def test_equal_texts_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.filter("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 10**6)).repartition(5)
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    scores = quality.scored(docs, model).join(docs, "doc_id").groupBy("text").agg(F.countDistinct("score").alias("n"), F.count("*").alias("rows"))
    assert scores.filter("rows > 1").count() > 50 and scores.filter("n > 1").count() == 0

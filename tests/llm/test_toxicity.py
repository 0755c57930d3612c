import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import common, toxicity

from .helpers import ODD, documents


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubcdrst") for _ in range(rng.randint(2, 7)))
    texts, labels = [], []
    for k in range(400):
        sentences = [[word() for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 12))]
        toxic = int(k % 4 == 0)
        if toxic:
            rng.choice(sentences).insert(1, rng.choice(["zounds", "zwackly", "zwackest", "zwacker"]))
        texts.append(". ".join(" ".join(s) for s in sentences) + ".")
        labels.append((k, toxic))
    docs = documents(spark, texts)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, table, toxicity.train(docs, table)


def test_held_out_documents(made):
    docs, labels, model = made
    rows = toxicity.scored(docs, model).join(labels, "doc_id").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0").collect()
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_offending_sentences_are_located(made):
    docs, _, model = made
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = [(r["doc_id"], s) for r in toxicity.scored(docs, model).collect() for s in r["sentences"]]
    right = sum("zounds" in (t := texts[d].encode()[s["start"] : s["end"]].decode()) or "zwack" in t for d, s in found)
    assert found and right >= 0.9 * len(found)


def test_odd_rows(spark, made):
    _, _, model = made
    docs = documents(spark, [*ODD, "ZOUNDS*** zounds!"], [*range(len(ODD)), None])
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(ODD) + 1 and got[0] == got[1] == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter(F.col("doc_id").isNull()).count() == 0
    assert toxicity.scored(documents(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark, made):
    docs = made[0]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(k, 1) for k in range(50)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.scored(docs, toxicity.train(docs, one)).collect()} == {1.0}


def test_noisy_or_like_brute_force(made):
    """Sentence by sentence in plain Python: 1 - prod(1 - p), and its slope by differences."""
    docs, labels, model = made
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()] + [None, ""]
    data, at = common.flat(pa.array(texts, pa.string()))
    feature, sentence, doc, _ = toxicity.sentence_words(data, at)
    clean = [1.0] * len(texts)
    for k in range(len(doc)):
        z = model.bias + sum(model.weights[f] for f, s in zip(feature.tolist(), sentence.tolist(), strict=True) if s == k)
        clean[doc[k]] *= 1 - 1 / (1 + math.exp(-z))
    p = model.sentences(feature, sentence, len(doc))
    assert model.documents(p, doc, len(texts)) == pytest.approx([1 - c for c in clean], abs=1e-9)

    logits, y, w = np.array([-2.0, 0.3, -1.0, 0.1, 1.5]), np.array([1.0, 0.0]), np.array([1.7, 0.4])
    of = np.array([0, 0, 1, 1, 1])

    def loss(z):
        total = 0.0
        for i in range(2):
            toxic = 1 - math.prod(1 - 1 / (1 + math.exp(-v)) for v, d in zip(z, of, strict=True) if d == i)
            total -= w[i] * math.log(toxic if y[i] else 1 - toxic)
        return total / 2

    slope = toxicity.loss_slope(1 / (1 + np.exp(-logits)), of, y, w)
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert slope[k] == pytest.approx((loss(logits + step) - loss(logits - step)) / 2e-6, rel=1e-5)


def test_held_out_quality_on_the_tables(spark):
    """Few labels (about 45 toxic ones): the ranking must still hold up."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.scored(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("toxic is not null and crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc >= 0.85 and sum(g >= 0.5 for g in good) <= 0.05 * len(good)


def test_repeated_rows_and_clashing_labels(spark, made):
    docs, labels, _ = made
    twice = docs.unionAll(docs.withColumn("doc_id", F.lit(None).cast("long")))
    wide = labels.unionAll(labels).withColumns({c: F.lit("x") for c in ("text", "label", "score")})
    model = toxicity.train(docs, wide)
    scores = {}
    for r in toxicity.scored(twice, model).join(docs.select("doc_id", "text"), "doc_id", "left").collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert len(scores[None]) == docs.count() and all(0 <= s <= 1 for v in scores.values() for s in v)

import hashlib

import corpus_pipeline
from ledgerweave.llm import common, registry

from .helpers import ODD, documents
from .test_minhash import brute as near
from .test_repeats import brute as repeated


def test_stages_on_a_small_table(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else kept
        docs = common.written(stage(spark, docs, sf_dir), name)
        if name == "packing":
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)
            break
        assert docs.columns == columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf_dir, "labels").collect()}
            gone = set(before) - set(kept)
            assert gone and sum(labels.get(i) == 0 for i in gone) <= 1
        if name == "near_duplicates":
            want = near([t for _, t in sorted(before.items())], sorted(before), 5, 80)
            assert set(kept) == {i for i, (_, _, first) in want.items() if first}
        if name == "suffix_array_dedup":
            want = repeated([t for _, t in sorted(before.items())], sorted(before), 100)
            assert kept == {i: w[3].decode(errors="ignore") for i, w in want.items()}
        if name == "decontamination":
            items = [" ".join(r["text"].split()).lower() for r in common.table(spark, sf_dir, "benchmark").collect()]
            assert not any(i in " ".join(t.split()).lower() for t in kept.values() for i in items if len(i) > 60)
            assert len(before) - len(kept) < 0.1 * len(before)


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    odd = documents(spark, [*ODD, "null id", "null id"], [*range(len(ODD)), None, None])
    for name, stage in corpus_pipeline.STAGES:
        found, none = stage(spark, odd, sf_dir), stage(spark, documents(spark, []), sf_dir)
        assert none.count() == 0
        if name == "packing":
            assert found.filter("doc_id is null").count() == 2 and found.select("doc_id").distinct().count() == len(ODD) + 1
        else:
            kept = found.collect()
            assert found.columns == none.columns == odd.columns
            assert sum(r["doc_id"] is None for r in kept) == 2 and {r["doc_id"] for r in kept if r["text"] is None} == {0}


def test_queries_are_registered(spark, sf_dir):
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_op2_digest(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, sf_dir, "documents").collect()}
    want = repeated([t for _, t in sorted(docs.items())], sorted(docs), 100)
    for r in registry.QUERIES["op2_suffix_array_dedup"](spark, sf_dir).collect():
        n, gone, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_stages_take_small_arrow_batches(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, documents(spark, ["some words of a text"], clash=False), sf_dir)
        assert int(spark.conf.get(key)) == common.BATCH_BYTES
    spark.conf.set(key, "1000b")
    common.small_batches(spark)
    assert spark.conf.get(key) == "1000b"
    spark.conf.unset(key)

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerweave.llm import packing

from .helpers import ODD, documents


def best_fit_decreasing(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(size - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


def test_rounds_pack_like_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, rng.choice([5, 30, 100])) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used, ranks = defaultdict(int), defaultdict(set)
        for length, rank, n, first, offset in packing.best_fit_rounds(counts, 100):
            for k in range(n):
                assert used[first + k] == offset
                used[first + k] += length
                ranks[length].add(rank + k)
        assert all(v <= 100 for v in used.values())
        assert {n: len(r) for n, r in ranks.items()} == counts
        assert len(used) == best_fit_decreasing(lengths, 100)


def test_documents_are_packed_whole(spark):
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choice(["one", "two", "three", "of"]) for _ in range(rng.randint(1, 200))) for _ in range(60))]
    rows = packing.pack_documents(documents(spark, texts), size=64).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, got in rows.sort_values("piece").groupby("doc_id"):
        ids, at = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        assert got.piece.tolist() == list(range(-(-len(ids) // 64)))
        for r in got.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (got.length[1:] == 64).all()
    assert set(rows.doc_id) == set(range(len(texts)))
    for _, got in rows.groupby("sequence_id"):
        got = got.sort_values("offset")
        assert got.offset.tolist() == (np.cumsum(got.length) - got.length).tolist() and got.length.sum() <= 64
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 64 + 1


def test_repeated_rows_and_empty_table(spark):
    twice = packing.pack_documents(documents(spark, ["same"] * 5, [1, 1, 1, None, 2])).toPandas()
    assert len(twice) == 5 and sorted(twice.offset) == sorted(set(twice.offset))
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_small_tables_need_no_python_workers(spark):
    rows = packing.pack_documents(documents(spark, ["one two", "three"], clash=False))
    assert "LocalTableScan" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "ExistingRDD" not in plan

import random
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest

from ledgerweave.llm import repeats
from ledgerweave.llm.bwt import Shard, merge, repeated_windows

from .helpers import ODD, documents


def brute(texts, ids, width):
    seen, out = set(), {}
    for i, text in sorted(zip(ids, texts, strict=True)):
        raw, gone = (text or "").encode(), set()
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone.update(range(k, k + width))
            seen.add(raw[k : k + width])
        spans = sum(k - 1 not in gone for k in gone)
        out[i] = (len(raw), len(gone), spans, bytes(b for k, b in enumerate(raw) if k not in gone))
    return out


def material(rng, n):
    shared = ["".join(rng.choice("abcd ") for _ in range(rng.randint(15, 120))) for _ in range(6)]
    fresh = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 90)))
    return ["".join(rng.choice([fresh(), rng.choice(shared), rng.choice(shared)[:40]]) for _ in range(rng.randint(1, 8))) for _ in range(n)] + ["ab" * 60, "a" * 150, "xyz" * 50, *ODD]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300}, {"block_bytes": 300, "anchor_bytes": 200}])
def test_like_brute_force(spark, options):
    rng = random.Random(11)
    texts = material(rng, 60)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = repeats.without_repeats(documents(spark, texts, ids), width=20, gram=6, **options)
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), bytes(r["kept"])) for r in df.collect()}
    assert got == brute(texts, ids, 20)


def test_hundred_bytes(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
    other = lambda n: "".join(rng.choice("qrstuvwxyz ") for _ in range(n))
    texts = [other(50) + passage + other(30), passage[:99] + other(9), other(7) + passage[100:200], passage, passage + passage, other(400)]
    df = repeats.without_repeats(documents(spark, texts))
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), bytes(r["kept"])) for r in df.collect()}
    assert got == brute(texts, range(len(texts)), 100)


def test_cleaned_keeps_columns_and_rows(spark):
    docs = documents(spark, ["é" * 80, "xé" + "é" * 80, None, None], [0, 1, None, None])
    out = repeats.cleaned(docs)
    assert out.columns == docs.columns and out.count() == 4
    assert repeats.cleaned(documents(spark, [])).count() == 0


def test_segments_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 3000, 3010, 5000])
    whole = repeats._stretches(data, at, 20, 6)
    monkeypatch.setattr(repeats, "_PLACE", 8)
    cut = repeats._stretches(data, at, 20, 6)

    def windows(found):
        return {(d, k) for d, lo, n in zip(*(x.tolist() for x in found[:3]), strict=True) for k in range(lo, lo + n)}

    assert windows(whole) == windows(cut) == {(d, k) for d in range(3) for k in range(at[d + 1] - at[d] - 19)}


def test_merged_shards():
    rng = random.Random(8)
    for _ in range(20):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(rng.randint(1, 12))]
        data, lengths = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
        string, offset, group = repeated_windows(data, lengths, 8, shards=rng.randint(1, 5))
        found = defaultdict(set)
        for s, o, g in zip(string.tolist(), offset.tolist(), group.tolist(), strict=True):
            found[g].add((s, o))
        want = defaultdict(set)
        for k, s in enumerate(strings):
            for o in range(len(s) - 7):
                want[s[o : o + 8]].add((k, o))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_common_prefixes_are_in_order():
    strings = [b"banana and bananas", b"bandana band", b"an ant"]
    shards = [Shard(np.frombuffer(s, np.uint8), np.array([len(s)]), 16) for s in strings]
    source, place, common = merge(shards, 16)
    cycles = [s + bytes(4) for s in strings]
    rotations = [(cycles[k][p:] + cycles[k][:p])[:16] for k, p in zip(source.tolist(), place.tolist(), strict=True)]
    assert rotations == sorted(rotations)
    for (a, b), n in zip(pairwise(rotations), common[1:].tolist(), strict=True):
        same = next((k for k in range(16) if a[k : k + 1] != b[k : k + 1]), 16)
        assert n == same // 4 * 4

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerweave.llm import periodic

from .helpers import ODD, documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(word):
    """Every stretch that has a period of q, cannot be extended and has no smaller period."""
    n, out = len(word), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(word[k] == word[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def sequences(draw):
    """Repeats of repeats, with changed letters between."""
    rng = random.Random(draw(st.integers(0, 1 << 30)))
    out = []
    for _ in range(draw(st.integers(1, 4))):
        part = [rng.randrange(rng.choice([1, 2, 3, 1000])) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 12, 16, 17, 30, 33]))]
        for _ in range(rng.randint(0, 2)):
            part = part * rng.randint(1, 6) + part[: rng.randint(0, len(part))]
            part = part[:400]
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = rng.randrange(3)
        out += part
    return out[:700]


@settings(max_examples=300, deadline=None)
@given(word=sequences())
def test_equals_brute_force(word):
    assert [tuple(r) for r in periodic.find_runs(np.array(word, np.int64)).tolist()] == brute(word)


def test_fibonacci_and_powers():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    for word in (fib[-1], [0] * 500, [0, 1] * 300, ([0] * 7 + [1]) * 80, (([0, 1] * 40 + [2]) * 6)[:500], list(range(120)) * 5, (list(range(33)) * 5 + [99]) * 4):
        assert [tuple(r) for r in periodic.find_runs(np.array(word, np.int64)).tolist()] == brute(word)


def test_hashes_that_clash_change_nothing(monkeypatch):
    """With hashes of a few values only, what they propose is still confirmed or put right on the words."""
    rng = random.Random(5)
    real = periodic.Hashes.of
    for _ in range(30):
        word = [rng.randrange(3) for _ in range(60)] + list(range(10, 22)) * rng.randint(4, 7) + [rng.randrange(3) for _ in range(60)]
        expected = brute(word)
        monkeypatch.setattr(periodic.Hashes, "of", lambda self, s, k: np.where(np.asarray(k) > 20, np.uint64(7), real(self, s, k)))
        got = {tuple(r) for r in periodic.find_runs(np.array(word, np.int64)).tolist()}
        monkeypatch.undo()
        assert got <= set(expected)


def test_synchronising_set_is_consistent_and_dense():
    rng = np.random.default_rng(1)
    word, t = rng.integers(0, 3, 3000), 8
    word[1000:1400] = word[200:600]
    windows = periodic.mix64(periodic.Hashes(word).windows(t))
    chosen = periodic.synchronising_set(windows, np.zeros(len(windows), bool), t)
    inside = lambda a: {i - a for i in chosen.tolist() if a <= i <= a + 400 - 2 * t}
    assert inside(200) == inside(1000) and np.diff(chosen).max() <= t and len(chosen) < len(word)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_rows(spark):
    texts = [*ODD, "a b " * 5 + "c", "é ü " * 4 + "\x0b\x0cé", " ".join(map(str, range(900))) + " " + "x y z w v u t s r q " * 300]
    ids = [*range(len(texts) - 1), None]
    got = {r["doc_id"]: r for r in periodic.runs(documents(spark, texts, ids)).collect()}
    assert len(got) == len(texts)
    for k, text in zip(ids, texts, strict=True):
        words = WORD.findall(text or "")
        assert got[k]["n_words"] == len(words)
        if len(words) < 2000:
            assert [tuple(r) for r in got[k]["runs"]] == brute(words) and got[k]["collapsed"] == collapsed(words, brute(words))
    assert [tuple(r) for r in got[None]["runs"]] == [(900, 3000, 10)]
    assert periodic.runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="four periods"):
        periodic.runs(documents(spark, []), repeats=3)


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = periodic.op13_periodic_runs(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r["n_runs"] > 0 for r in rows) >= 0.05 * len(rows)
    for r in rows:
        words = planted(r["doc_id"], texts[r["doc_id"]])
        number: dict[str, int] = {}
        runs = brute([number.setdefault(w, len(number)) for w in words]) if len(words) < 1500 else [tuple(x) for x in periodic.find_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64)).tolist()]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r["collapsed_sha256"] == sha(collapsed(words, runs))


def test_planting(spark):
    texts = ["one two three four five six seven eight nine ten eleven twelve"] * 60 + [None, "", " \t"] * 20
    got = {r["doc_id"]: r["text"] for r in periodic.with_planted_runs(documents(spark, texts)).collect()}
    assert all(WORD.findall(got[k] or "") == planted(k, t) for k, t in enumerate(texts))

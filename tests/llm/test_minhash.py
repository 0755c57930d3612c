import random
import re

import pytest

from ledgerweave.llm import components, minhash
from ledgerweave.llm.components import connected_components

from .helpers import ODD, documents, python_workers


def brute(texts, ids, size, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, root = {}, {i: i for i in ids}
    for i, text in zip(ids, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefghij") * rng.randint(1, 4)
    return " ".join(words)


def check(spark, texts, ids, size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(spark, texts, ids), size).collect()}
    assert got == brute(texts, ids, size, 80)


def test_like_brute_force(spark):
    rng = random.Random(5)
    texts = list(ODD)
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 150]))]
        texts += [edited(rng, base, rng.randint(0, 12)) for _ in range(12)]
    chain = [f"c{k}" for k in range(200)]
    for k in range(8):  # each like the next, the ends unlike
        texts.append(" ".join([f"d{k}_{j}" if j < 10 * k else w for j, w in enumerate(chain)]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    check(spark, texts, ids, 2)


@pytest.mark.parametrize("rounds", [0, 1])
def test_large_open_buckets_like_brute_force(spark, monkeypatch, rounds):
    """Groups of near copies of which many are just too unlike, with every open bucket counted as large."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "LARGE", 2)
    monkeypatch.setattr(minhash, "COMMON", 3)
    rng = random.Random(9)
    texts = list(ODD)
    for _ in range(2):
        base = [f"w{rng.randrange(4000)}" for _ in range(120)]
        first = [edited(rng, base, rng.randint(0, 14)) for _ in range(40)]
        texts += first + [edited(rng, rng.choice(first).split(" "), rng.randint(0, 6)) for _ in range(20)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    check(spark, texts, ids, 2)


def test_five_word_shingles(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    texts = [edited(rng, base, n) for n in (0, 1, 2, 3, 4, 6, 8, 10, 14)] + ["one two three", "One  two three", "one two"]
    check(spark, texts, list(range(len(texts))), 5)


def test_null_ids_repeats_and_empty(spark):
    got = minhash.near_duplicates(documents(spark, ["a b c", "a b c", "a b c", None], [None, 4, 4, 2])).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(None, None, True), (4, 4, True), (4, 4, True), (2, 2, True)], key=str)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("tasks", [1, 12, 60])
def test_components(spark, tasks):
    """Links in one task, in a few, and about two in each task."""
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, rng.randrange(101, 160)) for _ in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(tasks)).collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in edges)}


def test_a_task_runs_one_python_worker(spark, monkeypatch):
    rng, workers = random.Random(8), []
    for module in (minhash, components):

        def noted(df, name, put=module.written, **options):
            workers.append((name, python_workers(df)))
            return put(df, name, **options)

        monkeypatch.setattr(module, "written", noted)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(40)] for _ in range(3)]
    texts = [edited(rng, words, k % 3) for words in base for k in range(6)]
    minhash.near_duplicates(documents(spark, texts), size=2).count()
    assert ("components", 1) in workers and {n for _, n in workers} == {0, 1}, workers

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import common, phrases

from .helpers import ODD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    found = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            found.update(("und" if lang is None else lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    return found


def brute(rows, top, least, covered=80):
    counts = brute_counts(rows)
    total = Counter()
    for key, n in counts.items():
        total[key[0]] += n * (len(key) == 2)
    often = {key: n for key, n in counts.items() if len(key) > 2 and n >= least}
    hidden = set()
    for (lang, *words), n in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * n >= covered * counts[(lang, *words[i : i + k])]:
                    hidden.add((lang, *words[i : i + k]))
    out = {}
    for key, a in often.items():
        lang, *words = key
        if key in hidden:
            continue
        cuts = [(2000000 * a // (counts[(lang, *words[:k])] + counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[(lang, *words[:k])], counts[(lang, *words[k:])]))
    return [(lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, found in sorted(out.items()) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "Big", "é", "a\x1cb", "x" * 30, "data", "set", "run", "to", "end", "and"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(["the end of the data", "Big  data\tset", "run to the", *words]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "en", "en", "de", None, ""]), "".join(p + rng.choice([" ", " ", " ", ". ", "\n", "\t", "\x0b", "!"]) for p in parts)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n long").repartition(3)


def found(df):
    return [tuple(r) for r in df.orderBy("lang", "rank").select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


@pytest.mark.parametrize(("budget", "block", "least", "top"), [(10**6, 10**6, 3, 50), (40, 50, 3, 1000), (7, 9, 2, 30)])
def test_equals_brute_force(spark, budget, block, least, top):
    """Also where prefixes are split down to whole phrases, and blocks end within pieces."""
    rows = corpus(budget)
    assert found(phrases.collocations(table(spark, rows), top, least, budget=budget, block=block)) == brute(rows, top, least)


def test_counts_of_all_levels(spark):
    rows = corpus(1)
    nodes, frequent, totals = phrases.phrase_counts(table(spark, rows), 2, budget=20, block=64)
    words = {r["id"]: (r["lang"], r["word"]) for r in frequent.collect()}
    got = {(words[r["ids"][0]][0], *(words[i][1] for i in r["ids"])): r["n"] for r in nodes.collect()}
    expected = {key: n for key, n in brute_counts(rows).items() if n >= 2}
    assert got == expected and nodes.count() == len(expected)
    assert {r["lang"]: r["n"] for r in totals.collect()} == {lang: sum(n for key, n in brute_counts(rows).items() if key[0] == lang and len(key) == 2) for lang in {key[0] for key in brute_counts(rows)}}
    assert sorted(words) == list(range(1, len(words) + 1))


def test_groups_keep_to_the_budget(spark):
    rows = corpus(4, 200)
    blocks = common.written(phrases.word_blocks(table(spark, rows), 500), "test")
    live, frequent = phrases.frequent_words(blocks, 2)
    frequent = common.written(frequent, "test")
    coded = common.written(phrases.coded_blocks(blocks, live, frequent), "test")
    plan = phrases.Plan(1 << 12)
    plan.add(frequent.select(F.col("id").alias("p0"), "n"), 50)
    while plan.split[-1].shape[1]:
        plan.add(phrases.prefix_counts(coded, plan), 50)
    weight, split = Counter(), set(plan.split[0][0].tolist())
    for r in frequent.collect():
        if r["id"] not in split:
            weight[int(plan.group[0][r["id"] % plan.buckets])] += r["n"]
    assert split and len(plan.split) > 2 and plan.groups > 10 and max(weight.values()) <= 50


def test_planes_round_trip():
    import numpy as np

    for values in (np.zeros(0, np.int64), np.array([0, 1, 2**31 - 1, 2**32 - 1]), np.arange(1000) * 77):
        assert phrases._unpacked(phrases._packed(values)).tolist() == values.tolist()


def test_odd_rows(spark):
    rows = [("en", t) for t in [*ODD, *ODD, "a b. a b", None]] + [(None, "a b"), (None, None)]
    assert found(phrases.collocations(table(spark, rows), 100, 2)) == brute(rows, 100, 2)
    assert phrases.collocations(documents(spark, []), 10).count() == 0


def test_large_counts_stay_exact(spark, monkeypatch):
    nodes = spark.createDataFrame([([1, 2], 6 * 10**12), ([1], 9 * 10**18), ([2], 9 * 10**18 - 1)], "ids array<int>, n long")
    words = spark.createDataFrame([(1, "en", "a", 1), (2, "en", "b", 1)], "id int, lang string, word string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: (nodes, words, spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")))
    assert found(phrases.collocations(nodes, 5)) == [("en", 1, "a b", 6 * 10**12, 9 * 10**18, 9 * 10**18 - 1, 9 * 10**18, 2000000 * 6 * 10**12 // (18 * 10**18 - 1))]


def test_sql_twin(spark):
    rows = corpus(6, 400)
    con = duckdb.connect()
    frame = table(spark, rows).toPandas()  # noqa: F841  DuckDB reads it by name
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    theirs = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.OP11_SQL}) ORDER BY lang, rank").fetchall()
    assert theirs == brute(rows, 2000, 30) == found(phrases.collocations(table(spark, rows), 2000))

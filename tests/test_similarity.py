"""The batch matcher against the standard library's, and the bounded search against nested loops."""

import random
import re
from difflib import SequenceMatcher
from itertools import takewhile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave.functions import similarity
from ledgerweave.operators import resolve
from ledgerweave.plans import catalogue

WORD = st.one_of(st.text("ab", max_size=14), st.text("abc é", max_size=30), st.text(max_size=12), st.builds(lambda a, n: (a * n)[:260], st.text("abcdefghij", max_size=40), st.integers(0, 30)))


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@settings(max_examples=300, deadline=None)
@given(pairs=st.lists(st.tuples(WORD, WORD), max_size=6))
def test_batch_is_the_library(pairs):
    got = similarity.block_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [ratio(a, b) for a, b in pairs]


def test_long_names_and_small_tables(monkeypatch):
    """Beyond 200 characters common ones start no block."""
    rng = random.Random(7)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(make(rng.randint(150, 320), letters), make(rng.randint(195, 330), letters)) for letters in ("ab", "abcdefghijkl", "abcdefghijklmnopqrstuvwxyz0123456789 " * 3 + "aaaa") for _ in range(6)]
    pairs += [(b[:90] + make(40, "xyz") + b[90:], b) for _, b in pairs]
    want = [ratio(a, b) for a, b in pairs]
    assert similarity.block_ratios(*zip(*pairs, strict=True)).tolist() == want
    monkeypatch.setattr(similarity, "CELLS", 100)
    assert similarity.block_ratios(*zip(*pairs, strict=True)).tolist() == want


@settings(max_examples=200, deadline=None)
@given(a=st.text("abc 1é", max_size=16), b=st.text("abc 1é", max_size=16))
def test_bounds_by_hand(a, b):
    """The bound of most_matched, said in plain code, holds for every pair."""
    matched = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    common = sum(any(a[i : i + 2] == b[j : j + 2] for j in range(len(b) - 1)) for i in range(len(a) - 1))
    assert 3 * matched <= len(a) + len(b) + common + 1


def nested(asked, known, threshold=0.7):
    out = {}
    for q in asked:
        best = max(((ratio(q, k), -i, k) for i, k in enumerate(known)), default=(0.0, 0, None))
        if best[0] >= threshold:
            out[q] = (best[2], best[0])
    return out


def vocabulary(rng, n):
    words = ["north", "south", "river", "stone", "data", "food", "farm", "works", "a", "zz"]
    return list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n)))


def changed(rng, name):
    for _ in range(rng.randint(0, 5)):
        k = rng.randrange(len(name) + 1)
        name = rng.choice([name[:k] + rng.choice("abz9 ") + name[k:], name[:k] + name[k + 1 :], name[k:] + name[:k]])
    return " ".join(name.split())


@pytest.mark.parametrize("seed", [1, 2])
def test_search_like_nested_loops(spark, seed):
    """Ratios between 0 and 1, ties, short and long keys, keys without a partner."""
    rng = random.Random(seed)
    known = [*vocabulary(rng, 120), "ab", "ba", "x", "abcdefgh", "abcdefgi", "abcdefgj"]
    asked = list(dict.fromkeys([*(changed(rng, rng.choice(known)) for _ in range(80)), "abcdefgk", "bc", "y", "", "quite something else", "a" * 40]))
    known = [k for k in dict.fromkeys(known) if k]
    rng.shuffle(known)
    got = resolve.similar_companies(spark.createDataFrame([(a,) for a in asked], "query string"), spark.createDataFrame(list(zip(known, range(len(known)), strict=True)), "name string, position int"))
    want = nested(asked, known)
    assert {r["query"]: (r["name"], r["score"]) for r in got.collect()} == want
    assert 20 < len(want) < len(asked) and any(s < 1 for _, s in want.values())


def test_thresholds(spark):
    rng = random.Random(5)
    known = vocabulary(rng, 60)
    asked = [changed(rng, rng.choice(known)) for _ in range(40)]
    tables = spark.createDataFrame([(a,) for a in asked], "query string"), spark.createDataFrame(list(zip(known, range(len(known)), strict=True)), "name string, position int")
    for threshold in (0.9, 1.0):
        assert {r["query"]: (r["name"], r["score"]) for r in resolve.similar_companies(*tables, threshold).collect()} == nested(asked, known, threshold)
    with pytest.raises(ValueError, match="thresholds"):
        resolve.similar_companies(*tables, 0.5)


def test_few_pairs_are_compared(spark):
    """Of 500,000 pairs of suppliers that are left without equal keys the matcher sees less than a twentieth."""
    supplier = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet")
    keys = resolve._features(supplier.filter("s_suppkey % 2 = 0 and s_suppkey % 4 <> 0").select(F.concat(F.lower(F.regexp_replace("s_name", "#", "")), F.lit(" x")).alias("q")).unionAll(supplier.filter("s_suppkey % 4 = 3").select(F.concat(F.lower(F.regexp_replace("s_name", "#", "")), F.lit(" y")).alias("q"))), "q", "q")
    known = resolve._features(supplier.select(F.lower(F.regexp_replace("s_name", "#", "")).alias("k"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("position")), "k", "k")
    first = resolve.first_partners(keys, known, 0.7)
    assert keys.count() == 500 and first.count() == 500
    assert resolve.rival_pairs(keys, known, first, 0.7).count() + 500 <= 500_000 / 20


def test_misspelt_parts_like_nested_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").collect()
    names = {}
    for r in sorted(rows):
        names.setdefault(r["p_name"], r["p_partkey"])
    known = sorted(names, key=names.get)
    want = {}
    for r in rows:
        k = r["p_partkey"] % len(r["p_name"])
        asked = r["p_name"][:k] + r["p_name"][k + 1 :]
        if asked not in want:
            want[asked] = nested([asked.strip()], known).get(asked.strip())
    got = {r["query"]: (r["name"], r["score"]) for r in catalogue.QUERIES["misspelt_parts"](spark, sf_dir).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_numbered_names_meet_only_their_own(spark):
    """Numbers in another order have the same letters: they are no first partners, and equal remains leave no other pair."""
    named = spark.range(0, 400, 3).select(F.format_string("supplier%09d", "id").alias("k"), F.col("id").alias("position"))
    keys = resolve._features(named.select(F.concat("k", F.lit(" x")).alias("q")), "q", "q")
    known = resolve._features(named.withColumn("name", F.col("k")), "k", "k")
    first = resolve.first_partners(keys, known, 0.7).localCheckpoint()
    assert {round(r["score"], 6) for r in first.collect()} == {round(34 / 36, 6)} and first.count() == named.count()
    assert resolve.rival_pairs(keys, known, first, 0.7).count() == 0


def test_exploded_rows_are_not_sent_whole(spark):
    """Spark sizes exploded rows as what they came from; remains and runs of keys are many times that, and no join sends them."""
    named = spark.range(0, 60, 3).select(F.format_string("supplier%09d", "id").alias("k"), F.col("id").alias("position"))
    keys = resolve._features(named.select(F.concat("k", F.lit(" x")).alias("q")), "q", "q")
    known = resolve._features(named.withColumn("name", F.col("k")), "k", "k")
    first = resolve.first_partners(keys, known, 0.7)

    def sent(rows):
        """Operators below each broadcast, down to where rows are joined, grouped or put together."""
        lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                yield from takewhile(lambda x: not re.search("Join|Aggregate|Union|CartesianProduct", x), lines[i + 1 :])

    for rows in (resolve._one_off(keys, known), first, resolve.rival_pairs(keys, known, first, 0.7)):
        assert "Generate explode" in rows._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in sent(rows) if re.search(r"Generate explode.*\[(rest|gram|g)#", x)]

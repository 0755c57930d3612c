"""Scores and trails on small graphs: diamonds, cycles, depth, null and cancelling amounts."""

import json
import random

import pytest

from ledgerweave.operators import scoring, traverse
from ledgerweave.sources.exports import export_scores


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def graph(spark):
    """Brand b owns 1; 1 -> 2 and 3 -> 4 (a diamond), 4 -> 1 (a cycle)."""
    return frame(spark, [("b", 1)], "brand string, corp long"), frame(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "child long, parent long")


def test_trails_walk_an_edge_once(graph):
    edges, want = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], []

    def walk(at, walked):
        want.append((at, len(walked)))
        for e in edges:
            if e[0] == at and e not in walked:
                walk(e[1], [*walked, e])

    walk(1, [])
    assert sorted((r["corp"], r["depth"]) for r in traverse.trails(*graph).collect()) == sorted(want)
    assert sum(corp == 4 for corp, _ in want) == 4


def test_depth_is_bounded(spark):
    chain = frame(spark, [(k, k + 1) for k in range(12)], "child long, parent long")
    roots = frame(spark, [("b", 0)], "brand string, corp long")
    assert traverse.trails(roots, chain).count() == 11
    assert traverse.trails(roots, chain, traverse.VIEW_HOPS).count() == 6
    assert traverse.trails(roots, chain.limit(0)).count() == 1


def test_counts_without_listing(spark, graph):
    """Composed counts against listed trails: random graphs that only lead upwards, any number of hops, and a cycle."""
    rng = random.Random(4)
    up = sorted({(a, a + rng.randint(1, 4)) for a in range(14) for _ in range(3)})
    roots, edges = frame(spark, [("b", 0), ("c", 2), ("c", 3)], "brand string, corp long"), frame(spark, up, "child long, parent long")
    for hops in (1, 3, 5, 10):
        want = sorted(map(tuple, traverse.trail_counts(roots, edges, hops).collect()))
        assert sorted(map(tuple, traverse.composed_counts(roots, edges, hops).collect())) == want
    assert not traverse.never_returns(graph[1])
    assert sorted(map(tuple, traverse.acyclic_trail_counts(*graph).collect())) == sorted(map(tuple, traverse.trail_counts(*graph).collect()))


def test_diamond_counts_twice(spark):
    roots, edges = frame(spark, [("b", 1)], "brand string, corp long"), frame(spark, [(1, 2), (1, 3), (2, 4), (3, 4)], "child long, parent long")
    want = {1: 1, 2: 1, 3: 1, 4: 2}
    assert {r["corp"]: r["trails"] for r in traverse.trail_counts(roots, edges).collect()} == want
    assert {r["corp"]: r["trails"] for r in traverse.acyclic_trail_counts(roots, edges).collect()} == want


#: (score, dollars) of each candidate, and the weighted score.
CASES = [
    ([(90.0, 250), (10.0, 750)], 30.0),
    ([(35.0, 0), (65.0, 0), (20.0, 0)], 40.0),
    ([(None, 900), (45.0, 10)], 45.0),
    ([(12.0, 0), (48.0, 7), (None, 3)], 48.0),
    ([(None, 1), (None, 2)], None),
    ([(90.0, 300), (30.0, -300), (60.0, 0)], 60.0),  # cancelling amounts
    ([(70.0, None), (25.0, None)], 47.5),
    ([(100.0, 300), (0.0, -100)], 150.0),  # a refund takes a score out of 0 to 100
]


@pytest.mark.parametrize("given,want", CASES)
def test_weighted_score(spark, given, want):
    trails = frame(spark, [("b", 1, 0)], "brand string, corp long, depth int")
    pacs = frame(spark, [(1, 1)], "corp long, committee long")
    gifts = frame(spark, [(1, k, a) for k, (_, a) in enumerate(given)], "committee long, candidate long, amount int")
    rates = frame(spark, [("o", k, s) for k, (s, _) in enumerate(given)], "org string, candidate long, score double")
    covers = frame(spark, [("o", "i")], "org string, issue string")
    naive = [r["score"] for r in scoring.naive_scores(trails, pacs, gifts, rates, covers).collect()]
    counts = trails.groupBy("brand", "corp").count().withColumnRenamed("count", "trails")
    factored = [r["score"] for r in scoring.factored_scores(counts, pacs, gifts, rates, covers).collect()]
    assert naive == factored == ([] if want is None else [want])


def test_factored_is_naive_on_a_cyclic_graph(spark, graph):
    pacs = frame(spark, [(k, k) for k in range(1, 5)], "corp long, committee long")
    gifts = frame(spark, [(1, 7, "100.10"), (4, 7, "-50"), (4, 8, "x"), (2, 9, "0"), (3, 9, "12.5"), (4, 9, "3")], "committee long, candidate long, amount string")
    rates = frame(spark, [("o", 7, 80.0), ("o", 8, 20.0), ("p", 9, None), ("p", 7, 33.0)], "org string, candidate long, score double")
    covers = frame(spark, [("o", "i"), ("o", "j"), ("p", "i")], "org string, issue string")
    naive = sorted(map(tuple, scoring.naive_scores(traverse.trails(*graph), pacs, gifts, rates, covers).collect()))
    factored = sorted(map(tuple, scoring.factored_scores(traverse.trail_counts(*graph), pacs, gifts, rates, covers).collect()))
    assert naive == factored and len(naive) == 3


def test_tiers(spark):
    given = [(0, 0), (10_001, 1), (10_000, 1), (9_999, 2), (100_000, 9), (100_001, 4), (100_001, 5), (2_000_000, 1), (-5, 3)]
    rows = frame(spark, [(k, d, n) for k, (d, n) in enumerate(given)], "k int, d long, n long")
    got = [r["c"] for r in rows.select("k", scoring.confidence(rows["d"], rows["n"]).alias("c")).orderBy("k").collect()]
    assert got == ["low", "medium", "low", "medium", "medium", "medium", "high", "medium", "medium"]


def test_export(spark, tmp_path):
    scores = frame(spark, [("b", "i", "o", 1.5, 2.0, 3, "low"), ("b", "i", "p", None, 2.0, 3, "low"), ('q"', "j", "o", 5.0, 0.0, 1, "low")], "brand_name string, issue_name string, scorecard_org string, score double, dollars double, candidates long, confidence string")
    assert export_scores(scores, tmp_path / "out" / "scores.json") == 2
    out = json.loads((tmp_path / "out" / "scores.json").read_text())
    assert out["meta"]["brand_count"] == 2 and out["meta"]["version"] == "0.2"
    assert out["brands"]["b"]["i"]["o"] == {"score": 1.5, "dollars": 2.0, "candidates": 3, "confidence": "low"} and set(out["brands"]) == {"b", 'q"'}


def test_export_of_many_parts(spark, tmp_path):
    """Brands in order, whatever the parts; a second export replaces the first; nothing else stays beside it."""
    rows = [(f"b{k:03d}é\\", "i", "o", float(k), 1.0, 1, "low") for k in range(200)]
    scores = frame(spark, rows, "brand_name string, issue_name string, scorecard_org string, score double, dollars double, candidates long, confidence string").repartition(7)
    for _ in range(2):
        assert export_scores(scores, f"file://{tmp_path}/scores.json") == 200
    out = json.loads((tmp_path / "scores.json").read_text(encoding="utf-8"))
    assert list(out["brands"]) == [r[0] for r in rows] and out["brands"]["b007é\\"]["i"]["o"]["score"] == 7.0
    assert {p.name for p in tmp_path.iterdir()} <= {"scores.json", ".scores.json.crc"}
    assert export_scores(scores.limit(0), tmp_path / "none.json") == 0 and json.loads((tmp_path / "none.json").read_text())["brands"] == {}


def test_scores_hang_on_no_order(spark):
    """Amounts and scores that a sum of doubles rounds by their order: the same bits for 1, 4 and 200 partitions."""
    rng = random.Random(3)
    rows = [("b", "i", "o", k, round(rng.uniform(0, 100), 3), f"{rng.uniform(-1, 1) * 10 ** rng.randint(0, 12):.2f}", 1) for k in range(3000)]
    parts = frame(spark, rows, "brand string, issue string, org string, candidate int, score double, amount string, n int").withColumn("dollars", scoring.money())
    got = set()
    for n in (1, 4, 200):
        for _ in range(2):
            rng.shuffle(rows)
            shuffled = frame(spark, rows, "brand string, issue string, org string, candidate int, score double, amount string, n int").withColumn("dollars", scoring.money()).repartition(n)
            got |= {tuple(r) for r in scoring._scores(shuffled).collect()}
    assert len(got | {tuple(r) for r in scoring._scores(parts).collect()}) == 1
    from fractions import Fraction

    dollars = [Fraction(r[5]) for r in rows]
    mean = sum(d * Fraction(str(r[4])) for d, r in zip(dollars, rows, strict=True)) / sum(dollars)
    assert abs(next(iter(got))[3] - float(mean)) <= 0.05 + 1e-9


def test_whole_ownership_table_is_scored(spark, sf_dir):
    from ledgerweave.plans import catalogue

    brands = catalogue.Domain(spark, sf_dir).owned_by.count()
    for name in ("brand_scores_naive", "brand_scores_zero_dollar"):
        assert catalogue.QUERIES[name](spark, sf_dir).select("brand_name").distinct().count() == brands

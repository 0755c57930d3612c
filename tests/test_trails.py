"""Trail counts on graphs with cycles against listed trails, and on graphs with too many trails to list."""

import random
import time

import pytest

from ledgerweave.operators import traverse
from ledgerweave.plans import catalogue


def tables(spark, roots, edges):
    return spark.createDataFrame(roots, "brand string, corp long"), spark.createDataFrame(edges, "child long, parent long")


def brute_components(edges):
    """(corp, component) of corporations on cycles, by reachability."""
    reach = {a: {b for x, b in edges if x == a} for a in {x for e in edges for x in e}}
    for _ in reach:
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    return {(a, max(b for b in reach[a] if a in reach[b])) for a in reach if a in reach[a]}


@pytest.mark.parametrize("seed", range(1, 4, 2))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 24
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(14 + 6 * seed)})
    _, table = tables(spark, [("b", 0)], edges)
    got = {tuple(r) for r in traverse.components(table).collect()}
    assert got == brute_components(edges)
    inner = {(r["child"], r["parent"]) for r in traverse.labelled(table).filter("inner").collect()}
    part = dict(brute_components(edges))
    assert inner == {(a, b) for a, b in edges if a in part and part[a] == part.get(b)}


@pytest.mark.parametrize("seed", range(2, 4))
def test_counts_like_listing(spark, seed):
    """Components, loops, diamonds, edges between components, a root inside a component, unknown roots."""
    rng = random.Random(100 + seed)
    n = 16
    edges = {(a, min(n - 1, a + rng.randint(1, 4))) for a in range(n) for _ in range(2)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(seed)}
    edges |= {(3, 5), (5, 3)} if seed % 2 else {(7, 7), (2, 4), (4, 6), (6, 2), (4, 2)}
    roots, table = tables(spark, [("b", 0), ("b", 5), ("c", 2), ("d", 99)], sorted(edges))
    graph = traverse.labelled(table)
    for hops in (0, 3, 7):
        want = sorted(map(tuple, traverse.trail_counts(roots, table, hops).collect()))
        assert sorted(map(tuple, traverse.counted_trails(roots, graph, hops).collect())) == want


def test_names_and_no_edges(spark):
    roots, edges = spark.createDataFrame([("b", "x")], "brand string, corp string"), spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "z")], "child string, parent string")
    assert {r["corp"]: r["trails"] for r in traverse.counted_trails(roots, traverse.labelled(edges)).collect()} == {"x": 2, "y": 1, "z": 1}
    assert [tuple(r) for r in traverse.counted_trails(roots, traverse.labelled(edges.limit(0))).collect()] == [("b", "x", 1)]


def test_a_ladder_of_diamonds(spark):
    """30 diamonds, one above the other: 2^30 trails to the top; with a cycle below as well."""
    edges = [e for k in range(30) for e in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]
    roots, table = tables(spark, [("b", 0)], edges)
    began = time.perf_counter()
    graph = table.selectExpr("child", "parent", "false AS inner")
    got = {r["corp"]: r["trails"] for r in traverse.counted_trails(roots, graph, 60).collect()}
    assert got[90] == 2**30 and len(got) == 91 and time.perf_counter() - began < 60
    roots, table = tables(spark, [("b", -1)], [*edges[:40], (-1, 0), (0, -1)])
    got = {r["corp"]: r["trails"] for r in traverse.counted_trails(roots, traverse.labelled(table), 10).collect()}
    assert got == {r["corp"]: r["trails"] for r in traverse.trail_counts(roots, table, 10).collect()}


def test_stored_graph_of_the_tables(spark, sf_dir):
    d = catalogue.Domain(spark, sf_dir)
    assert d.graph.filter("inner").count() == 0 and d.graph.count() == d.subsidiaries.count()
    want = sorted(map(tuple, traverse.trail_counts(d.owned_by, d.subsidiaries).collect()))
    assert sorted(map(tuple, traverse.counted_trails(d.owned_by, d.graph).collect())) == want

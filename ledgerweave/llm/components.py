"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: Links that a task holds as arrays at a time, 16 bytes each.
COMBINED = 1 << 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v. Minima are pre-aggregated; the join back is one that Spark can split for a hot node."""
    if large:
        sides = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    met = edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    return met.filter("up > 1 or (up = 1 and down > 0)").count() == 0


def _forest(ends: np.ndarray) -> np.ndarray:
    """Links (pairs of ids) -> pairs of each id and the smallest id that these links reach from it, where that is another."""
    ids, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b]):
            np.minimum.at(root, side, low)
        while (up := root[root] < root).any():
            root[up] = root[root[up]]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = root != np.arange(len(ids))
    return np.stack([ids[moved], ids[root[moved]]], axis=1)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        found = _forest(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], ["u", "v"])

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64))
        n += batch.num_rows
        if n >= COMBINED:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def component_stars(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b) -> (id, component): the smallest id reachable, for every id that reaches a smaller one.

    Each task first replaces its own links, COMBINED at a time, by stars with the same reach, as an aggregate combines
    before its shuffle. Then rounds of large-star and small-star, each written to the shared folder, join what the tasks
    found, until the edges are stars: every id has one smaller neighbour, which has none itself.
    """
    links = links.filter("a <> b").select("a", "b")
    edges = written(links.mapInArrow(_combine, "u long, v long"), name)
    while not _are_stars(edges):
        last, edges = edges, written(_star(_star(edges, True), False).distinct(), name)
        drop(last)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b) -> (id, component): the smallest id reachable, for every id that has a link to another."""
    stars = component_stars(links, name)
    return stars.unionAll(stars.select(F.col("component").alias("id"), "component").distinct())

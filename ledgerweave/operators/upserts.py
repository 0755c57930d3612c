"""Keyed upserts of node and edge tables, as full joins or last-write windows over snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep_if_null: Sequence[str] = (), keep_if_empty: Sequence[str] = ()) -> DataFrame:
    """current with incoming's values. keep_if_null / keep_if_empty: columns whose old value a null / an empty one leaves."""
    old, new = current.alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    columns = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in current.columns:
        if c == key:
            continue
        value = F.nullif(F.col(f"n.{c}"), F.lit("")) if c in keep_if_empty else F.col(f"n.{c}")
        if c in keep_if_null or c in keep_if_empty:
            columns.append(F.coalesce(value, F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("n._new"), value).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def renamed(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Candidates (key, name, aliases): a changed name puts the old one before the aliases, once."""
    old, new = current.alias("o"), incoming.alias("n")
    aliases = F.coalesce("o.aliases", F.array().cast("array<string>"))
    changed = F.col("n.name").isNotNull() & F.col("o.name").isNotNull() & (F.col("n.name") != F.col("o.name"))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key), F.coalesce("n.name", "o.name").alias("name"),
        F.when(changed & ~F.array_contains(aliases, F.col("o.name")), F.array_union(F.array("o.name"), aliases)).otherwise(aliases).alias("aliases"),
    )


def with_rated_names(candidates: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """Candidates whose aliases take the names that ratings used for them."""
    names = ratings.groupBy(key).agg(F.sort_array(F.collect_set("candidate_name")).alias("_names"))
    merged = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_names", F.array().cast("array<string>")))
    return candidates.join(names, key, "left").withColumn("aliases", merged).drop("_names")


def names_of(corporations: DataFrame) -> DataFrame:
    """(name, corp): every name and alias of a corporation, for joins by either."""
    return corporations.select(F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"), F.col("id").alias("corp")).filter("name is not null")


def ordered_names(corporations: DataFrame) -> DataFrame:
    """(name, position): names and aliases without repeats, in order of first appearance."""
    listed = corporations.select("position", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "listed"))
    return listed.filter("listed is not null").groupBy(F.col("listed").alias("name")).agg(F.min(F.struct("position", "at")).alias("position"))


def with_endpoints(edges: DataFrame, sources: DataFrame, source: str, targets: DataFrame, target: str) -> DataFrame:
    """Edges both of whose ends exist."""
    return edges.join(sources.select(source).distinct(), source, "left_semi").join(targets.select(target).distinct(), target, "left_semi")


def unknown(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Edges whose end does not exist."""
    return edges.join(nodes.select(column).distinct(), column, "left_anti")


def alias_edges(pairs: DataFrame, corporations: DataFrame) -> DataFrame:
    """pairs (source, corp_name) -> (source, corp), by name or alias."""
    return pairs.join(names_of(corporations).withColumnRenamed("name", "corp_name"), "corp_name").select("source", "corp").distinct()


def by_corporation(pairs: DataFrame, corporations: DataFrame, *columns: str) -> DataFrame:
    """pairs with each of the columns, names or aliases of corporations, replaced by ids; pairs that name none go."""
    names = names_of(corporations)
    for c in columns:
        pairs = pairs.join(names.select(F.col("name").alias(c), F.col("corp").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
    return pairs.distinct()


def with_edges(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges without properties: their ends are their identity, so a repeated load adds nothing."""
    return current.unionByName(incoming.select(current.columns)).distinct()


def with_keyed_edges(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Edges with properties: what comes in replaces the edge of its key."""
    return current.join(incoming.select(*key).distinct(), list(key), "left_anti").unionByName(incoming.select(current.columns))


def scores_written(current: DataFrame, computed: DataFrame, brands: DataFrame) -> DataFrame:
    """brand_score with the computed rows of brands that exist; rows that were not computed again stay."""
    key = ["brand_name", "issue_name", "scorecard_org"]
    fresh = computed.join(brands.select(F.col("name").alias("brand_name")).distinct(), "brand_name", "left_semi")
    return current.join(fresh, key, "left_anti").unionByName(fresh)

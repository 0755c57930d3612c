"""Corporations that share an external id become one; provisional candidates become the real ones they match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def degrees(*edges: tuple[DataFrame, str]) -> DataFrame:
    """(id, degree): edge ends at each node, over (edge table, end column) pairs."""
    ends = None
    for table, column in edges:
        part = table.select(F.col(column).alias("id"))
        ends = part if ends is None else ends.unionAll(part)
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def merge_map(corporations: DataFrame, degree: DataFrame) -> DataFrame:
    """corporations (id, name, qid) -> (id, canonical) for corporations that go: the most linked of a qid stays, then the first name."""
    order = Window.partitionBy("qid").orderBy(F.desc("degree"), "name", "id")
    ranked = corporations.filter("qid is not null and qid <> ''").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranked = ranked.withColumns({"n": F.row_number().over(order), "canonical": F.first("id").over(order)})
    return ranked.filter("n > 1").select("id", "canonical", "name")


def moved(edges: DataFrame, merges: DataFrame, *ends: str) -> DataFrame:
    """Edges with merged ends moved, without new loops and repeats. Loops that were there before stay."""
    out = edges.withColumn("_loop", F.col(ends[0]) == F.col(ends[1])) if len(ends) > 1 else edges
    for end in ends:
        to = merges.select(F.col("id").alias(end), F.col("canonical").alias("_to"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    if len(ends) > 1:
        out = out.filter((F.col(ends[0]) != F.col(ends[1])) | F.col("_loop")).drop("_loop")
    return out.select(edges.columns).distinct()


def merged_aliases(corporations: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, name, aliases) of the corporations that stay; names and aliases of merged ones are added, the own name is not."""
    none = F.array().cast("array<string>")
    gone = corporations.join(merges.select("id", "canonical"), "id").select("canonical", F.concat(F.array("name"), F.coalesce("aliases", none)).alias("more"), "name")
    gone = gone.groupBy(F.col("canonical").alias("id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("name", "more"))), lambda x: x["more"])).alias("more"))
    kept = corporations.join(merges.select("id"), "id", "left_anti").join(gone, "id", "left")
    return kept.select("id", "name", F.array_except(F.array_union(F.coalesce("aliases", none), F.coalesce("more", none)), F.array("name")).alias("aliases"))


def real_candidates(provisional: DataFrame, index: DataFrame) -> DataFrame:
    """provisional (prov_id, name_key, state), index (name_key, state, fec_id) of real candidates -> (prov_id, fec_id), first match."""
    return provisional.join(index, ["name_key", "state"]).groupBy("prov_id").agg(F.min("fec_id").alias("fec_id"))


def moved_ratings(ratings: DataFrame, real: DataFrame) -> DataFrame:
    """ratings (org, candidate, score) with provisional ids replaced; a moved rating replaces the one that was there."""
    found = ratings.join(real, F.col("candidate") == F.col("prov_id"), "left").withColumns({"moved": F.col("fec_id").isNotNull(), "candidate": F.coalesce("fec_id", "candidate")})
    order = Window.partitionBy("org", "candidate").orderBy(F.desc("moved"), F.desc_nulls_last("score"))
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").select("org", "candidate", "score")

"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. Rolling hashes of turn prefixes (two 64-bit ones and the
length) tell which logged conversations are prefixes of longer ones; equal conversations keep the smallest id,
prefixes are removed by anti-join, and what is maximal is rendered.

Turns are ordered by turn number, then role and text where a number repeats. Null roles and texts differ from empty
ones when compared and are rendered as empty. Rows with a null conv_id belong to no conversation and are left out. Only
DataFrame functions are used. Prefixes are made distinct before they are joined, so a conversation or first turn
logged by a third of all conversations is one row there. Repeated rows of a turn are turns of their own; texts of any
length are rendered whole. Other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A rendered turn: what stands before the role, between role and text, and behind the text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _hash(seed: int) -> Column:
    parts = [F.lit(seed), F.col("place"), *(x for c in ("role", "text") for x in (F.coalesce(c, F.lit("")), F.col(c).isNull()))]
    return F.xxhash64(*parts)


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n, p0, p1): for each turn the hashes of the conversation up to it; n: turns in all."""
    by_conversation = Window.partitionBy("conv_id")
    in_order = by_conversation.orderBy("turn", "role", "text")
    rolling = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(in_order))
    placed = placed.withColumns({"h0": _hash(17), "h1": _hash(4242)})
    rows = placed.withColumns({"n": F.count(F.lit(1)).over(by_conversation), "p0": F.bit_xor("h0").over(rolling), "p1": F.bit_xor("h1").over(rolling)})
    return rows.select("conv_id", "place", "n", "p0", "p1")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged): conversations that are no prefix of a longer one; n_logged equal ones were logged."""
    rows = turn_prefixes(turns)
    whole = rows.filter("place = n").groupBy("n", "p0", "p1").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    shorter = rows.filter("place < n").select(F.col("place").cast("long").alias("n"), "p0", "p1").distinct()
    return whole.join(shorter, ["n", "p0", "p1"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_logged")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged, rendered): the maximal conversations as one text each."""
    lines = turns.join(maximal_conversations(turns), "conv_id").groupBy("conv_id", "n_turns", "n_logged").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    return lines.select("conv_id", "n_turns", "n_logged", F.array_join(F.transform("turns", line), "").alias("rendered"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return rendered(common.table(spark, sf_dir, "conversations"))


OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_logged, turns FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM w))
SELECT conv_id, len(turns) AS n_turns, n_logged,
  array_to_string(list_transform(turns, lambda t: '{OPEN}' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM w WHERE turns NOT IN (SELECT turns FROM p)
"""

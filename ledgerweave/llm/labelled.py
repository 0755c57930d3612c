"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most most[label] labelled documents of each label whose crc32(doc_id) mod parts is not held.

    Which ones is decided by a hash of the id, so they are spread over the labelled rows; a doc_id with several
    labels has the greatest one. Rows with a null id or label are not used.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter((fold("doc_id", parts) != held) & F.col("label").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    zero, one = (rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in sorted(most.items()))
    rows = zero.unionAll(one)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(F.broadcast(rows), "doc_id")  # at most sum(most) rows of two numbers

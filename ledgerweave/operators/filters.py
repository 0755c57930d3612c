"""Row filters of the campaign-finance tables."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.names import EXECUTIVE_TITLES, strip

#: Transaction types that support a candidate.
SUPPORT = ("24K", "24Z")


def has_sponsor(connected_org: Column) -> Column:
    name = strip(F.coalesce(connected_org, F.lit("")))
    return (name != "") & (F.upper(name) != "NONE")


def corporate_pacs(committees: DataFrame) -> DataFrame:
    """Committees with a connected organisation, or of the corporate interest group."""
    group = strip(F.coalesce("interest_group_category", F.lit("")))
    return committees.filter(has_sponsor(F.col("connected_org_name")) | (group == "C"))


def supported(contributions: DataFrame, column: str = "transaction_type") -> DataFrame:
    """Direct and in-kind support; the type keeps its spacing."""
    return contributions.filter(strip(F.coalesce(column, F.lit(""))).isin(*SUPPORT))


def by_executives(contributions: DataFrame, titles: Sequence[str] = EXECUTIVE_TITLES) -> DataFrame:
    text = F.lower(F.coalesce("occupation", F.lit("")))
    hit = F.lit(False)
    for title in titles:
        hit = hit | F.contains(text, F.lit(title))
    return contributions.filter(hit)


def in_list(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """None: no filter; an empty list: no row."""
    return df if values is None else df.filter(F.col(column).isin(*values) if values else F.lit(False))


def name_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    """Without regard to case; % and _ mean themselves; '' fits all."""
    return df.filter(F.contains(F.lower(column), F.lower(F.lit(part))))


#: A posting: a run of GRAM characters of a lower-cased name, in one of POSTING_BUCKETS buckets.
GRAM, POSTING_BUCKETS = 3, 64
POSTING = "gram string, name string, bucket int"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(POSTING_BUCKETS)).cast("int").alias("bucket")


def name_postings(names: DataFrame) -> DataFrame:
    """names (name) -> POSTING: each name under each run of GRAM characters that it holds. A run that a third of all names
    hold has as many rows, in one bucket and several files; it is no group that anything gathers."""
    text = F.lower("name")
    places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1))
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))
    return names.select("name").filter("name is not null").distinct().select("name", F.explode(grams).alias("gram")).select("gram", "name", _bucket(F.col("gram")))


def names_with(postings: DataFrame, part: str) -> DataFrame | None:
    """(name) of the names that hold part. Only the posting lists of its runs are read, and what has them all is looked at.

    None for fewer than GRAM characters: these need a scan. Spark's own lower() decides what a letter's small form is.
    """
    spark = postings.sparkSession
    low = spark.range(1).select(F.lower(F.lit(part)).alias("part")).first()["part"]  # one row
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return None
    buckets = sorted({zlib.crc32(g.encode()) % POSTING_BUCKETS for g in grams})
    rows = postings.filter(F.col("bucket").isin(*buckets) & F.col("gram").isin(*grams))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).filter(F.contains(F.lower("name"), F.lit(low))).select("name")

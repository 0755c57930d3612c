"""Loads of node and edge tables: current snapshot and incoming rows in, next snapshot out, with each column's own rule.

Incoming rows repeat at will: of rows with one key the last (by load_seq, where there is one) counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.filters import corporate_pacs
from ledgerweave.operators.upserts import by_corporation, last_write, renamed, unknown, upsert, with_edges, with_endpoints, with_keyed_edges

BRAND = "name string, amazon_slug string, aliases array<string>"
CORPORATION = "name string, ticker string, cik string, jurisdiction string, oc_id string, qid string, aliases array<string>"
CANDIDATE = "candidate_id string, name string, party string, office string, state string, aliases array<string>, provisional boolean"
COMMITTEE = "committee_id string, name string, type string, org_type string, connected_org string"
PERSON = "contributor_id string, name string, title string"
LINKAGE = "candidate_id string, committee_id string, linkage_id string, designation string, type string"


def _once(rows: DataFrame, *key: str) -> DataFrame:
    order = [F.desc("load_seq")] if "load_seq" in rows.columns else [F.lit(0)]
    return last_write(rows.dropna(subset=list(key)), key, order).drop("load_seq")


def brands(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, amazon_slug, aliases): the slug is overwritten, aliases unless none come."""
    return upsert(current, _once(incoming, "name"), "name", keep_if_null=("aliases",))


def corporations(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry columns are overwritten even by null, the qid is kept if none comes, aliases are no part of the load."""
    new = _once(incoming, "name").withColumn("aliases", F.lit(None).cast("array<string>"))
    return upsert(current, new, "name", keep_if_null=("aliases",), keep_if_empty=("qid",))


def subsidiaries(current: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (child, parent) by name or alias; both ends must be known corporations (id, name, aliases)."""
    return with_edges(current, by_corporation(pairs.select("child", "parent"), known, "child", "parent"))


def candidates(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Filed candidates (candidate_id, candidate_name, party, office, office_state): a changed name joins the aliases in front."""
    new = _once(incoming, "candidate_id").select("candidate_id", F.col("candidate_name").alias("name"), "party", "office", F.col("office_state").alias("state"))
    named = renamed(current.select("candidate_id", "name", "aliases"), new.select("candidate_id", "name"), "candidate_id")
    rest = upsert(current.select("candidate_id", "party", "office", "state"), new.drop("name"), "candidate_id")
    old = current.select("candidate_id", "provisional").join(new.select("candidate_id", F.lit(True).alias("_filed")), "candidate_id", "full")
    return named.join(rest, "candidate_id").join(old.withColumn("provisional", F.coalesce("provisional", F.lit(False))).drop("_filed"), "candidate_id").select(current.columns)


def provisional_candidates(current: DataFrame, ratings: DataFrame) -> DataFrame:
    """Candidates made from ratings (fec_id, candidate_name, state, party) that no filed candidate fits."""
    rows = ratings.withColumnsRenamed({"fec_id": "candidate_id", "candidate_name": "name"})
    made = _once(rows.select("candidate_id", "name", "state", "party", *(c for c in rows.columns if c == "load_seq")), "candidate_id")
    made = made.select("candidate_id", "name", "party", F.lit(None).cast("string").alias("office"), "state", F.lit(None).cast("array<string>").alias("aliases"), F.lit(True).alias("provisional"))
    return upsert(current, made, "candidate_id", keep_if_null=("office", "aliases", "party"))


def committees(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Committee master rows, overwritten as they come."""
    return upsert(current, _once(incoming, "committee_id").select("committee_id", F.col("committee_name").alias("name"), "type", F.col("interest_group_category").alias("org_type"), F.col("connected_org_name").alias("connected_org")), "committee_id")


def stored_pacs(stored: DataFrame) -> DataFrame:
    """(committee, connected_org): corporate committees among those stored, without reading the files again."""
    rows = stored.select("committee_id", F.col("connected_org").alias("connected_org_name"), F.col("org_type").alias("interest_group_category"))
    return corporate_pacs(rows).select(F.col("committee_id").alias("committee"), F.coalesce("connected_org_name", F.lit("")).alias("connected_org"))


def pacs(current: DataFrame, pairs: DataFrame, known: DataFrame, stored: DataFrame) -> DataFrame:
    """pairs (corp, committee), corp by name or alias; the committee must be stored."""
    found = by_corporation(pairs.select("corp", "committee"), known, "corp")
    return with_edges(current, found.join(stored.select(F.col("committee_id").alias("committee")).distinct(), "committee", "left_semi"))


def linkages(current: DataFrame, incoming: DataFrame, known_candidates: DataFrame, known_committees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, rows of unknown candidates): one edge for a linkage_id and its ends, which must exist."""
    rows = incoming.select(F.col("cand_id").alias("candidate_id"), F.col("cmte_id").alias("committee_id"), "linkage_id", F.col("cmte_dsgn").alias("designation"), F.col("cmte_tp").alias("type"), *(c for c in incoming.columns if c == "load_seq"))
    key = ("candidate_id", "committee_id", "linkage_id")
    new = with_endpoints(_once(rows, *key), known_candidates, "candidate_id", known_committees, "committee_id")
    return with_keyed_edges(current, new, key), unknown(rows, known_candidates, "candidate_id")


def persons(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(contributor_id, name, title), overwritten as they come."""
    return upsert(current, _once(incoming, "contributor_id").select("contributor_id", "name", "title"), "contributor_id")


def executives(current: DataFrame, pairs: DataFrame, known_persons: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (contributor_id, corp) by the corporation's exact name, not by alias."""
    found = pairs.join(known.select(F.col("name").alias("corp"), F.col("id").alias("_id")), "corp").select("contributor_id", F.col("_id").alias("corp"))
    return with_edges(current, found.join(known_persons.select("contributor_id").distinct(), "contributor_id", "left_semi"))


def ratings(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(org, candidate, score, year): one rating of a candidate by a scorecard, the last that was loaded."""
    return with_keyed_edges(current, _once(incoming, "org", "candidate").select(current.columns), ("org", "candidate"))

"""Serving queries over the graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.names import score_class
from ledgerweave.operators.filters import in_list, name_contains

#: Rows of a money trail, and of the graph view, at most: features of these answers.
TRAIL_ROWS, VIEW_ROWS = 100, 200


def brand_scores(scores: DataFrame, brand: str, issues: Sequence[str] | None = None, orgs: Sequence[str] | None = None) -> DataFrame:
    rows = in_list(in_list(scores.filter(F.col("brand_name") == brand), "issue_name", issues), "scorecard_org", orgs)
    return rows.orderBy("issue_name", "scorecard_org")


def search_scores(scores: DataFrame, part: str, issues: Sequence[str] | None = None, orgs: Sequence[str] | None = None) -> DataFrame:
    rows = in_list(in_list(name_contains(scores, "brand_name", part), "issue_name", issues), "scorecard_org", orgs)
    return rows.orderBy("brand_name", "issue_name", "scorecard_org")


def search_named(scores: DataFrame, named: DataFrame, issues: Sequence[str] | None = None, orgs: Sequence[str] | None = None) -> DataFrame:
    """The same for brands (name) that an index has found."""
    rows = in_list(in_list(scores.join(named.select(F.col("name").alias("brand_name")), "brand_name", "left_semi"), "issue_name", issues), "scorecard_org", orgs)
    return rows.orderBy("brand_name", "issue_name", "scorecard_org")


def leading_gifts(gifts: DataFrame, giver: str, count: int = TRAIL_ROWS) -> DataFrame:
    """Each corporation's count first gifts in a trail's order (amount, giver, candidate), with all that tie with the last.

    Spark limits the groups before it shuffles them, so at most count rows a corporation and task are sent.
    """
    order = Window.partitionBy("corp").orderBy(F.desc_nulls_first("amount"), giver, "candidate")
    return gifts.withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= count).drop("_rank")


def _above_threshold(rows: DataFrame, count: int) -> DataFrame:
    """Rows whose amount is among the count first amounts, unknown ones first; all rows where there are fewer."""
    least = rows.select("amount").orderBy(F.desc_nulls_first("amount")).limit(count).agg(F.count(F.lit(1)).alias("_all"), F.min("amount").alias("_least"))  # one row
    known = F.col("_least").isNotNull() & (F.col("amount") >= F.col("_least"))
    return rows.join(F.broadcast(least), (F.col("_all") < count) | F.col("amount").isNull() | known).drop("_all", "_least")


def money_trail(trails: DataFrame, gifts: DataFrame, rates: DataFrame, covers: DataFrame, giver: str, issues: Sequence[str] | None = None) -> DataFrame:
    """trails (brand, corp), gifts (corp, giver, candidate, amount, tran): the greatest amounts, unknown ones first, in a total order.

    A rank join: every gift to a candidate who is rated on an asked issue gives a row or more, so only each
    corporation's leading gifts can be shown, and of these only amounts down to the last one that is shown if each gives
    one row. Trails, ratings and issues are joined to what is left.
    """
    covers = in_list(covers, "issue", issues)
    shown = rates.join(covers.select("org").distinct(), "org", "left_semi")
    rated = gifts.join(shown.select("candidate").distinct(), "candidate", "left_semi").join(trails.select("corp").distinct(), "corp", "left_semi")
    leading = _above_threshold(trails.join(leading_gifts(rated, giver), "corp"), TRAIL_ROWS)
    rows = leading.join(shown, "candidate").join(covers, "org").select("brand", "corp", giver, "candidate", "amount", "tran", "score", "org", "issue")
    return rows.orderBy(F.desc_nulls_first("amount"), "brand", "corp", giver, "candidate", "org", "issue", "tran").limit(TRAIL_ROWS)


def view_rows(owned: DataFrame, ancestors: DataFrame, pacs: DataFrame, gifts: DataFrame) -> DataFrame:
    """(brand, corp, anc, committee, candidate): what the graph view shows, the first VIEW_ROWS in order."""
    rows = owned.join(ancestors, ["brand"]).join(pacs.withColumnRenamed("corp", "anc"), "anc", "left").join(gifts.select("committee", "candidate").distinct(), "committee", "left")
    columns = ["brand", "corp", "anc", "committee", "candidate"]
    return rows.select(*columns).distinct().orderBy(*columns).limit(VIEW_ROWS)


def _ids(rows: DataFrame) -> DataFrame:
    tag = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))  # noqa: E731  null stays null
    return rows.select(tag("brand", "brand").alias("b"), tag("corp", "corp").alias("c"), tag("corp", "anc").alias("a"), tag("comm", "committee").alias("m"), tag("cand", "candidate").alias("d"))


def view_nodes(rows: DataFrame) -> DataFrame:
    kinds = F.array(*(F.struct(F.col(c).alias("id"), F.lit(k).alias("type")) for c, k in (("b", "brand"), ("c", "corporation"), ("a", "corporation"), ("m", "committee"), ("d", "candidate"))))
    return _ids(rows).select(F.explode(kinds).alias("n")).select("n.id", "n.type").filter("id is not null").distinct()


def view_links(rows: DataFrame) -> DataFrame:
    """An ancestor is linked from the owned corporation itself, not hop by hop."""
    link = lambda s, t, k: F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(k).alias("type"))
    links = F.array(link("b", "c", "OWNED_BY"), F.when(F.col("a") != F.col("c"), link("c", "a", "SUBSIDIARY_OF")), link("a", "m", "OPERATES_PAC"), link("m", "d", "CONTRIBUTED_TO"))
    return _ids(rows).select(F.explode(links).alias("l")).select("l.*").filter("source is not null and target is not null").distinct()


def headline(scores: DataFrame) -> DataFrame:
    """Each brand's issue farthest from 50, and its class; ties go to the first issue and scorecard."""
    best = scores.groupBy("brand_name").agg(F.min_by(F.struct("issue_name", "scorecard_org", "score"), F.struct(-F.abs(F.col("score") - 50), "issue_name", "scorecard_org")).alias("h"))
    return best.select("brand_name", "h.issue_name", "h.scorecard_org", "h.score", score_class(F.col("h.score")).alias("score_class"))

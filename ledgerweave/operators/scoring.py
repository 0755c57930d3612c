"""Dollar-weighted issue scores with confidence tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.plans.scratch import work_dir, written

MONEY, POINTS = "decimal(38,2)", "decimal(12,6)"
#: Trails (brand and committee) that are broadcast, at most.
MOST_SENT = 1 << 20
#: Ratings that a task groups, at most about.
TASK_RATINGS = 1 << 19


def confidence(dollars: Column, candidates: Column) -> Column:
    return F.when((dollars > 100_000) & (candidates >= 5), "high").when((dollars > 10_000) | (candidates >= 2), "medium").otherwise("low")


def _metrics(sums: DataFrame) -> DataFrame:
    """sums: brand, issue, org, rated_dollars and dollars in cents, weighted (cents times points), rated_n, plain, candidates."""
    mean = F.when(F.col("rated_dollars") == 0, F.col("plain").cast("double") / F.col("rated_n")).otherwise(F.try_divide(F.col("weighted").cast("double"), F.col("rated_dollars").cast("double")))
    dollars = (F.col("dollars").cast("decimal(36,2)") / 100).cast(MONEY)
    tier = F.when(F.col("dollars") == 0, "low").otherwise(confidence(dollars, F.col("candidates")))
    return sums.filter("rated_n > 0").select(
        F.col("brand").alias("brand_name"), F.col("issue").alias("issue_name"), F.col("org").alias("scorecard_org"),
        F.round(mean, 1).alias("score"), dollars.cast("double").alias("dollars"), "candidates", tier.alias("confidence"),
    )


def _scores(parts: DataFrame) -> DataFrame:
    """parts: brand, issue, org, candidate, score, dollars, n (paths), one row for each candidate or path.

    Sums are exact: dollars in whole cents, scores in millionths, as decimals, so a score hangs on no order of rows.
    """
    value, cents = F.col("score").try_cast(POINTS), (F.col("dollars") * 100).cast("decimal(25,0)")
    rated = value.isNotNull()
    return _metrics(parts.groupBy("brand", "issue", "org").agg(
        F.sum(F.when(rated, cents)).alias("rated_dollars"),
        F.sum(F.when(rated, cents * value)).alias("weighted"),
        F.sum(F.when(rated, F.col("n"))).alias("rated_n"),
        F.sum(F.when(rated, F.col("n").cast("decimal(20,0)") * value)).alias("plain"),
        F.sum(cents).alias("dollars"),
        F.countDistinct("candidate").alias("candidates"),
    ))


def money(column: str = "amount") -> Column:
    """Dollars exact to the cent; what is no number counts as nothing."""
    return F.coalesce(F.col(column).try_cast(MONEY), F.lit(0).cast(MONEY))


def naive_scores(trails: DataFrame, pacs: DataFrame, contributions: DataFrame, rates: DataFrame, covers: DataFrame) -> DataFrame:
    """The definition: every trail, contribution, rating and covered issue is one row.

    Contributions and ratings meet by candidate before trails and issues multiply them, in as many tasks as the session
    has for a shuffle: AQE, which sees contributions and not paths, would take few. Issues and trails (up to MOST_SENT)
    are sent to where the candidates are, so that no path is shuffled, be it by its scorecard or to count candidates.
    """
    parts = int(contributions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gifts = contributions.select("committee", "candidate", "amount").repartition(parts, "candidate")
    ends = written(trails.join(pacs, "corp").select("brand", "committee"), work_dir(trails.sparkSession, "trails"))
    ends = F.broadcast(ends) if ends.count() <= MOST_SENT else ends
    paths = gifts.join(rates, "candidate").join(F.broadcast(covers), "org").join(ends, "committee")  # covers: scorecards times issues
    return _scores(paths.select("brand", "issue", "org", "candidate", "score", money().alias("dollars"), F.lit(1).alias("n")))


def factored_scores(counts: DataFrame, pacs: DataFrame, contributions: DataFrame, rates: DataFrame, covers: DataFrame) -> DataFrame:
    """The same result with every end summed before it meets another.

    counts (brand, corp, trails) stands for the trails. Contributions are summed for each committee and candidate, then
    for each brand and candidate; ratings are summed for each candidate and scorecard, so that a brand, scorecard and
    candidate are one row and candidates are counted without a second shuffle; issues join the sums of a brand and
    scorecard. Dollars are whole cents in a long (a sum beyond 9e16 dollars is an error, not a wrong one). n counts
    paths, for the plain mean where dollars cancel.
    """
    sums = contributions.groupBy("committee", "candidate").agg(F.sum((money() * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    by_brand = written(counts.join(pacs, "corp").groupBy("brand", "committee").agg(F.sum("trails").alias("trails")), work_dir(counts.sparkSession, "trails"))
    # dealt by candidate, a brand and candidate are in one task and ratings meet them without another shuffle
    spark = rates.sparkSession
    tasks = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), 1 + rates.count() // TASK_RATINGS)
    sums = sums.join(by_brand, "committee").repartition(tasks, "candidate").groupBy("brand", "candidate").agg(F.sum(F.col("cents") * F.col("trails")).alias("cents"), F.sum(F.col("n") * F.col("trails")).alias("n"))
    value = F.col("score").try_cast(POINTS)
    # few ratings are of one candidate and scorecard, so a scan's task that grouped them would keep all that it reads
    rated = rates.repartition(tasks, "candidate").groupBy("candidate", "org").agg(F.count(F.lit(1)).alias("ratings"), F.count(value).alias("rated"), F.coalesce(F.sum(value), F.lit(0)).cast("decimal(18,6)").alias("points"))
    cents, n, points = F.col("cents"), F.col("n"), F.col("points")
    by_org = sums.join(rated, "candidate").groupBy("brand", "org").agg(
        F.sum(F.when(F.col("rated") > 0, cents * F.col("rated"))).alias("rated_dollars"),
        F.sum(cents.cast("decimal(19,0)") * points).alias("weighted"),
        F.sum(n * F.col("rated")).alias("rated_n"),
        F.sum(n.cast("decimal(19,0)") * points).alias("plain"),
        F.sum(cents * F.col("ratings")).alias("dollars"),
        F.count(F.lit(1)).alias("candidates"),
    )
    return _metrics(by_org.join(covers.select("org", "issue").distinct(), "org"))


def payload(scores: DataFrame, *keys: str) -> DataFrame:
    """(brand_name, payload): issue -> scorecard -> metrics as JSON, keys in order."""
    metric = F.struct("score", "dollars", "candidates", "confidence", *keys)
    by_issue = scores.groupBy("brand_name", "issue_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("scorecard_org").alias("k"), metric.alias("v"))))).alias("m"))
    return by_issue.groupBy("brand_name").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("issue_name").alias("k"), F.to_json("m").alias("v")))))).alias("payload"))

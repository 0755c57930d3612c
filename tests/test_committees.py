"""Queries that reach few committees read and amend what these filed, and paths are counted where their candidate is."""

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import scoring
from ledgerweave.plans import catalogue, projection


@pytest.fixture
def fresh(sf_dir, tmp_path):
    """The tables under a path for which nothing is stored."""
    (tmp_path / "tables").symlink_to(sf_dir)
    return str(tmp_path / "tables")


@pytest.mark.parametrize("name", ["viz_links", "score_search"])
def test_nothing_is_loaded_for_some_committees(spark, sf_dir, fresh, name):
    found = sorted(map(tuple, catalogue.QUERIES[name](spark, fresh).collect()))
    assert (spark.sparkContext.applicationId, fresh) not in projection._LOADED
    assert projection.Domain(spark, fresh).contributions.count()
    catalogue._SERVED.pop((spark.sparkContext.applicationId, fresh), None)
    assert found and found == sorted(map(tuple, catalogue.QUERIES[name](spark, fresh).collect()))  # now from the stored table


def test_contributions_of_some_are_those_of_all(spark, fresh):
    d = projection.Domain(spark, fresh)
    some = d.pacs.filter("committee % 3 = 0").select("committee")
    before = d.contributions_of(some)
    rows = lambda df: sorted(map(str, map(tuple, df.select(sorted(df.columns)).collect())))
    found, dtypes = rows(before), before.dtypes
    assert found == rows(d.contributions.filter("committee % 3 = 0")) == rows(d.contributions_of(some))
    assert dtypes == d.contributions.dtypes
    # orders and lines are dealt by the order; amendments are found where they met
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = d._amended(d._filed())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" in plan and plan.count("hashpartitioning(l_orderkey") == plan.count("hashpartitioning(") == 2


def test_tasks_follow_the_rows(spark, sf_dir, monkeypatch):
    """Appended donations are counted in tasks of a bounded number of rows, whatever their bytes."""
    monkeypatch.setattr(catalogue, "TASK_ROWS", 100)
    n = projection.Domain(spark, sf_dir).donations.count()
    rows = catalogue.QUERIES["append_donations"](spark, sf_dir)
    assert rows.rdd.getNumPartitions() == 1 + 2 * n // 100 and {r["copies"] for r in rows.collect()} == {2}


def test_no_path_is_shuffled(spark):
    trails = spark.createDataFrame([("b", 1, 0), ("b", 2, 1), ("b", 2, 1)], "brand string, corp long, depth int")
    pacs = spark.createDataFrame([(1, 1), (2, 2)], "corp long, committee long")
    gifts = spark.createDataFrame([(1, 7, 10.0), (2, 7, 5.0), (2, 8, None)], "committee long, candidate long, amount double")
    rates = spark.createDataFrame([("o", 7, 50.0), ("o", 8, 70.0), ("p", 8, None)], "org string, candidate long, score double")
    covers = spark.createDataFrame([("o", "i"), ("o", "j"), ("p", "i")], "org string, issue string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = scoring.naive_scores(trails, pacs, gifts, rates, covers)
        assert sorted(map(tuple, rows.drop("confidence").collect())) == [("b", "i", "o", 50.0, 20.0, 2), ("b", "j", "o", 50.0, 20.0, 2)]
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = {x.split("#")[0] for x in plan.split("hashpartitioning(")[1:]}
    assert dealt == {"candidate", "brand"} and "hashpartitioning(brand" in plan
    assert not any("candidate" in x.split(")")[0] and "brand" in x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])
    assert rows.filter(F.col("scorecard_org") == "p").isEmpty()


def test_ratings_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """However many ratings a scan's task reads, tasks of a bounded number of them group them."""
    monkeypatch.setattr(scoring, "TASK_RATINGS", 100)
    counts = spark.createDataFrame([("b", 1, 1)], "brand string, corp long, trails long")
    pacs = spark.createDataFrame([(1, 1)], "corp long, committee long")
    gifts = spark.range(600).select(F.lit(1).cast("long").alias("committee"), F.col("id").alias("candidate"), F.lit(2.0).alias("amount"))
    rates = spark.range(0, 1200, 1, 1).select(F.lit("o").alias("org"), F.floor(F.col("id") / 2).alias("candidate"), (F.col("id") % 2 * 100).cast("double").alias("score"))
    covers = spark.createDataFrame([("o", "i")], "org string, issue string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = scoring.factored_scores(counts, pacs, gifts, rates, covers)
        assert [tuple(r) for r in rows.drop("confidence").collect()] == [("b", "i", "o", 50.0, 2400.0, 600)]
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x.split(")")[0].split(", ") for x in plan.split("hashpartitioning(")[1:]]
    assert [d[1] for d in dealt if d[0].startswith("candidate")] == ["13", "13"]  # what a brand gave, and ratings
    assert not any("org#" in c for d in dealt for c in d if d[0].startswith("candidate"))

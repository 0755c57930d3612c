"""Entity lookups over staged snapshots of public registers: search hits, types, parents, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions.names import qid

HITS = "search array<struct<id: string, label: string, description: string, match: struct<type: string, language: string, text: string>>>"
CELL = "struct<type: string, value: string>"
BINDINGS = f"results struct<bindings: array<struct<item: {CELL}, itemLabel: {CELL}, parent: {CELL}, parentLabel: {CELL}, ticker: {CELL}>>>"
#: Hits kept for a brand; brands kept for a corporation.
MOST_HITS, MOST_BRANDS = 5, 200


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def search_hits(answers: DataFrame) -> DataFrame:
    """answers (query, search) -> (query, position, id, label, alias): alias is the text that matched if it was one."""
    rows = answers.select("query", F.posexplode("search").alias("position", "hit")).filter(F.col("position") < MOST_HITS)
    return rows.select("query", "position", F.col("hit.id").alias("id"), F.col("hit.label").alias("label"), F.when(F.col("hit.match.type") == "alias", F.col("hit.match.text")).alias("alias"))


def bindings(answers: DataFrame) -> DataFrame:
    """(id, name, parent, parent_name, ticker); absent cells are null."""
    row = F.explode("results.bindings").alias("b")
    cells = answers.select(row)
    return cells.select(qid(F.col("b.item.value")).alias("id"), F.col("b.itemLabel.value").alias("name"), qid(F.col("b.parent.value")).alias("parent"), F.col("b.parentLabel.value").alias("parent_name"), F.col("b.ticker.value").alias("ticker"))


def business_hits(hits: DataFrame, businesses: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits that are businesses, with parent and ticker where known, at most MOST_HITS for a query."""
    rows = hits.join(businesses.select("id").distinct(), "id", "left_semi").join(facts.select("id", "parent", "ticker"), "id", "left")
    order = Window.partitionBy("query").orderBy("position", F.col("parent").asc_nulls_last())
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_HITS).drop("n")


def subsidiaries(facts: DataFrame, corporations: DataFrame) -> DataFrame:
    """(corporation, id, name): what names one of the corporations (qid) as its parent; empty names are left out."""
    return facts.filter("coalesce(name, '') <> ''").join(corporations.select(F.col("qid").alias("parent")), "parent").select(F.col("parent").alias("corporation"), "id", "name")


def discovered_brands(facts: DataFrame, businesses: DataFrame, corporations: DataFrame) -> DataFrame:
    """The same for what is no business: brands, at most MOST_BRANDS for a corporation. Ids that do not start with Q are no corporations."""
    owners = corporations.filter(F.startswith("qid", F.lit("Q")))
    rows = subsidiaries(facts, owners).join(businesses.select("id").distinct(), "id", "left_anti")
    order = Window.partitionBy("corporation").orderBy("name", "id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_BRANDS).drop("n")


def owner_chain(facts: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """(start, id, parent): every corporation reachable upwards, once each (a set, not trails), with its parents; at most 2 * most rows each."""
    edges = facts.filter("parent is not null").select("id", "parent").distinct()
    # a step may also stay, so one join takes all that is reached so far one level up, and the plan grows by one join a level
    stay = edges.select("id").unionAll(edges.select("parent")).unionAll(start.select("id")).distinct().select("id", F.col("id").alias("parent"))
    steps = edges.unionByName(stay).distinct()
    reached = start.select(F.col("id").alias("start"), "id").distinct()
    for _ in range(most):
        reached = reached.join(steps, "id").select("start", F.col("parent").alias("id")).distinct()
    order = Window.partitionBy("start").orderBy("id", "parent")
    return reached.join(edges, "id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2 * most).select("start", "id", "parent")


def grouping_statements(statements: DataFrame) -> DataFrame:
    """Ownership statements (predicate, object) of a register."""
    return statements.filter(F.col("predicate").isin("subsidiary_of", "has_subsidiary"))


_COMPANY = "struct<name: string, company_number: string, jurisdiction_code: string, opencorporates_url: string>"
COMPANIES = f"results struct<companies: array<struct<company: {_COMPANY}>>, company: {_COMPANY}>"
GROUPINGS = "results struct<corporate_groupings: array<struct<corporate_grouping: struct<name: string, wikipedia_id: string>>>>"
STATEMENTS = "results struct<statements: array<struct<statement: struct<predicate: string, subject: string, object: string>>>>"


def register_companies(answers: DataFrame, jurisdiction: str | None = None) -> DataFrame:
    """answers (query, results) of company searches -> (query, position, company...); jurisdiction: only companies of this code."""
    rows = answers.select("query", F.posexplode("results.companies").alias("position", "c")).select("query", "position", "c.company.*")
    return rows if jurisdiction is None else rows.filter(F.col("jurisdiction_code") == jurisdiction)


def register_company(answers: DataFrame) -> DataFrame:
    """answers (query, results) of lookups by number -> (query, company...); what was not found has no row."""
    return answers.filter("results.company is not null").select("query", "results.company.*")


def register_grouping(answers: DataFrame) -> DataFrame:
    """answers (query, results) of grouping searches -> (query, name, wikipedia_id): the first grouping found."""
    return answers.select("query", F.get("results.corporate_groupings", F.lit(0))["corporate_grouping"].alias("g")).filter("g is not null").select("query", "g.name", "g.wikipedia_id")


def register_statements(answers: DataFrame) -> DataFrame:
    """answers (query, results) -> (query, predicate, subject, object): statements of ownership."""
    return grouping_statements(answers.select("query", F.explode("results.statements.statement").alias("s")).select("query", "s.*"))

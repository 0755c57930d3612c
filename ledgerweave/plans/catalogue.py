"""Every named query of the engine over the test tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import names
from ledgerweave.operators import dedupe, filters, resolve, scoring, serve, traverse, upserts
from ledgerweave.plans.projection import CYCLES, KEY, Domain, sql
from ledgerweave.plans.scratch import written
from ledgerweave.plans.store import RESOLUTION, SCORE, Store, work_dir
from ledgerweave.sources import bulk, scorecards, seeds
from ledgerweave.streaming import contributions as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BRAND = "Brand#13"


def query(oracle: str | None = None, domain: bool = True):
    """Registers a function of a Domain under its own name; oracle: the final SELECT of its SQL."""

    def register(build: Callable[[Domain], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle) if domain else oracle
        return build

    return register


# --- scores ---------------------------------------------------------------------------------------------------------


def _kept(trails: DataFrame) -> DataFrame:
    """Trails or their counts as a table of their own: they are read for their committees first."""
    return written(trails, work_dir(trails.sparkSession, "trails"))


def _scores(d: Domain) -> DataFrame:
    counts = _kept(traverse.counted_trails(d.owned_by, d.graph))
    return scoring.factored_scores(counts, d.pacs, d.cycle_contributions_of(d.committees_of(counts)), d.rates, d.covers)


@query("SELECT * FROM brand_scores")
def brand_scores(d: Domain) -> DataFrame:
    return _scores(d)


@query("SELECT * FROM brand_scores")
def brand_scores_factored(d: Domain) -> DataFrame:
    """The same with trails counted hop by hop, which needs a graph without cycles: the projection's edges go up a tree."""
    counts = _kept(traverse.acyclic_trail_counts(d.owned_by, d.subsidiaries))
    return scoring.factored_scores(counts, d.pacs, d.cycle_contributions_of(d.committees_of(counts)), d.rates, d.covers)


@query("SELECT * FROM brand_scores")
def brand_scores_naive(d: Domain) -> DataFrame:
    """The definition, path by path, for every brand."""
    trails = _kept(traverse.trails(d.owned_by, d.subsidiaries))
    return scoring.naive_scores(trails, d.pacs, d.cycle_contributions_of(d.committees_of(trails)), d.rates, d.covers)


@query("""SELECT brand_name, issue_name, scorecard_org, score, dollars, candidates, 'low' AS confidence FROM (
  SELECT brand AS brand_name, issue AS issue_name, org AS scorecard_org, round(avg(score), 1) AS score, 0.0::DOUBLE AS dollars, count(DISTINCT candidate) AS candidates
  FROM trails JOIN cycle_contributions ON committee = corp JOIN rates USING (candidate) JOIN covers USING (org) GROUP BY ALL HAVING count(score) > 0)""")
def brand_scores_zero_dollar(d: Domain) -> DataFrame:
    """Every brand, with every amount nothing: the plain mean over paths."""
    counts = _kept(traverse.counted_trails(d.owned_by, d.graph))
    nothing = d.cycle_contributions_of(d.committees_of(counts)).withColumn("amount", F.lit(0).cast("decimal(18,2)"))
    return scoring.factored_scores(counts, d.pacs, nothing, d.rates, d.covers)


@query("""SELECT committee, month, CAST(dollars AS DOUBLE) AS dollars, candidates,
  CASE WHEN dollars > 100000 AND candidates >= 5 THEN 'high' WHEN dollars > 10000 OR candidates >= 2 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT committee, strftime(l_shipdate, '%Y-%m') AS month, sum(amount) AS dollars, count(DISTINCT candidate) AS candidates FROM contributions GROUP BY ALL)""")
def confidence_tiers(d: Domain) -> DataFrame:
    groups = d.contributions.groupBy("committee", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("amount").alias("dollars"), F.countDistinct("candidate").alias("candidates"))
    return groups.select("committee", "month", F.col("dollars").cast("double").alias("dollars"), "candidates", scoring.confidence(F.col("dollars"), F.col("candidates")).alias("confidence"))


@query("SELECT brand, corp, depth FROM trails")
def ownership_trails(d: Domain) -> DataFrame:
    return traverse.trails(d.owned_by, d.subsidiaries)


@query("SELECT DISTINCT brand, corp FROM trails WHERE depth <= 5")
def ancestors_5hop(d: Domain) -> DataFrame:
    return traverse.trails(d.owned_by, d.subsidiaries, traverse.VIEW_HOPS).select("brand", "corp").distinct()


@query("SELECT brand, corp, m AS trails FROM trail_counts")
def trail_multiplicity(d: Domain) -> DataFrame:
    return traverse.counted_trails(d.owned_by, d.graph)


_SERVED: dict[tuple[str, str], str] = {}


def _run_scores(d: Domain) -> DataFrame:
    """Computes and stores the scores of every brand; later lookups of this application read what is stored."""
    key = d.spark.sparkContext.applicationId, d.sf_dir
    store = Store(d.spark, _SERVED.get(key) or work_dir(d.spark))
    rows = store.write_scores(_scores(d), d.owned_by.select(F.col("brand").alias("name")), CYCLES)
    _SERVED[key] = store.root  # only what is written is served
    return rows


def _stored_scores(d: Domain) -> DataFrame:
    root = _SERVED.get((d.spark.sparkContext.applicationId, d.sf_dir))
    rows = Store(d.spark, root).need("brand_score", SCORE) if root else _run_scores(d)
    return rows.drop("cycles", "computed_at")


@query(f"SELECT *, '{','.join(map(str, CYCLES))}' AS cycles, true AS dated FROM brand_scores")
def write_brand_scores(d: Domain) -> DataFrame:
    """The scoring step: compute, upsert, and what is stored then."""
    return _run_scores(d).withColumn("cycles", F.array_join("cycles", ",")).withColumn("dated", F.col("computed_at").isNotNull()).drop("computed_at")


# --- serving --------------------------------------------------------------------------------------------------------


def _one_brand(d: Domain) -> DataFrame:
    return d.owned_by.filter(F.col("brand") == BRAND)


@query("""SELECT brand, corp, committee, candidate, CAST(amount AS DOUBLE) AS amount, tran, score, org, issue
  FROM trails JOIN contributions ON committee = corp JOIN rates USING (candidate) JOIN covers USING (org) WHERE brand = 'Brand#13'
  ORDER BY contributions.amount DESC NULLS FIRST, brand, corp, committee, candidate, org, issue, tran LIMIT 100""")
def pac_trail_top100(d: Domain) -> DataFrame:
    trails = _kept(traverse.trails(_one_brand(d), d.subsidiaries))
    gifts = d.contributions_of(d.committees_of(trails)).join(d.pacs, "committee")
    rows = serve.money_trail(trails, gifts, d.rates, d.covers, "committee")
    return rows.withColumn("amount", F.col("amount").cast("double"))


@query("""SELECT brand, corp, person, candidate, CAST(amount AS DOUBLE) AS amount, tran, score, org, issue
  FROM trails JOIN executives USING (corp) JOIN donations USING (person) JOIN rates USING (candidate) JOIN covers USING (org) WHERE brand = 'Brand#13'
  ORDER BY donations.amount DESC NULLS FIRST, brand, corp, person, candidate, org, issue, tran LIMIT 100""")
def exec_trail_top100(d: Domain) -> DataFrame:
    rows = serve.money_trail(traverse.trails(_one_brand(d), d.subsidiaries), d.executives.join(d.donations, "person"), d.rates, d.covers, "person")
    return rows.withColumn("amount", F.col("amount").cast("double"))


_VIEW = """v AS (SELECT DISTINCT o.brand, o.corp, t.corp AS anc, p.id AS committee, c.candidate FROM owned_by o JOIN (SELECT DISTINCT brand, corp FROM trails WHERE depth <= 5) t USING (brand)
  LEFT JOIN corporation p ON p.id = t.corp LEFT JOIN (SELECT DISTINCT committee, candidate FROM contributions) c ON c.committee = p.id
  WHERE o.brand = 'Brand#13' ORDER BY 1, 2, 3, 4 NULLS FIRST, 5 NULLS FIRST LIMIT 200)"""


def _view(d: Domain) -> DataFrame:
    trails = _kept(traverse.trails(_one_brand(d), d.subsidiaries, traverse.VIEW_HOPS).select("brand", "corp").distinct())
    return serve.view_rows(_one_brand(d), trails.withColumnRenamed("corp", "anc"), d.pacs, d.contributions_of(d.committees_of(trails)))


@query(f"""SELECT * FROM (WITH {_VIEW}
  SELECT 'brand:' || brand AS id, 'brand' AS type FROM v UNION SELECT 'corp:' || corp, 'corporation' FROM v UNION SELECT 'corp:' || anc, 'corporation' FROM v
  UNION SELECT 'comm:' || committee, 'committee' FROM v WHERE committee IS NOT NULL UNION SELECT 'cand:' || candidate, 'candidate' FROM v WHERE candidate IS NOT NULL)""")
def viz_nodes(d: Domain) -> DataFrame:
    return serve.view_nodes(_view(d))


@query(f"""SELECT * FROM (WITH {_VIEW}
  SELECT 'brand:' || brand AS source, 'corp:' || corp AS target, 'OWNED_BY' AS type FROM v UNION SELECT 'corp:' || corp, 'corp:' || anc, 'SUBSIDIARY_OF' FROM v WHERE anc <> corp
  UNION SELECT 'corp:' || anc, 'comm:' || committee, 'OPERATES_PAC' FROM v WHERE committee IS NOT NULL
  UNION SELECT 'comm:' || committee, 'cand:' || candidate, 'CONTRIBUTED_TO' FROM v WHERE candidate IS NOT NULL)""")
def viz_links(d: Domain) -> DataFrame:
    return serve.view_links(_view(d))


@query("SELECT * FROM brand_scores WHERE brand_name = 'Brand#13' AND issue_name IN ('BUILDING', 'MACHINERY')")
def score_lookup(d: Domain) -> DataFrame:
    return serve.brand_scores(_stored_scores(d), BRAND, ["BUILDING", "MACHINERY"])


@query("SELECT * FROM brand_scores WHERE contains(lower(brand_name), '#1') AND scorecard_org IN ('ASIA')")
def score_search(d: Domain) -> DataFrame:
    return serve.search_scores(_stored_scores(d), "#1", orgs=["ASIA"])


@query("SELECT * FROM brand_scores WHERE contains(lower(brand_name), 'nd#2') AND issue_name IN ('BUILDING', 'MACHINERY')")
def score_search_indexed(d: Domain) -> DataFrame:
    """A search by the stored index of brand names."""
    scores, store = _stored_scores(d), Store(d.spark, work_dir(d.spark))
    store.write_name_index("brand_name_index", d.owned_by.select(F.col("brand").alias("name")))
    return serve.search_named(scores, store.named("brand_name_index", "ND#2"), ["BUILDING", "MACHINERY"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed b') OR contains(lower(p_name), 'almond')", domain=False)
def part_search_indexed(d: Domain) -> DataFrame:
    """Names that hold either of two texts, by posting lists."""
    parts, store = d.table("part").select("p_partkey", "p_name"), Store(d.spark, work_dir(d.spark))
    store.write_name_index("part_index", parts.select(F.col("p_name").alias("name")))
    found = store.named("part_index", "ed b").union(store.named("part_index", "ALMOND")).distinct()
    return parts.join(found.select(F.col("name").alias("p_name")), "p_name", "left_semi").select("p_partkey", "p_name")


@query("""SELECT brand_name, issue_name, scorecard_org, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS score_class
  FROM (SELECT *, row_number() OVER (PARTITION BY brand_name ORDER BY abs(score - 50) DESC, issue_name, scorecard_org) AS n FROM brand_scores) WHERE n = 1""")
def headline_issue(d: Domain) -> DataFrame:
    return serve.headline(_stored_scores(d))


@query("SELECT org, candidate, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' WHEN score IS NOT NULL THEN 'low' END AS score_class FROM rates")
def score_class(d: Domain) -> DataFrame:
    return d.rates.select("org", "candidate", names.score_class(F.col("score")).alias("score_class"))


@query("SELECT brand_name, issue_name, scorecard_org, score, dollars, candidates, confidence FROM brand_scores")
def json_payload(d: Domain) -> DataFrame:
    """The payload of every brand, read again from its JSON with all metrics."""
    text = "map<string, string>"
    rows = scoring.payload(_stored_scores(d)).select("brand_name", F.explode(F.from_json("payload", text)).alias("issue_name", "orgs"))
    rows = rows.select("brand_name", "issue_name", F.explode(F.from_json("orgs", "map<string, struct<score: double, dollars: double, candidates: bigint, confidence: string>>")).alias("scorecard_org", "m"))
    return rows.select("brand_name", "issue_name", "scorecard_org", "m.*")


# --- filters --------------------------------------------------------------------------------------------------------


@query("SELECT committee, candidate, tran, transaction_type FROM contribution_rows WHERE trim(transaction_type) IN ('24K', '24Z')")
def supported_contributions(d: Domain) -> DataFrame:
    return filters.supported(d.contribution_rows).select("committee", "candidate", "tran", "transaction_type")


@query("""SELECT s_suppkey AS committee, CASE WHEN s_suppkey % 3 = 0 THEN 'None' WHEN s_suppkey % 3 = 1 THEN s_name ELSE ' ' END AS connected_org_name, CASE WHEN s_suppkey % 4 = 0 THEN ' C ' ELSE 'L' END AS interest_group_category
  FROM supplier WHERE s_suppkey % 3 = 1 OR s_suppkey % 4 = 0""", domain=False)
def corporate_pacs(d: Domain) -> DataFrame:
    i = F.col("s_suppkey")
    rows = d.table("supplier").select(i.alias("committee"), F.when(i % 3 == 0, "None").when(i % 3 == 1, F.col("s_name")).otherwise(" ").alias("connected_org_name"), F.when(i % 4 == 0, " C ").otherwise("L").alias("interest_group_category"))
    return filters.corporate_pacs(rows)


@query("""SELECT event_id, event_type || CASE event_id % 4 WHEN 0 THEN ' Vice President' WHEN 1 THEN ' Partner' WHEN 2 THEN ' Clerk' ELSE ' Codirector' END AS occupation FROM events WHERE event_id % 4 <> 2""", domain=False)
def executive_filter(d: Domain) -> DataFrame:
    i = F.col("event_id") % 4
    title = F.when(i == 0, " Vice President").when(i == 1, " Partner").when(i == 2, " Clerk").otherwise(" Codirector")
    return filters.by_executives(d.table("events").select("event_id", F.concat("event_type", title).alias("occupation")))


@query("SELECT committee, candidate, tran, \"cycle\" FROM cycle_contributions")
def cycle_filter(d: Domain) -> DataFrame:
    return filters.in_list(d.contributions, "cycle", CYCLES).select("committee", "candidate", "tran", "cycle")


# --- upserts --------------------------------------------------------------------------------------------------------


@query("SELECT committee, candidate, tran, CAST(amount AS DOUBLE) AS amount, \"cycle\", transaction_type FROM contributions")
def amendment_last_write(d: Domain) -> DataFrame:
    return d.amended_contributions.select("committee", "candidate", "tran", F.col("amount").cast("double").alias("amount"), "cycle", "transaction_type")


@query("SELECT committee, candidate, tran, CAST(amount AS DOUBLE) AS amount, \"cycle\" FROM contributions")
def streamed_contributions(d: Domain) -> DataFrame:
    """Every filed contribution in three sets of files, each merged by a query that starts where the last one stopped."""
    root = work_dir(d.spark, "stream")
    rows = d.contribution_rows
    # one pass over the tables writes all sets; each is then put where the stream looks
    filed = written(rows.withColumn("set", F.pmod(F.xxhash64("tran", "l_partkey"), F.lit(3)).cast("int")), f"{root}/filed", by=("set",))
    for k in range(3):
        filed.filter(F.col("set") == k).drop("set").write.mode("append").parquet(f"{root}/in")
        table = stream.merge_available(d.spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", rows.schema, KEY, ("l_shipdate", "amount", "l_partkey"))
    return table.select("committee", "candidate", "tran", F.col("amount").cast("double").alias("amount"), "cycle")


@query("""WITH o AS (SELECT s_name AS name, 'T' || s_suppkey AS ticker, 'Q' || s_suppkey AS qid FROM supplier WHERE s_suppkey % 3 <> 0),
  n AS (SELECT s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'N' || s_suppkey END AS ticker, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'QN' || s_suppkey END AS qid FROM supplier WHERE s_suppkey % 2 = 0)
  SELECT coalesce(n.name, o.name) AS name, CASE WHEN n.name IS NOT NULL THEN n.ticker ELSE o.ticker END AS ticker, coalesce(nullif(n.qid, ''), o.qid) AS qid FROM o FULL JOIN n ON o.name = n.name""", domain=False)
def upsert_preserve_null(d: Domain) -> DataFrame:
    """Tickers are overwritten even by null; an empty qid leaves the old one."""
    i, s = F.col("s_suppkey"), d.table("supplier")
    old = s.filter(i % 3 != 0).select(F.col("s_name").alias("name"), F.concat(F.lit("T"), i).alias("ticker"), F.concat(F.lit("Q"), i).alias("qid"))
    new = s.filter(i % 2 == 0).select(F.col("s_name").alias("name"), F.when(i % 4 != 0, F.concat(F.lit("N"), i)).alias("ticker"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("QN"), i)).alias("qid"))
    return upserts.upsert(old, new, "name", keep_if_empty=("qid",))


#: Rows that a task sorts and counts, at most about.
TASK_ROWS = 1 << 19


@query("SELECT person, candidate, tran, count(*) AS copies FROM (SELECT * FROM donations UNION ALL SELECT * FROM donations) JOIN candidate USING (candidate) GROUP BY ALL")
def append_donations(d: Domain) -> DataFrame:
    """Appended twice: two copies of each."""
    rows = d.donations.unionAll(d.donations)
    # AQE deals by compressed bytes, of which a task's memory is many times: both sides are dealt by the number of rows.
    # An inner join with each candidate once: Spark would move a semi-join below the union, and sort there.
    tasks = 1 + rows.count() // TASK_ROWS
    known = d.candidates.select("candidate").repartition(tasks, "candidate").distinct()
    rows = rows.repartition(tasks, "candidate").join(known, "candidate")
    return rows.groupBy("person", "candidate", "tran").agg(F.count(F.lit(1)).alias("copies"))


@query("""SELECT c_custkey AS candidate, CASE WHEN c_custkey % 4 = 0 THEN 'New ' || c_name ELSE c_name END AS name,
  CASE WHEN c_custkey % 4 = 0 THEN c_name || '|' ELSE '' END || 'Old ' || c_name AS aliases FROM customer""", domain=False)
def alias_accumulate(d: Domain) -> DataFrame:
    name, key = F.col("c_name"), F.col("c_custkey").alias("candidate")
    rows = d.table("customer")
    old = rows.select(key, name.alias("name"), F.array(F.concat(F.lit("Old "), name)).alias("aliases"))
    new = rows.filter("c_custkey % 2 = 0").select(key, F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("New "), name)).otherwise(name).alias("name"))
    return upserts.renamed(old, new, "candidate").withColumn("aliases", F.array_join("aliases", "|"))


@query("""SELECT brand_name, issue_name, scorecard_org, CASE WHEN issue_name = 'BUILDING' THEN 1.0::DOUBLE ELSE score END AS score FROM brand_scores WHERE issue_name <> 'MACHINERY'
  UNION ALL SELECT brand_name, 'stale', scorecard_org, 0.0::DOUBLE FROM brand_scores WHERE issue_name = 'MACHINERY'""")
def stale_scores_kept(d: Domain) -> DataFrame:
    """Rows that were not computed again stay as they are; a computed brand that does not exist is not written."""
    scores = _scores(d).select("brand_name", "issue_name", "scorecard_org", "score")
    current = scores.withColumn("issue_name", F.when(F.col("issue_name") == "MACHINERY", "stale").otherwise(F.col("issue_name"))).withColumn("score", F.when(F.col("issue_name") == "stale", 0.0).otherwise(F.col("score")))
    fresh = scores.filter("issue_name = 'BUILDING'").withColumn("score", F.lit(1.0))
    return upserts.scores_written(current, fresh.unionByName(fresh.withColumn("brand_name", F.lit("nobody"))), d.owned_by.select(F.col("brand").alias("name")))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT p_brand AS source, s_suppkey AS corp FROM part JOIN supplier ON
  (p_partkey % 2 = 0 AND s_name = 'Supplier#' || lpad(CAST(p_partkey % 10 AS VARCHAR), 9, '0')) OR (p_partkey % 2 = 1 AND 'alias ' || s_suppkey = 'alias ' || (p_partkey % 10))""", domain=False)
def alias_join(d: Domain) -> DataFrame:
    corporations = d.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias "), F.col("s_suppkey"))).alias("aliases"))
    i = F.col("p_partkey")
    wanted = F.when(i % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((i % 10).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("alias "), i % 10))
    return upserts.alias_edges(d.table("part").select(F.col("p_brand").alias("source"), wanted.alias("corp_name")), corporations)


@query("SELECT person, candidate, tran FROM donations WHERE candidate IN (SELECT candidate FROM candidate) AND person IN (SELECT person FROM executives WHERE corp % 2 = 0)")
def endpoint_semi(d: Domain) -> DataFrame:
    return upserts.with_endpoints(d.donations, d.executives.filter("corp % 2 = 0"), "person", d.candidates, "candidate").select("person", "candidate", "tran")


@query("SELECT person, candidate, tran FROM donations WHERE candidate NOT IN (SELECT candidate FROM candidate WHERE candidate % 3 <> 0)")
def unknown_candidate_anti(d: Domain) -> DataFrame:
    return upserts.unknown(d.donations, d.candidates.filter("candidate % 3 <> 0"), "candidate").select("person", "candidate", "tran")


@query("SELECT DISTINCT p_brand AS brand FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 3 <> 0", domain=False)
def negative_cache_anti(d: Domain) -> DataFrame:
    """Brands without a cached answer; a cached null is an answer."""
    brands = d.owned_by.select("brand")
    cache = brands.filter(F.substr("brand", F.lit(7)).cast("int") % 3 == 0)
    return upserts.unknown(brands, cache, "brand")


# --- deduplication --------------------------------------------------------------------------------------------------

_MERGE = """deg AS (SELECT id, count(*) AS degree FROM (SELECT child AS id FROM subsidiary_of UNION ALL SELECT parent FROM subsidiary_of UNION ALL SELECT corp FROM owned_by) GROUP BY id),
  q AS (SELECT id, name, row_number() OVER w AS n, first_value(id) OVER w AS canonical FROM (SELECT c.*, coalesce(degree, 0) AS degree FROM corporation c LEFT JOIN deg USING (id) WHERE id % 7 < 3)
    WINDOW w AS (PARTITION BY id // 7 ORDER BY degree DESC, name, id)),
  merges AS (SELECT id, canonical, name FROM q WHERE n > 1)"""


def _merges(d: Domain) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    corporations = d.corporations.withColumns({"qid": F.when(i % 7 < 3, F.concat(F.lit("Q"), F.floor(i / 7))), "aliases": F.array(F.concat(F.lit("alias "), i))})
    degree = dedupe.degrees((d.subsidiaries, "child"), (d.subsidiaries, "parent"), (d.owned_by, "corp"))
    return corporations, dedupe.merge_map(corporations, degree)


@query(f"SELECT * FROM (WITH {_MERGE} SELECT * FROM merges)")
def corp_dedup_map(d: Domain) -> DataFrame:
    return _merges(d)[1]


@query(f"""SELECT * FROM (WITH {_MERGE}, m AS (SELECT coalesce(a.canonical, child) AS child, coalesce(b.canonical, parent) AS parent FROM subsidiary_of LEFT JOIN merges a ON a.id = child LEFT JOIN merges b ON b.id = parent)
  SELECT DISTINCT child, parent FROM m WHERE child <> parent)""")
def corp_dedup_edges(d: Domain) -> DataFrame:
    return dedupe.moved(d.subsidiaries, _merges(d)[1], "child", "parent")


@query(f"""SELECT * FROM (WITH {_MERGE}, l AS (SELECT canonical AS id, string_agg(name || '|alias ' || id, '|' ORDER BY name) AS more FROM merges GROUP BY canonical)
  SELECT id, name, 'alias ' || id || coalesce('|' || more, '') AS aliases FROM corporation LEFT JOIN l USING (id) WHERE id NOT IN (SELECT id FROM merges))""")
def corp_dedup_aliases(d: Domain) -> DataFrame:
    corporations, merges = _merges(d)
    return dedupe.merged_aliases(corporations, merges).withColumn("aliases", F.array_join("aliases", "|"))


@query("""SELECT org, candidate, score FROM (SELECT org, CASE WHEN candidate % 10 = 3 AND candidate + 1 IN (SELECT candidate FROM candidate) THEN candidate + 1 ELSE candidate END AS candidate, score,
  candidate % 10 = 3 AND candidate + 1 IN (SELECT candidate FROM candidate) AS moved FROM rates) QUALIFY row_number() OVER (PARTITION BY org, candidate ORDER BY moved DESC, score DESC NULLS LAST) = 1""")
def reconcile_provisional(d: Domain) -> DataFrame:
    """Candidates that end in 3 are provisional and turn out to be the next one."""
    key = F.col("candidate")
    provisional = d.candidates.filter(key % 10 == 3).select(key.alias("prov_id"), (key + 1).cast("string").alias("name_key"), F.lit("").alias("state"))
    index = d.candidates.filter(key % 10 != 3).select(key.cast("string").alias("name_key"), F.lit("").alias("state"), key.alias("fec_id"))
    return dedupe.moved_ratings(d.rates, dedupe.real_candidates(provisional, index))


@query("SELECT id, count(*) AS degree FROM (SELECT child AS id FROM subsidiary_of UNION ALL SELECT parent FROM subsidiary_of UNION ALL SELECT corp FROM owned_by) GROUP BY id")
def relationship_degree(d: Domain) -> DataFrame:
    return dedupe.degrees((d.subsidiaries, "child"), (d.subsidiaries, "parent"), (d.owned_by, "corp"))


# --- names ----------------------------------------------------------------------------------------------------------

_RAW_COMPANY = "'  ' || replace(p_name, ' ', '  ') || CASE p_partkey % 6 WHEN 0 THEN ' Holdings Corp.' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' & Co' WHEN 3 THEN ' GROUP' WHEN 4 THEN ' Ltd. Company' ELSE '-Tech LLC' END"


def _raw_company(d: Domain) -> DataFrame:
    i = F.col("p_partkey") % 6
    end = F.when(i == 0, " Holdings Corp.").when(i == 1, ", Inc.").when(i == 2, " & Co").when(i == 3, " GROUP").when(i == 4, " Ltd. Company").otherwise("-Tech LLC")
    return d.table("part").select("p_partkey", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  ")), end).alias("raw"))


def _company_sql() -> str:
    out = f"trim(lower({_RAW_COMPANY}))"
    for suffix in names.COMPANY_SUFFIXES:
        out = f"trim(regexp_replace({out}, '{suffix}', ''))"
    return f"trim(regexp_replace(regexp_replace({out}, '[^a-z0-9_\\s-]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_company_sql()} AS name FROM part", domain=False)
def normalize_company(d: Domain) -> DataFrame:
    return _raw_company(d).select("p_partkey", names.company_key(F.col("raw")).alias("name"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug FROM part", domain=False)
def slug(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", names.slug(F.col("p_name")).alias("slug"))


@query("""SELECT c_custkey, 'PROV_' || 'CA' || '_' || upper(trim(regexp_replace(lower('.' || c_name || ' ' || c_mktsegment || '!'), '[^a-z0-9]+', '_', 'g'), '_')) AS prov_id FROM customer""", domain=False)
def provisional_ids(d: Domain) -> DataFrame:
    name = F.concat(F.lit("."), F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit("!"))
    return d.table("customer").select("c_custkey", names.provisional_id(name, F.lit("CA")).alias("prov_id"))


@query("SELECT p_partkey, p_name AS brand FROM part", domain=False)
def brand_text_cleanup(d: Domain) -> DataFrame:
    i = F.col("p_partkey") % 3
    text = F.when(i == 0, F.concat(F.lit(" Visit the "), "p_name", F.lit(" Store"))).when(i == 1, F.concat(F.lit("brand: "), "p_name")).otherwise(F.col("p_name"))
    return d.table("part").select("p_partkey", names.brand_text(text).alias("brand"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN 70.0::DOUBLE WHEN 2 THEN p_size + 0.5::DOUBLE WHEN 3 THEN NULL ELSE 0.0::DOUBLE END AS score FROM part""", domain=False)
def grade_to_score(d: Domain) -> DataFrame:
    i = F.col("p_partkey") % 5
    raw = F.when(i == 0, "A+").when(i == 1, " B- ").when(i == 2, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).when(i == 3, "A++").otherwise("F")
    return d.table("part").select("p_partkey", names.score_value(raw).alias("score"))


@query("SELECT s_suppkey, 'Q' || s_suppkey AS qid FROM supplier", domain=False)
def qid_from_uri(d: Domain) -> DataFrame:
    return d.table("supplier").select("s_suppkey", names.qid(F.concat(F.lit("http://www.example.org/entity/Q"), "s_suppkey")).alias("qid"))


# people: customers as 'MARKETSEGMENT, FIRST MIDDLE SUFFIX'; given names follow the key
_GIVEN = ("ANN", "BENJAMIN", "CARLA", "TIMOTHY", "EVA", "FRED", "GINA")


def _filed(d: Domain) -> DataFrame:
    key = F.col("c_custkey")
    given = F.element_at(F.array(*(F.lit(g) for g in _GIVEN)), (key % 7 + 1).cast("int"))
    last = F.concat(F.lit("L"), F.floor(key / 4))
    name = F.when(key % 5 == 0, F.concat(last, F.lit(", H "), given)).when(key % 5 == 1, F.concat(last, F.lit(", "), given, F.lit(" JR"))).when(key % 5 == 2, F.concat(last, F.lit(", "), given, F.lit(" TED"))).when(key % 5 == 3, F.concat(last, F.lit(", "), given)).otherwise(last)
    return d.table("customer").select(key.cast("string").alias("fec_id"), name.alias("name"), F.lit("CA").alias("state"))


_GIVEN_SQL = f"(['{"','".join(g.lower() for g in _GIVEN)}'])[CAST(c_custkey % 7 + 1 AS INT)]"
_LAST_SQL = "'l' || (c_custkey // 4)"
_FILED_SQL = f"CASE WHEN c_custkey % 5 = 4 THEN {_LAST_SQL} WHEN c_custkey % 5 = 2 THEN {_GIVEN_SQL} || ' ted ' || {_LAST_SQL} ELSE {_GIVEN_SQL} || ' ' || {_LAST_SQL} END"
_INDEX_SQL = f"""SELECT {_FILED_SQL} AS name_key, 'CA' AS state, CAST(c_custkey AS VARCHAR) AS fec_id FROM customer
  UNION SELECT 'ted ' || {_LAST_SQL}, 'CA', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 5 = 2"""


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS fec_id, {_FILED_SQL} AS name_key FROM customer", domain=False)
def fec_name_normalize(d: Domain) -> DataFrame:
    return _filed(d).select("fec_id", names.filed_name(F.col("name"), names.plain).alias("name_key"))


@query(_INDEX_SQL, domain=False)
def candidate_index(d: Domain) -> DataFrame:
    return resolve.candidate_index(_filed(d), names.plain)


@query(f"""WITH i AS ({_INDEX_SQL}), r AS (SELECT c_custkey AS rating_id, 'Tim L' || (c_custkey // 4) AS candidate_name, 'tim' AS given, 'l' || (c_custkey // 4) AS last FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'Eva L' || (c_custkey // 4 + c_custkey % 3), 'eva', 'l' || (c_custkey // 4 + c_custkey % 3) FROM customer WHERE c_custkey % 2 = 1),
  e AS (SELECT name_key, list(DISTINCT fec_id) AS ids FROM i GROUP BY 1),
  two AS (SELECT split_part(name_key, ' ', 1) AS given, split_part(name_key, ' ', 2) AS last, list(DISTINCT fec_id) AS ids FROM i WHERE length(name_key) - length(replace(name_key, ' ', '')) = 1 GROUP BY ALL),
  j AS (SELECT r.*, e.ids, (SELECT count(*) FROM two WHERE two.last = r.last) AS n, (SELECT count(*) FROM two WHERE two.last = r.last AND (starts_with(two.given, r.given) OR starts_with(r.given, two.given))) AS near
    FROM r LEFT JOIN e ON e.name_key = r.given || ' ' || r.last)
  SELECT rating_id, ids[1] AS fec_id, false AS provisional, 'exact' AS outcome FROM j WHERE len(ids) = 1
  UNION ALL SELECT rating_id, unnest(two.ids), false, 'last_name' FROM j JOIN two USING (last) WHERE j.ids IS NULL AND (n = 1 OR (n > 1 AND near = 1 AND (starts_with(two.given, j.given) OR starts_with(j.given, two.given))))
  UNION ALL SELECT rating_id, 'PROV_CA_' || upper(given || '_' || last), true, 'provisional' FROM j WHERE ids IS NULL AND (n = 0 OR (n > 1 AND near = 0))""", domain=False)
def resolve_ratings(d: Domain) -> DataFrame:
    """A rating for every customer."""
    key = F.col("c_custkey")
    name = F.when(key % 2 == 0, F.concat(F.lit("Tim L"), F.floor(key / 4))).otherwise(F.concat(F.lit("Eva L"), F.floor(key / 4) + key % 3))
    ratings = d.table("customer").select(key.alias("rating_id"), name.alias("candidate_name"), F.lit("ca").alias("state"))
    return resolve.resolved_ratings(ratings, resolve.candidate_index(_filed(d), names.plain), names.plain)


# --- similarity -----------------------------------------------------------------------------------------------------


@query()
def similarity_join(d: Domain) -> DataFrame:
    """Every supplier as a query."""
    key = F.col("s_suppkey")
    asked = d.table("supplier").select(F.concat("s_name", F.when(key % 4 == 0, " Inc.").when(key % 4 == 2, " x").when(key % 4 == 1, " Corp").otherwise(" y")).alias("query"))
    return resolve.similar_companies(asked, d.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("position")))


@query()
def misspelt_parts(d: Domain) -> DataFrame:
    """Every part's name without one of its characters, against all names: ratios below 1, ties by the smaller key."""
    name, i = F.col("p_name"), F.col("p_partkey") % F.length("p_name")
    asked = d.table("part").select(F.concat(F.substring(name, F.lit(1), i.cast("int")), F.substring(name, (i + 2).cast("int"), F.length(name))).alias("query"))
    return resolve.similar_companies(asked, d.table("part").groupBy("p_name").agg(F.min("p_partkey").alias("position")).withColumnRenamed("p_name", "name"))


def _hits(d: Domain) -> DataFrame:
    """Five hits for a brand; labels and aliases are the brand with a suffix, or share no character with it."""
    i = F.col("s_suppkey")
    return d.table("supplier").select(
        F.concat(F.lit("Supplier "), F.floor(i / 5)).alias("brand"), (i % 2 + 1).cast("int").alias("source"), (i % 5).alias("position"),
        F.when(i % 3 == 0, F.concat(F.lit("Supplier "), F.floor(i / 5), F.lit(" Ltd"))).otherwise("xyz").alias("label"), F.when(i % 4 == 0, F.concat(F.lit("supplier "), F.floor(i / 5))).alias("alias"), F.concat(F.lit("Q"), i).alias("id"),
    )


_HITS = """hits AS (SELECT 'Supplier ' || (s_suppkey // 5) AS brand, CAST(s_suppkey % 2 + 1 AS INT) AS source, s_suppkey % 5 AS position,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Supplier ' || (s_suppkey // 5) || ' Ltd' ELSE 'xyz' END AS label, CASE WHEN s_suppkey % 4 = 0 THEN 'supplier ' || (s_suppkey // 5) END AS alias, 'Q' || s_suppkey AS id,
    CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM supplier)"""


@query(f"WITH {_HITS} SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, source, position) AS rank FROM hits", domain=False)
def scored_candidates(d: Domain) -> DataFrame:
    return resolve.scored_candidates(_hits(d))


_WATERFALL = """brands AS (SELECT brand, min(id) AS position FROM hits GROUP BY brand), asked AS (SELECT * FROM brands WHERE brand NOT IN (SELECT brand FROM cached)),
  first AS (SELECT brand, arg_min(id, position) AS id, 1 AS source FROM hits WHERE source = 1 AND score >= 0.7 AND brand IN (SELECT brand FROM asked) GROUP BY brand),
  spent AS (SELECT brand FROM asked WHERE brand NOT IN (SELECT brand FROM first) AND brand IN (SELECT brand FROM hits WHERE source = 2) ORDER BY position LIMIT 20),
  second AS (SELECT brand, arg_min(id, position) AS id, 2 AS source FROM hits WHERE source = 2 AND score >= 0.7 AND brand IN (SELECT brand FROM spent) GROUP BY brand),
  found AS (SELECT * FROM first UNION ALL SELECT * FROM second)
  SELECT * FROM cached UNION ALL SELECT * FROM found UNION ALL SELECT brand, NULL, NULL FROM asked WHERE brand NOT IN (SELECT brand FROM found)"""


def _waterfall(d: Domain, retry_nulls: bool) -> DataFrame:
    hits = _hits(d)
    brands = hits.groupBy("brand").agg(F.min("id").alias("position"))
    store = Store(d.spark, work_dir(d.spark))
    store.write("resolution", d.spark.createDataFrame([("Supplier 1", "Q99", 1), ("Supplier 2", None, None)], RESOLUTION))
    return resolve.brand_waterfall(brands, hits, store.resolutions(retry_nulls))


@query(f"WITH {_HITS}, cached(brand, id, source) AS (VALUES ('Supplier 1', 'Q99', 1), ('Supplier 2', NULL, NULL)), {_WATERFALL}", domain=False)
def brand_waterfall(d: Domain) -> DataFrame:
    """Cached answers stay, those without a match too."""
    return _waterfall(d, False)


@query(f"WITH {_HITS}, cached(brand, id, source) AS (VALUES ('Supplier 1', 'Q99', 1)), {_WATERFALL}", domain=False)
def retry_nulls(d: Domain) -> DataFrame:
    """Cached answers without a match are asked again."""
    return _waterfall(d, True)


@query("SELECT s_name AS name, 'Q' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '01' END AS qid FROM supplier", domain=False)
def enrich_qid(d: Domain) -> DataFrame:
    corporations = d.table("supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Q"), "s_suppkey")).alias("qid"))
    hits = d.table("supplier").select(F.col("s_name").alias("name"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"), "s_suppkey")
    hits = hits.select("name", "position", F.when(F.col("position") == 0, "Other").otherwise(F.concat("name", F.lit(" Corp"))).alias("label"), F.concat(F.lit("http://www.example.org/entity/Q"), "s_suppkey", F.lit("0"), "position").alias("uri"))
    return resolve.first_similar(corporations, hits)


def _values(table: str, columns: str, rows) -> str:
    """A SELECT over literal rows."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS {table}({columns})"


# --- sources --------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 >= 5 THEN 'CA' WHEN c_custkey % 10 >= 2 THEN 'NY' END AS state FROM customer""", domain=False)
def carry_forward_state(d: Domain) -> DataFrame:
    """The same over every customer."""
    i = F.col("c_custkey") % 10
    lines = d.table("customer").withColumn("marker", F.when(i == 0, "House").when(i == 2, "New York").when(i == 5, "California"))
    return scorecards.carried_state(lines, "c_custkey", "marker").select("c_custkey", "state")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 4 <> 0", domain=False)
def pipe_parse(d: Domain) -> DataFrame:
    """Short lines are left out, further fields cut off."""
    i = F.col("p_partkey")
    line = F.when(i % 4 == 0, F.concat_ws("|", i, "p_name")).when(i % 4 == 1, F.concat_ws("|", i, "p_name", "p_brand", F.lit("more"))).otherwise(F.concat_ws("|", i, "p_name", "p_brand"))
    return bulk.split_lines(d.table("part").select(line.alias("line")), "line", ["p_partkey", "p_name", "p_brand"]).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("""SELECT 'Org' AS org_name, 1998 AS year, 'labor' AS issue, c_name AS candidate_name, 'CA' AS state, CASE WHEN c_custkey % 3 = 0 THEN 95.0::DOUBLE ELSE CAST(c_nationkey AS DOUBLE) END AS score, NULL AS party
  FROM customer WHERE c_custkey % 3 <> 1""", domain=False)
def json_ratings(d: Domain) -> DataFrame:
    i = F.col("c_custkey") % 3
    rating = F.struct(F.col("c_name").alias("candidate_name"), F.lit(" CA").alias("state"), F.when(i == 0, "A").when(i == 1, "n/v").otherwise(F.col("c_nationkey").cast("string")).alias("score"))
    # a file for each segment and slice of customers, so that none grows with a segment
    slice_ = F.floor(F.col("c_custkey") / 1000).alias("slice")
    files = d.table("customer").groupBy("c_mktsegment", slice_).agg(F.collect_list(rating).alias("ratings")).select(F.lit(None).cast("int").alias("year"), F.lit("labor").alias("issue"), "ratings")
    return scorecards.json_ratings(files, "Org", 1998, "environment").withColumn("party", F.col("party"))


@query(_values("corporation", "name, ticker, fortune100_rank, sector", [(n, t or None, k, s) for k, (n, t, s) in enumerate(seeds.rows(seeds.CORPORATIONS), 1)]), domain=False)
def seed_corporations(d: Domain) -> DataFrame:
    return seeds.corporations(d.spark)


@query(
    f"""WITH c AS ({_values("c", "org_name, issue_name", [(o, i) for o, _, issues in seeds.rows(seeds.SCORECARDS) for i in issues.split()])}),
  i AS ({_values("i", "issue_name, description", seeds.rows(seeds.ISSUES))}), s AS ({_values("s", "org_name, methodology_url", [r[:2] for r in seeds.rows(seeds.SCORECARDS)])})
  SELECT org_name, issue_name, description, methodology_url FROM c JOIN i USING (issue_name) JOIN s USING (org_name)""",
    domain=False,
)
def seed_coverage(d: Domain) -> DataFrame:
    return seeds.covers(d.spark).join(seeds.issues(d.spark), F.col("issue_name") == F.col("name")).join(seeds.scorecards(d.spark), "org_name").select("org_name", "issue_name", "description", "methodology_url")


@query(_values("b", "name", [(b,) for b in seeds.BRANDS.strip().splitlines()]), domain=False)
def seed_brands(d: Domain) -> DataFrame:
    return seeds.brands(d.spark)


from ledgerweave.plans import load_catalogue  # noqa: E402, F401  registers the queries of the load steps

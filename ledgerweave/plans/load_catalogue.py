"""Queries of the load steps, the file readers and the register lookups, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import names
from ledgerweave.operators import loads, resolve, upserts
from ledgerweave.plans.catalogue import query
from ledgerweave.plans.projection import KEY, Domain
from ledgerweave.plans.store import CYCLE_LOAD, Store, work_dir
from ledgerweave.sources import bulk, entities, scorecards


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _suppliers(d: Domain) -> DataFrame:
    return d.table("supplier")


def _known(d: Domain) -> DataFrame:
    """Corporations by supplier, with one alias."""
    i = F.col("s_suppkey")
    return _suppliers(d).select(i.alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias "), i)).alias("aliases"))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("aliases", F.array_join("aliases", "|"))


# --- loads ----------------------------------------------------------------------------------------------------------


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'new-' || s_suppkey ELSE 'old-' || s_suppkey END AS amazon_slug,
  CASE WHEN s_suppkey % 4 = 0 THEN 'new' WHEN s_suppkey % 3 = 0 THEN 'old' END AS aliases FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""", domain=False)
def load_brands(d: Domain) -> DataFrame:
    """Slugs are overwritten; aliases only if some come."""
    i = F.col("s_suppkey")
    name = F.col("s_name").alias("name")
    old = _suppliers(d).filter(i % 3 == 0).select(name, F.concat(F.lit("old-"), i).alias("amazon_slug"), F.array(F.lit("old")).alias("aliases"))
    new = _suppliers(d).filter(i % 2 == 0).select(name, F.concat(F.lit("new-"), i).alias("amazon_slug"), F.when(i % 4 == 0, F.array(F.lit("new"))).alias("aliases"))
    return _flat(loads.brands(old, new.unionAll(new)))


@query("""SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'T' || s_suppkey END AS ticker, CASE WHEN s_suppkey % 4 = 0 THEN 'QN' || s_suppkey ELSE 'Q' || s_suppkey END AS qid,
  'alias ' || s_suppkey AS aliases FROM supplier""", domain=False)
def load_corporations(d: Domain) -> DataFrame:
    """Tickers are overwritten even by null, an empty qid and the aliases are not."""
    i = F.col("s_suppkey")
    old = _suppliers(d).select(F.col("s_name").alias("name"), F.concat(F.lit("T"), i).alias("ticker"), *(_no_text().alias(c) for c in ("cik", "jurisdiction", "oc_id")), F.concat(F.lit("Q"), i).alias("qid"), F.array(F.concat(F.lit("alias "), i)).alias("aliases"))
    new = old.filter(F.substr("qid", F.lit(2)).cast("int") % 2 == 0).select("name", _no_text().alias("ticker"), "cik", "jurisdiction", "oc_id", F.when(F.substr("qid", F.lit(2)).cast("int") % 4 == 0, F.concat(F.lit("QN"), F.substr("qid", F.lit(2)))).otherwise("").alias("qid"))
    return _flat(loads.corporations(old, new).select("name", "ticker", "qid", "aliases"))


@query("""SELECT DISTINCT a.s_suppkey AS child, b.s_suppkey AS parent FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2 WHERE a.s_suppkey % 5 <> 0
  UNION SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey % 7 = 0""", domain=False)
def load_subsidiaries(d: Domain) -> DataFrame:
    """Both ends by name or alias; those that name no corporation go, and what is there already stays once."""
    i = F.col("s_suppkey")
    parent = F.floor(i / 2)
    pairs = _suppliers(d).select(
        F.when(i % 5 == 0, "nobody").when(i % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("alias "), i)).alias("child"),
        F.when(i % 3 == 0, F.concat(F.lit("alias "), parent)).otherwise(F.concat(F.lit("Supplier#"), F.lpad(parent.cast("string"), 9, "0"))).alias("parent"),
    )
    current = _suppliers(d).filter(i % 7 == 0).select(i.alias("child"), F.lit(0).cast("long").alias("parent"))
    return loads.subsidiaries(current, pairs.unionAll(pairs), _known(d))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS candidate_id, CASE WHEN c_custkey % 4 = 0 THEN 'New ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'REP' ELSE 'DEM' END AS party,
  CASE WHEN c_custkey % 2 = 0 THEN 'NY' ELSE 'CA' END AS state, CASE WHEN c_custkey % 4 = 0 THEN c_name || '|' ELSE '' END || 'Old' AS aliases, c_custkey % 2 = 1 AND c_custkey % 3 = 0 AS provisional FROM customer""", domain=False)
def load_candidates(d: Domain) -> DataFrame:
    """A changed name goes to the front of the aliases, the office's state becomes the state, a filed candidate is not provisional."""
    key = F.col("c_custkey")
    old = d.table("customer").select(key.cast("string").alias("candidate_id"), F.col("c_name").alias("name"), F.lit("DEM").alias("party"), F.lit("H").alias("office"), F.lit("CA").alias("state"), F.array(F.lit("Old")).alias("aliases"), ((key % 3 == 0) & (key % 2 == 1)).alias("provisional"))
    new = d.table("customer").filter(key % 2 == 0).select(key.cast("string").alias("candidate_id"), F.when(key % 4 == 0, F.concat(F.lit("New "), "c_name")).otherwise(F.col("c_name")).alias("candidate_name"), F.lit("REP").alias("party"), F.lit("S").alias("office"), F.lit("NY").alias("office_state"))
    return _flat(loads.candidates(old, new).drop("office"))


@query("""SELECT 'PROV_CA_' || c_nationkey AS candidate_id, max_by('Name ' || c_custkey, c_custkey) AS name, 'CA' AS state, true AS provisional FROM customer GROUP BY c_nationkey
  UNION ALL SELECT 'real', 'Real', 'NY', false""", domain=False)
def load_provisional(d: Domain) -> DataFrame:
    """One candidate for an id, as it was rated last; filed ones stay."""
    old = d.spark.createDataFrame([("real", "Real", None, None, "NY", None, False)], loads.CANDIDATE)
    rows = d.table("customer").select(F.concat(F.lit("PROV_CA_"), "c_nationkey").alias("fec_id"), F.concat(F.lit("Name "), "c_custkey").alias("candidate_name"), F.lit("CA").alias("state"), _no_text().alias("party"), F.col("c_custkey").alias("load_seq"))
    return loads.provisional_candidates(old, rows).select("candidate_id", "name", "state", "provisional")


def _committees(d: Domain) -> DataFrame:
    """As filed: organisations with a sponsor, none, and 'NONE'."""
    i = F.col("s_suppkey")
    return _suppliers(d).select(
        F.concat(F.lit("C"), i).alias("committee_id"), F.concat(F.lit("PAC of "), "s_name").alias("committee_name"), F.lit("Q").alias("type"),
        F.when(i % 4 == 0, "C").otherwise("L").alias("interest_group_category"), F.when(i % 3 == 0, "NONE").when(i % 3 == 1, F.concat("s_name", F.lit(" Inc."))).otherwise("").alias("connected_org_name"),
    )


_COMMITTEES = """SELECT 'C' || s_suppkey AS committee_id, 'PAC of ' || s_name AS name, 'Q' AS type, CASE WHEN s_suppkey % 4 = 0 THEN 'C' ELSE 'L' END AS org_type,
  CASE s_suppkey % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN s_name || ' Inc.' ELSE '' END AS connected_org FROM supplier"""


@query(_COMMITTEES, domain=False)
def load_committees(d: Domain) -> DataFrame:
    old = d.spark.createDataFrame([("C1", "stale", "X", "X", "X")], loads.COMMITTEE)
    return loads.committees(old, _committees(d))


def _stored_committees(d: Domain) -> DataFrame:
    return loads.committees(d.spark.createDataFrame([], loads.COMMITTEE), _committees(d))


@query(f"SELECT committee_id AS committee, connected_org FROM ({_COMMITTEES}) WHERE connected_org NOT IN ('', 'NONE') OR org_type = 'C'", domain=False)
def stored_pacs(d: Domain) -> DataFrame:
    """Corporate committees from what is stored, without the files."""
    return loads.stored_pacs(_stored_committees(d))


@query("SELECT s_suppkey AS corp, 'C' || s_suppkey AS committee FROM supplier WHERE s_suppkey % 3 = 1", domain=False)
def pac_linkage(d: Domain) -> DataFrame:
    """Stored committees' organisations, by similarity, to corporations: here each is a corporation's name with a suffix."""
    known, stored = _known(d), _stored_committees(d)
    found = resolve.pac_sponsors(loads.stored_pacs(stored), known.select("name", F.col("id").alias("position")))
    return loads.pacs(d.spark.createDataFrame([], "corp long, committee string"), found.select(F.col("name").alias("corp"), "committee"), known, stored)


@query("""SELECT c_custkey AS candidate, s_suppkey AS committee, 'L' || c_custkey AS linkage, c_custkey % 3 <> 0 AS known FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 3 = 0 OR s_suppkey IS NOT NULL""", domain=False)
def load_linkages(d: Domain) -> DataFrame:
    """Edges whose ends exist, and the rows of candidates that are not known (every third)."""
    i = F.col("s_suppkey")
    key = F.col("c_custkey")
    rows = d.table("customer").select(key.cast("string").alias("cand_id"), key.cast("string").alias("cmte_id"), F.concat(F.lit("L"), key).alias("linkage_id"), F.lit("P").alias("cmte_dsgn"), F.lit("H").alias("cmte_tp"))
    people = d.table("customer").filter(key % 3 != 0).select(key.cast("string").alias("candidate_id"))
    groups = _suppliers(d).select(i.cast("string").alias("committee_id"))
    linked, missing = loads.linkages(d.spark.createDataFrame([], loads.LINKAGE), rows.unionAll(rows), people, groups)
    missing = missing.distinct().join(groups.select("committee_id", F.col("committee_id").alias("group")), "committee_id", "left").withColumn("committee_id", F.col("group"))
    parts = (part.select(F.col("candidate_id").cast("long").alias("candidate"), F.col("committee_id").cast("long").alias("committee"), F.col("linkage_id").alias("linkage"), F.lit(known).alias("known")) for part, known in ((linked, True), (missing, False)))
    return next(parts).unionAll(next(parts))


@query("SELECT c_custkey AS contributor_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'CEO' ELSE 'Clerk' END AS title FROM customer", domain=False)
def load_persons(d: Domain) -> DataFrame:
    rows = d.table("customer").select(F.col("c_custkey").alias("contributor_id"), F.col("c_name").alias("name"), F.lit("Clerk").alias("title"))
    return loads.persons(rows, rows.filter("contributor_id % 2 = 0").withColumn("title", F.lit("CEO")))


@query("SELECT s_suppkey AS contributor_id, s_suppkey AS corp FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey IN (SELECT c_custkey FROM customer)", domain=False)
def load_executives(d: Domain) -> DataFrame:
    """By exact name only: an alias names no corporation here."""
    i = F.col("s_suppkey")
    pairs = _suppliers(d).select(i.alias("contributor_id"), F.when(i % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("alias "), i)).alias("corp"))
    people = d.table("customer").select(F.col("c_custkey").alias("contributor_id"))
    return loads.executives(d.spark.createDataFrame([], "contributor_id long, corp long"), pairs, people, _known(d))


@query("""SELECT r.org, r.candidate, CASE WHEN r.candidate % 2 = 0 THEN 1.0::DOUBLE ELSE r.score END AS score, CASE WHEN r.candidate % 2 = 0 THEN 1999 ELSE 1998 END AS year, c.name || CASE WHEN r.candidate % 2 = 0 THEN '|Nick' ELSE '' END AS names FROM rates r JOIN candidate c USING (candidate)""")
def load_ratings(d: Domain) -> DataFrame:
    """One rating for a scorecard and candidate, the last one; the name that was used joins the aliases."""
    old = d.rates.withColumn("year", F.lit(1998))
    new = old.filter("candidate % 2 = 0").withColumns({"year": F.lit(1999), "load_seq": F.explode(F.array(F.lit(1), F.lit(2)))}).withColumn("score", F.when(F.col("load_seq") == 2, 1.0).otherwise(0.0))
    people = d.candidates.select("candidate", F.array("name").alias("aliases"))
    named = upserts.with_rated_names(people, new.select("candidate", F.lit("Nick").alias("candidate_name")), "candidate").select("candidate", F.array_join("aliases", "|").alias("names"))
    return loads.ratings(old, new).join(named, "candidate")


@query("SELECT * FROM (VALUES (1996, true), (1998, true), (2000, false)) AS t(cycle, loaded)", domain=False)
def cycle_markers(d: Domain) -> DataFrame:
    """Cycles that are marked as loaded, one of them twice, and one that is not."""
    store = Store(d.spark, work_dir(d.spark))
    for cycle in (1996, 1998, 1996):
        marks = store.mark_cycle(cycle)
    asked = d.spark.createDataFrame([(1996,), (1998,), (2000,)], "cycle int")
    return asked.join(marks.groupBy("cycle").agg(F.count(F.lit(1)).alias("n")), "cycle", "left").select("cycle", (F.coalesce("n", F.lit(0)) == 1).alias("loaded"))


@query('SELECT "cycle", count(*) AS gifts, CAST(sum(amount) AS DOUBLE) AS dollars, 1::BIGINT AS loads FROM contributions GROUP BY 1')
def loaded_cycles(d: Domain) -> DataFrame:
    """Contributions loaded cycle by cycle, all but the first, then all that are not marked yet: each is loaded once."""
    store, rows = Store(d.spark, work_dir(d.spark)), d.contributions.select(*KEY, "amount", "cycle")
    cycles = sorted(r["cycle"] for r in rows.select("cycle").distinct().collect())  # a few
    for wanted in (cycles[1:], cycles):
        for cycle in wanted:
            if not store.cycle_loaded(cycle):
                store.merge("contributed_to", rows.filter(F.col("cycle") == cycle), KEY, buckets=2)
                store.mark_cycle(cycle)
    gifts = store.need("contributed_to", "committee bigint, candidate bigint, tran string, amount decimal(18,2), cycle int")
    marks = store.need("cycle_load", CYCLE_LOAD).groupBy("cycle").agg(F.count(F.lit(1)).alias("loads"))
    return gifts.groupBy("cycle").agg(F.count(F.lit(1)).alias("gifts"), F.sum("amount").cast("double").alias("dollars")).join(marks, "cycle")


@query("""SELECT c_custkey AS rating_id, 'D' || (c_custkey // 2 * 2 + c_nationkey % 2) AS fec_id, 'last_name' AS outcome FROM customer""", domain=False)
def party_filter(d: Domain) -> DataFrame:
    """Two people of one last name whose given names both fit: the rating's party decides."""
    key = F.col("c_custkey")
    pair = F.floor(key / 2)
    people = d.table("customer").select(pair.alias("p")).distinct().select("p", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    people = people.select(F.concat(F.lit("D"), F.col("p") * 2 + F.col("k")).alias("fec_id"), F.concat(F.lit("L"), "p", F.when(F.col("k") == 0, ", BEN").otherwise(", BENJAMIN")).alias("name"), F.lit("CA").alias("state"), F.when(F.col("k") == 0, "DEM").otherwise("REP").alias("party"))
    ratings = d.table("customer").select(key.alias("rating_id"), F.concat(F.lit("Benj L"), pair).alias("candidate_name"), F.lit("CA").alias("state"), F.when(F.col("c_nationkey") % 2 == 0, "D").otherwise("R").alias("party"))
    found = resolve.resolved_ratings(ratings, resolve.candidate_index(people, names.plain), names.plain, people.select("fec_id", "party"))
    return found.select("rating_id", "fec_id", "outcome")


# --- files ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'a|b' WHEN p_partkey % 5 = 2 THEN '' ELSE p_name END AS p_name, p_brand FROM part WHERE p_partkey % 5 <> 0", domain=False)
def read_bulk_file(d: Domain) -> DataFrame:
    """A pipe-delimited file written and read: short lines go, further fields are cut off, quotes hold a delimiter, empty fields are ''."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 1, '"a|b"').when(k == 2, "").otherwise(F.col("p_name"))
    line = F.when(k == 0, F.concat_ws("|", "p_partkey", name)).when(k == 3, F.concat_ws("|", "p_partkey", name, "p_brand", F.lit("x"), F.lit("y"))).otherwise(F.concat_ws("|", "p_partkey", name, "p_brand"))
    folder = work_dir(d.spark)
    d.table("part").select(line.alias("value")).write.text(folder)
    return bulk.read_bulk(d.spark, folder, ["p_partkey", "p_name", "p_brand"])


def _filed_lines(d: Domain, rows: DataFrame, columns: list[str], **cells: Column) -> str:
    """rows as a pipe-delimited file with these columns; those without a cell are empty."""
    folder = work_dir(d.spark)
    rows.select(F.concat_ws("|", *(F.coalesce(cells.get(c, F.lit("")).cast("string"), F.lit("")) for c in columns)).alias("value")).write.text(folder)
    return folder


@query("SELECT 'C' || s_suppkey AS committee_id, s_name AS committee_name, CASE WHEN s_suppkey % 2 = 0 THEN 'C' ELSE '' END AS interest_group_category, 'Org ' || s_suppkey AS connected_org_name FROM supplier", domain=False)
def committee_file(d: Domain) -> DataFrame:
    """A committee master file, written and read."""
    i = F.col("s_suppkey")
    path = _filed_lines(d, _suppliers(d), bulk.COMMITTEES, committee_id=F.concat(F.lit("C"), i), committee_name=F.col("s_name"), interest_group_category=F.when(i % 2 == 0, "C"), connected_org_name=F.concat(F.lit("Org "), i))
    return bulk.committees(d.spark, path).select("committee_id", "committee_name", "interest_group_category", "connected_org_name")


@query("SELECT 'H' || c_custkey AS candidate_id, upper(c_name) AS candidate_name, CASE WHEN c_custkey % 2 = 0 THEN 'DEM' ELSE 'REP' END AS party, 'CA' AS office_state, '' AS zip FROM customer", domain=False)
def candidate_file(d: Domain) -> DataFrame:
    """A candidate master file, written and read."""
    i = F.col("c_custkey")
    path = _filed_lines(d, d.table("customer"), bulk.CANDIDATES, candidate_id=F.concat(F.lit("H"), i), candidate_name=F.upper("c_name"), party=F.when(i % 2 == 0, "DEM").otherwise("REP"), office_state=F.lit("CA"))
    return bulk.candidates(d.spark, path).select("candidate_id", "candidate_name", "party", "office_state", "zip")


@query("SELECT 'C' || committee AS committee_id, 'H' || candidate AS candidate_id, tran AS transaction_id, transaction_type, CAST(amount AS DOUBLE) AS amount, 1998 AS \"cycle\", strftime(l_shipdate, '%m%d%Y') AS transaction_date, CAST(l_shipdate AS DATE) AS date FROM contribution_rows")
def contribution_file(d: Domain) -> DataFrame:
    """A file of all filed contributions, written and read; the date is parsed beside its text."""
    rows = d.contribution_rows
    path = _filed_lines(d, rows, bulk.CONTRIBUTIONS, committee_id=F.concat(F.lit("C"), "committee"), candidate_id=F.concat(F.lit("H"), "candidate"), transaction_id=F.col("tran"), transaction_type=F.col("transaction_type"), transaction_amount=F.col("amount"), transaction_date=F.date_format("l_shipdate", "MMddyyyy"))
    return bulk.contributions(d.spark, path, 1998).select("committee_id", "candidate_id", "transaction_id", "transaction_type", F.col("transaction_amount").cast("double").alias("amount"), "cycle", "transaction_date", "date")


@query("SELECT 'H' || c_custkey AS cand_id, 'C' || c_nationkey AS cmte_id, 'P' AS cmte_dsgn, 'L' || c_custkey AS linkage_id FROM customer", domain=False)
def linkage_file(d: Domain) -> DataFrame:
    """A file of candidates' committees, written and read."""
    path = _filed_lines(d, d.table("customer"), bulk.LINKAGES, cand_id=F.concat(F.lit("H"), "c_custkey"), cmte_id=F.concat(F.lit("C"), "c_nationkey"), cmte_dsgn=F.lit("P"), linkage_id=F.concat(F.lit("L"), "c_custkey"))
    return bulk.linkages(d.spark, path).select("cand_id", "cmte_id", "cmte_dsgn", "linkage_id")


@query("""SELECT name, min(place) AS place, CAST(arg_min(spot, place * 10 + spot) AS INT) AS spot FROM (
  SELECT s_name AS name, s_suppkey AS place, 0 AS spot FROM supplier UNION ALL SELECT 'alias ' || (s_suppkey // 3), s_suppkey, 1 FROM supplier) GROUP BY name""", domain=False)
def first_named(d: Domain) -> DataFrame:
    """Names and aliases of all corporations, each once, with where it first stands."""
    i = F.col("s_suppkey")
    rows = _suppliers(d).select(i.alias("position"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias "), F.floor(i / 3))).alias("aliases"))
    return upserts.ordered_names(rows).select("name", F.col("position.position").alias("place"), F.col("position.at").alias("spot"))


@query("SELECT 'Org' AS org_name, 1998 AS year, 'labor' AS issue, 'F' || c_custkey || ' L' AS candidate_name, CASE WHEN c_custkey % 2 = 0 THEN 'CA' ELSE 'NY' END AS state, CAST(c_nationkey AS DOUBLE) AS score, CASE WHEN c_custkey % 2 = 0 THEN 'D' ELSE 'R' END AS party FROM customer WHERE c_custkey % 5 <> 0", domain=False)
def sectioned_csv(d: Domain) -> DataFrame:
    """Each customer is a section: a chamber, a state, and a member, of whom every fifth has no score."""
    key, state = F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "California").otherwise("New York")
    member = F.concat_ws(",", F.concat(F.lit("F"), key), F.lit("L"), F.when(key % 2 == 0, "Democrat").otherwise("Republican"), F.lit("1"), F.when(key % 5 == 0, "n/v").otherwise(F.col("c_nationkey").cast("string")), F.lit(""), F.lit(""))
    lines = d.table("customer").select(F.posexplode(F.array(F.lit("House"), state, F.lit("First Name,Last Name,Party,District,1998 Score,a,b"), member)).alias("k", "value"), (key * 4 + F.col("k")).alias("position"))
    return scorecards.sectioned(lines.select("position", "value"), "Org", 1998, "labor")


@query("SELECT 'Org' AS org_name, 1998 AS year, 'labor' AS issue, c_name AS candidate_name, 'CA' AS state, CASE c_custkey % 3 WHEN 0 THEN 75.0::DOUBLE ELSE CAST(c_nationkey AS DOUBLE) END AS score, CASE WHEN c_custkey % 2 = 0 THEN 'D' END AS party FROM customer WHERE c_custkey % 3 <> 1", domain=False)
def plain_csv(d: Domain) -> DataFrame:
    key = F.col("c_custkey")
    rows = d.table("customer").select(F.col("c_name").alias("Member"), F.lit("CA ").alias("State"), F.when(key % 2 == 0, "d").otherwise(" ").alias("Party"), F.when(key % 3 == 0, "B").when(key % 3 == 1, "N/A").otherwise(F.col("c_nationkey").cast("string")).alias("1998 Score"))
    return scorecards.plain_csv(rows, "Org", 1998, "labor")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN make_date(2000 + CAST(s_suppkey % 20 AS INT), 1 + CAST(s_suppkey % 12 AS INT), 1 + CAST(s_suppkey % 28 AS INT)) END AS day FROM supplier", domain=False)
def filed_days(d: Domain) -> DataFrame:
    """Dates as MMDDYYYY; what is none is null."""
    i = F.col("s_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.when(i % 2 == 0, F.concat(two(1 + i % 12), two(1 + i % 28), (2000 + i % 20).cast("string"))).otherwise("13452000")
    return _suppliers(d).select("s_suppkey", text.alias("text")).select("s_suppkey", bulk.day("text").alias("day"))


@query("SELECT s_suppkey, strip_accents(lower('Zoë Ñandú-Åström ' || s_name)) AS key, CASE s_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' END AS party FROM supplier", domain=False)
def printed_names(d: Domain) -> DataFrame:
    """Scorecard names without accents and doubled spaces, and the first letter of the party."""
    i = F.col("s_suppkey")
    party = F.when(i % 3 == 0, "democrat").when(i % 3 == 1, " Rep").otherwise(" ")
    return _suppliers(d).select("s_suppkey", names.printed_name(F.concat(F.lit(" Zoë  Ñandú-Åström "), "s_name")).alias("key"), names.party_letter(party).alias("party"))


# --- registers ------------------------------------------------------------------------------------------------------


def _facts(d: Domain) -> DataFrame:
    """Supplier k is owned by supplier k // 3; every tenth has no name."""
    i = F.col("s_suppkey")
    q = lambda c: F.concat(F.lit("Q"), c)
    return _suppliers(d).select(q(i).alias("id"), F.when(i % 10 != 0, F.col("s_name")).otherwise("").alias("name"), F.when(i > 0, q(F.floor(i / 3))).alias("parent"), F.lit("P").alias("parent_name"), F.concat(F.lit("T"), i).alias("ticker"))


_FACTS = """facts AS (SELECT 'Q' || s_suppkey AS id, CASE WHEN s_suppkey % 10 <> 0 THEN s_name ELSE '' END AS name, CASE WHEN s_suppkey > 0 THEN 'Q' || (s_suppkey // 3) END AS parent, 'T' || s_suppkey AS ticker, s_suppkey FROM supplier)"""


@query(f"WITH {_FACTS} SELECT s_suppkey AS query, k AS position, f.id, parent, ticker FROM facts f JOIN (SELECT unnest(range(7)) AS k) ON k < 5 WHERE (s_suppkey + k) % 2 = 0", domain=False)
def business_hits(d: Domain) -> DataFrame:
    """Of seven search hits the first five are read; those that are businesses get their parent and ticker."""
    i = F.col("s_suppkey")
    hit = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct(F.concat(F.lit("Q"), i).alias("id"), F.col("s_name").alias("label"), F.lit("").alias("description"), F.struct(F.when((i + k) % 2 == 0, "alias").otherwise("label").alias("type"), F.lit("en").alias("language"), F.lit("text").alias("text")).alias("match")))
    hits = entities.search_hits(_suppliers(d).select(i.alias("query"), hit.alias("search")))
    found = entities.business_hits(hits.filter("alias = 'text'"), _facts(d), _facts(d))
    return found.select("query", F.col("position").cast("long").alias("position"), "id", "parent", "ticker")


@query(f"""WITH {_FACTS} SELECT s_suppkey AS query, k AS position, f.id, name AS label, CASE WHEN (s_suppkey + k) % 3 = 0 THEN 'alias ' || s_suppkey || '-' || k END AS alias, parent, ticker
  FROM facts f JOIN (SELECT unnest(range(7)) AS k) ON k < 5 WHERE s_suppkey % 4 <> 1""", domain=False)
def business_hit_aliases(d: Domain) -> DataFrame:
    """A hit keeps the alias that matched through its join with the register by id; three of four suppliers are businesses."""
    i = F.col("s_suppkey")
    match = lambda k: F.struct(F.when((i + k) % 3 == 0, "alias").otherwise("label").alias("type"), F.lit("en").alias("language"), F.concat(F.lit("alias "), i, F.lit("-"), k).alias("text"))
    hit = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct(F.concat(F.lit("Q"), i).alias("id"), F.when(i % 10 != 0, F.col("s_name")).otherwise("").alias("label"), F.lit("").alias("description"), match(k).alias("match")))
    hits = entities.search_hits(_suppliers(d).select(i.alias("query"), hit.alias("search")))
    businesses = _facts(d).filter(F.substring("id", F.lit(2), F.lit(20)).cast("long") % 4 != 1)
    found = entities.business_hits(hits, businesses, _facts(d))
    return found.select("query", F.col("position").cast("long").alias("position"), "id", "label", "alias", "parent", "ticker")


@query(f"WITH {_FACTS} SELECT parent AS corporation, id, name FROM facts WHERE name <> '' AND parent IN ('Q1', 'Q2', 'Q3')", domain=False)
def owned_companies(d: Domain) -> DataFrame:
    owners = d.spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "qid string")
    return entities.subsidiaries(_facts(d), owners)


@query(f"WITH {_FACTS} SELECT parent AS corporation, id, name FROM facts WHERE name <> '' AND s_suppkey % 2 = 1 AND parent IS NOT NULL", domain=False)
def owned_brands(d: Domain) -> DataFrame:
    """Owned things that are no businesses (odd ones) are brands."""
    i = F.col("s_suppkey")
    facts = _facts(d)
    return entities.discovered_brands(facts, _suppliers(d).filter(i % 2 == 0).select(F.concat(F.lit("Q"), i).alias("id")), facts.select(F.col("id").alias("qid")))


@query(f"""WITH RECURSIVE {_FACTS}, up AS (SELECT id AS start, id FROM facts UNION SELECT u.start, f.parent FROM up u JOIN facts f ON f.id = u.id WHERE f.parent IS NOT NULL)
  SELECT start, u.id, parent FROM up u JOIN facts f ON f.id = u.id WHERE parent IS NOT NULL""", domain=False)
def owner_chains(d: Domain) -> DataFrame:
    """Every owner above each supplier, with its own."""
    return entities.owner_chain(_facts(d), _facts(d).select(F.col("id").alias("start"), "id"))


@query("""SELECT s_suppkey AS query, 'subsidiary_of' AS predicate, s_name AS subject, 'company' AS kind FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT s_suppkey, NULL, s_name, 'found' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, NULL, s_name, 'search' FROM supplier WHERE s_suppkey % 4 = 0
  UNION ALL SELECT s_suppkey, NULL, 'Group ' || s_suppkey, 'group' FROM supplier WHERE s_suppkey % 5 <> 0""", domain=False)
def register_answers(d: Domain) -> DataFrame:
    """Ownership statements, companies by number and by search in one jurisdiction, and the first grouping, from a register's JSON."""
    i = F.col("s_suppkey")
    company = F.to_json(F.struct(F.col("s_name").alias("name"), F.when(i % 4 == 0, "us_de").otherwise("gb").alias("jurisdiction_code")))
    statement = F.concat(F.lit('{"statement":{"predicate":"'), F.when(i % 2 == 0, "subsidiary_of").otherwise("officer_of"), F.lit('","subject":"'), "s_name", F.lit('"}}'))
    group = F.concat(F.lit('{"corporate_grouping":{"name":"Group '), i, F.lit('"}},{"corporate_grouping":{"name":"second"}}'))
    texts = _suppliers(d).select(i.alias("query"), F.concat(F.lit('{"results":{"statements":['), statement, F.lit("]}}")).alias("s"), F.when(i % 3 == 0, F.concat(F.lit('{"results":{"company":'), company, F.lit("}}"))).otherwise("{}").alias("c"), F.concat(F.lit('{"results":{"companies":[{"company":'), company, F.lit("}]}}")).alias("m"), F.concat(F.lit('{"results":{"corporate_groupings":['), F.when(i % 5 != 0, group).otherwise(""), F.lit("]}}")).alias("g"))
    answers = lambda c, schema: texts.select("query", F.from_json(c, schema).alias("a")).select("query", "a.results")
    statements = entities.register_statements(answers("s", entities.STATEMENTS)).select("query", "predicate", "subject", F.lit("company").alias("kind"))
    rest = [
        (entities.register_company(answers("c", entities.COMPANIES)), "found"),
        (entities.register_companies(answers("m", entities.COMPANIES), "us_de"), "search"),
        (entities.register_grouping(answers("g", entities.GROUPINGS)), "group"),
    ]
    for rows, kind in rest:
        statements = statements.unionAll(rows.select("query", _no_text().alias("predicate"), F.col("name").alias("subject"), F.lit(kind).alias("kind")))
    return statements

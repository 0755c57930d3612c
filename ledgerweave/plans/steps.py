"""The load and scoring steps over a stored graph, in order: schema, brands, filings, committees' owners, scorecards, scores.

``python -m ledgerweave.plans.steps --store URI --input URI [--steps ...] [--force] [--retry-nulls] [--skip-discovery]``

Below input: ``filings/{cm,cn,pas2,ccl}_{cycle}.txt`` as filed, ``lookups/{hits,facts,businesses}`` as Parquet (answers
of public registers that were fetched before), ``scorecards`` with the scorecard files. Corporations are known by name.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import names
from ledgerweave.operators import dedupe, loads, resolve, scoring, traverse, upserts
from ledgerweave.operators.filters import supported
from ledgerweave.plans.store import Store
from ledgerweave.sources import bulk, entities, exports, scorecards, seeds

STEPS = ("schema", "brands", "fec", "pac_linkage", "scorecards", "scores")
CYCLES = (2022, 2024)
OWNED_BY, SUBSIDIARY_OF, OPERATES_PAC = "brand string, corp string", "child string, parent string", "corp string, committee string"
CONTRIBUTED = "committee string, candidate string, tran string, amount string, date string, cycle int"
RATES = "org string, candidate string, score double, year int"
FACTS = "id string, name string, parent string, parent_name string, ticker string"
HITS = "brand string, source int, position long, label string, alias string, id string, ticker string, jurisdiction string, oc_id string"


def _corporations(store: Store, needed: bool = False) -> DataFrame:
    return (store.need if needed else store.read)("corporation", loads.CORPORATION).withColumn("id", F.col("name"))


def run_schema(store: Store) -> None:
    """Seed tables; corporations of the list are loaded like any others."""
    spark = store.spark
    for name, rows in (("issue", seeds.issues(spark)), ("scorecard", seeds.scorecards(spark)), ("covers", seeds.covers(spark))):
        store.write(name, rows)
    new = seeds.corporations(spark).select("name", "ticker", *(F.lit(None).cast("string").alias(c) for c in ("cik", "jurisdiction", "oc_id", "qid")))
    store.write("corporation", loads.corporations(store.read("corporation", loads.CORPORATION), new))


def _load_corporations(store: Store, rows: DataFrame) -> None:
    empty = [F.lit(None).cast("string").alias(c) for c in ("ticker", "cik", "jurisdiction", "oc_id", "qid") if c not in rows.columns]
    store.write("corporation", loads.corporations(store.read("corporation", loads.CORPORATION), rows.select("*", *empty)))


def run_brands(store: Store, hits: DataFrame, facts: DataFrame, businesses: DataFrame, retry_nulls: bool = False, skip_discovery: bool = False) -> None:
    """Brands to corporations by the waterfall of sources; their owners; then ids, subsidiaries and brands of what is owned."""
    spark = store.spark
    listed = spark.createDataFrame(list(enumerate(seeds.BRANDS.strip().splitlines())), "position long, brand string")
    answers = store.write("resolution", resolve.brand_waterfall(listed, hits, store.resolutions(retry_nulls)).select("brand", "id", "source"))
    new = listed.select(F.col("brand").alias("name"), names.slug(F.col("brand")).alias("amazon_slug"), F.array().cast("array<string>").alias("aliases"))
    store.write("brand", loads.brands(store.read("brand", loads.BRAND), new))

    found = answers.filter("id is not null").join(hits.dropDuplicates(["brand", "id"]).drop("source"), ["brand", "id"])
    owners = found.select("brand", "id", F.coalesce("label", "alias").alias("name"), "ticker", "jurisdiction", "oc_id").filter("name is not null")
    chain = entities.owner_chain(facts, owners.select(F.col("id").alias("start"), "id").distinct())
    label = facts.filter("coalesce(name, '') <> ''").groupBy("id").agg(F.min("name").alias("child"))
    above = chain.join(label, "id").join(facts.select("id", "parent", "parent_name").distinct(), ["id", "parent"]).filter("coalesce(parent_name, '') <> ''").select("child", F.col("parent_name").alias("parent")).distinct()
    own = owners.groupBy("name").agg(F.min(F.struct("brand", "ticker", "jurisdiction", "oc_id")).alias("x")).select("name", "x.ticker", "x.jurisdiction", "x.oc_id")
    parents = above.select(F.col("parent").alias("name")).distinct().join(own.select("name"), "name", "left_anti")
    _load_corporations(store, own.unionByName(parents, allowMissingColumns=True))
    _own(store, owners.select(F.col("brand").alias("source"), F.col("name").alias("corp_name")))
    _under(store, above)
    if not skip_discovery:
        _discover(store, hits, facts, businesses)


def _own(store: Store, pairs: DataFrame) -> None:
    known = store.read("brand", loads.BRAND).select(F.col("name").alias("source"))
    edges = upserts.alias_edges(pairs.join(known, "source", "left_semi"), _corporations(store)).withColumnRenamed("source", "brand")
    store.write("owned_by", upserts.with_edges(store.read("owned_by", OWNED_BY), edges))


def _under(store: Store, pairs: DataFrame) -> None:
    store.write("subsidiary_of", loads.subsidiaries(store.read("subsidiary_of", SUBSIDIARY_OF), pairs, _corporations(store)))


def _discover(store: Store, hits: DataFrame, facts: DataFrame, businesses: DataFrame) -> None:
    """Ids for corporations without one, then subsidiaries and brands by id, then one corporation for each id."""
    known = store.read("corporation", loads.CORPORATION)
    asked = hits.select(F.col("brand").alias("name"), "position", "label", F.col("id").alias("uri"))
    ids = resolve.first_similar(known.select("name", "qid"), asked)
    known = store.write("corporation", known.drop("qid").join(ids, "name").select(known.columns))
    owners = known.filter("coalesce(qid, '') <> ''").select("qid", F.col("name").alias("owner"))
    below = entities.subsidiaries(facts, owners).join(owners, F.col("corporation") == F.col("qid")).select("name", "owner")
    _load_corporations(store, below.select("name").distinct().join(known.select("name"), "name", "left_anti"))
    _under(store, below.select(F.col("name").alias("child"), F.col("owner").alias("parent")))
    brands = entities.discovered_brands(facts, businesses, owners).join(owners, F.col("corporation") == F.col("qid")).select("name", "owner")
    new = brands.select("name").distinct().select("name", names.slug(F.col("name")).alias("amazon_slug"), F.lit(None).cast("array<string>").alias("aliases"))
    store.write("brand", loads.brands(store.read("brand", loads.BRAND), new))
    _own(store, brands.select(F.col("name").alias("source"), F.col("owner").alias("corp_name")))
    merge_corporations(store)


def merge_corporations(store: Store) -> None:
    """Corporations with one id become one, and their edges move to it."""
    known = _corporations(store)
    edges = {"owned_by": (OWNED_BY, ("corp",)), "subsidiary_of": (SUBSIDIARY_OF, ("child", "parent")), "operates_pac": (OPERATES_PAC, ("corp",))}
    tables = {name: store.read(name, schema) for name, (schema, _) in edges.items()}
    merges = dedupe.merge_map(known, dedupe.degrees(*((tables[n], end) for n, (_, ends) in edges.items() for end in ends)))
    merges = store.write("merged", merges)
    for name, (_, ends) in edges.items():
        store.write(name, dedupe.moved(tables[name], merges, *ends))
    named = dedupe.merged_aliases(known, merges).select("name", "aliases")
    store.write("corporation", known.drop("aliases", "id").join(named, "name").select(known.drop("id").columns))


def run_fec(store: Store, folder: str, cycles: Sequence[int] = CYCLES, force: bool = False) -> list[int]:
    """Filings of each cycle that is not loaded yet (force: of all); returns the cycles that were loaded."""
    done, spark = [], store.spark
    for cycle in cycles:
        if store.cycle_loaded(cycle) and not force:
            continue
        path = lambda kind: f"{folder}/{kind}_{cycle}.txt"  # noqa: E731, B023
        people = store.write("candidate", loads.candidates(store.read("candidate", loads.CANDIDATE), bulk.candidates(spark, path("cn"))))
        groups = store.write("committee", loads.committees(store.read("committee", loads.COMMITTEE), bulk.committees(spark, path("cm"))))
        reconcile(store)
        people = store.read("candidate", loads.CANDIDATE)
        gifts = supported(bulk.contributions(spark, path("pas2"), cycle)).withColumn("row", F.monotonically_increasing_id())  # grows with the place in one file, whatever its splits
        gifts = gifts.select(F.col("committee_id").alias("committee"), F.col("candidate_id").alias("candidate"), F.col("transaction_id").alias("tran"), F.col("transaction_amount").alias("amount"), F.col("transaction_date").alias("date"), "cycle", "row")
        key = ("committee", "candidate", "tran")
        gifts = upserts.with_endpoints(upserts.last_write(gifts, key, [F.desc("row")]), groups.select(F.col("committee_id").alias("committee")), "committee", people.select(F.col("candidate_id").alias("candidate")), "candidate")
        store.merge("contributed_to", gifts.drop("row"), key)
        linked, _ = loads.linkages(store.read("authorized", loads.LINKAGE), bulk.linkages(spark, path("ccl")), people, groups)
        store.write("authorized", linked)
        store.mark_cycle(cycle)
        done.append(cycle)
    return done


def reconcile(store: Store) -> None:
    """Provisional candidates that a filed one fits give it their ratings and names, and go."""
    people = store.read("candidate", loads.CANDIDATE)
    filed = people.filter("not provisional").select(F.col("candidate_id").alias("fec_id"), "name", "state")
    asked = people.filter("provisional").select(F.col("candidate_id").alias("prov_id"), names.printed_name(F.col("name")).alias("name_key"), F.coalesce("state", F.lit("")).alias("state"))
    real = store.write("reconciled", dedupe.real_candidates(asked, resolve.candidate_index(filed)))
    ratings = store.read("rates", RATES)
    years = ratings.groupBy("org", "candidate").agg(F.max("year").alias("year"))
    moved = dedupe.moved_ratings(ratings.select("org", "candidate", "score"), real)
    back = years.join(real, F.col("candidate") == F.col("prov_id"), "left").select("org", F.coalesce("fec_id", "candidate").alias("candidate"), "year").groupBy("org", "candidate").agg(F.max("year").alias("year"))
    store.write("rates", moved.join(back, ["org", "candidate"]).select("org", "candidate", "score", "year"))
    more = people.join(real, F.col("candidate_id") == F.col("prov_id")).groupBy("fec_id").agg(F.sort_array(F.collect_set("name")).alias("more"))
    none = F.array().cast("array<string>")
    kept = people.join(real.select(F.col("prov_id").alias("candidate_id")), "candidate_id", "left_anti").join(more.withColumnRenamed("fec_id", "candidate_id"), "candidate_id", "left")
    aliases = F.array_except(F.array_union(F.coalesce("aliases", none), F.coalesce("more", none)), F.array("name"))
    store.write("candidate", kept.withColumn("aliases", aliases).select(people.columns))


def run_pac_linkage(store: Store) -> None:
    """Committees' organisations to corporations, from what is stored."""
    known, stored = _corporations(store, True), store.need("committee", loads.COMMITTEE)
    order = known.select("name", "aliases", F.struct("name").alias("position"))
    found = resolve.pac_sponsors(loads.stored_pacs(stored), upserts.ordered_names(order))
    store.write("operates_pac", loads.pacs(store.read("operates_pac", OPERATES_PAC), found.select(F.col("name").alias("corp"), "committee"), known, stored))


def run_scorecards(store: Store, raw: DataFrame) -> None:
    """raw: rows of scorecards.RATING. Unknown people become provisional candidates; names used join the aliases."""
    people = store.need("candidate", loads.CANDIDATE)
    index = resolve.candidate_index(people.select(F.col("candidate_id").alias("fec_id"), "name", "state"))
    asked = store.write("rating", raw.withColumn("rating_id", F.monotonically_increasing_id()))
    found = store.write("rated", asked.join(resolve.resolved_ratings(asked, index), "rating_id"))
    people = store.write("candidate", loads.provisional_candidates(people, found.filter("provisional").withColumnRenamed("rating_id", "load_seq")))
    new = found.select(F.col("org_name").alias("org"), F.col("fec_id").alias("candidate"), "score", "year", F.col("rating_id").alias("load_seq"))
    ends = upserts.with_endpoints(new, store.need("scorecard", "org_name string").select(F.col("org_name").alias("org")), "org", people.select(F.col("candidate_id").alias("candidate")), "candidate")
    store.write("rates", loads.ratings(store.read("rates", RATES), ends))
    store.write("candidate", upserts.with_rated_names(people, found.select(F.col("fec_id").alias("candidate_id"), "candidate_name"), "candidate_id").select(people.columns))


def run_scores(store: Store, cycles: Sequence[int] = CYCLES, export: str | None = None) -> DataFrame:
    """Needs what the steps before have written; ownership edges get their mark of cycles here, once for a run."""
    edges = store.write("ownership", traverse.labelled(store.need("subsidiary_of", SUBSIDIARY_OF)))
    counts = traverse.counted_trails(store.need("owned_by", OWNED_BY), edges)
    gifts = store.need("contributed_to", CONTRIBUTED).filter(F.col("cycle").isin(*cycles))
    covers = store.need("covers", "org_name string, issue_name string").select(F.col("org_name").alias("org"), F.col("issue_name").alias("issue"))
    computed = scoring.factored_scores(counts, store.need("operates_pac", OPERATES_PAC), gifts, store.need("rates", RATES).drop("year"), covers)
    stored = store.write_scores(computed, store.read("brand", loads.BRAND), cycles)
    if export:
        exports.export_scores(stored, export)
    return stored


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--store", required=True)
    parser.add_argument("--input", required=True)
    parser.add_argument("--steps", nargs="+", choices=[*STEPS, "all"], default=["all"])
    parser.add_argument("--cycles", nargs="+", type=int, default=list(CYCLES))
    parser.add_argument("--years", nargs="+", type=int, default=[max(CYCLES)])
    parser.add_argument("--force", action="store_true", help="load cycles again that are loaded")
    parser.add_argument("--retry-nulls", action="store_true", help="ask again for brands without a match")
    parser.add_argument("--skip-discovery", action="store_true", help="leave out ids, subsidiaries and brands of owners")
    parser.add_argument("--export", help="a local file for all scores as JSON")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    store, wanted = Store(spark, given.store), set(STEPS if "all" in given.steps else given.steps)
    if "schema" in wanted:
        run_schema(store)
    if "brands" in wanted:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{given.input}/lookups/{name}")
        run_brands(store, read("hits", HITS), read("facts", FACTS), read("businesses", "id string"), given.retry_nulls, given.skip_discovery)
    if "fec" in wanted:
        run_fec(store, f"{given.input}/filings", given.cycles, given.force)
    if "pac_linkage" in wanted:
        run_pac_linkage(store)
    if "scorecards" in wanted:
        folder = f"{given.input}/scorecards".removeprefix("file://")
        readers = [lambda s, y: scorecards.read_csv_scorecard(s, folder, "League of Conservation Voters", y, "environment")]
        run_scorecards(store, scorecards.all_scorecards(spark, given.years, readers))
    if "scores" in wanted:
        run_scores(store, given.cycles, given.export)


if __name__ == "__main__":
    main()

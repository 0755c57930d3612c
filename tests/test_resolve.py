"""Similarity joins, waterfalls, staged name lookups, merges."""

from difflib import SequenceMatcher

from ledgerweave.operators import dedupe, filters, resolve, upserts


def test_similar_companies_like_nested_loops(spark):
    known = ["Acme Corp", "Acme Corporation of Ohio", "Apex", "Apex Holdings", "Zeta Foods", "Zeta Food", "Y", "Inc."]
    asked = ["ACME Inc.", "Acmee", "apex", "Zeta Fods", "Nothing like it", "", "Group", "Acme Ohio"]
    key = {"Acme Corp": "acme", "Acme Corporation of Ohio": "acme corporation of ohio", "Apex": "apex", "Apex Holdings": "apex", "Zeta Foods": "zeta foods", "Zeta Food": "zeta food", "Y": "y", "Inc.": ""}
    asked_key = {"ACME Inc.": "acme", "Acmee": "acmee", "apex": "apex", "Zeta Fods": "zeta fods", "Nothing like it": "nothing like it", "": "", "Group": "", "Acme Ohio": "acme ohio"}
    want = {}
    for q in asked:
        best = (None, 0.0)
        for n in known:
            score = SequenceMatcher(None, asked_key[q], key[n]).ratio()
            if score > best[1]:
                best = (n, score)
        if best[1] >= 0.7:
            want[q] = best
    got = resolve.similar_companies(spark.createDataFrame([(a,) for a in asked], "query string"), spark.createDataFrame([(n, k) for k, n in enumerate(known)], "name string, position int"))
    assert {r["query"]: (r["name"], r["score"]) for r in got.collect()} == want
    pacs = spark.createDataFrame([(1, " ACME "), (2, "none"), (3, ""), (4, None)], "committee int, connected_org string")
    assert [(r["committee"], r["name"]) for r in resolve.pac_sponsors(pacs, spark.createDataFrame([("Acme Corp", 0)], "name string, position int")).collect()] == [(1, "Acme Corp")]


HITS = "brand string, source int, position int, label string, alias string, id string"


def test_alias_wins_and_ties_keep_order(spark):
    hits = spark.createDataFrame([("AMD", 1, 0, "Advanced Micro Devices", "AMD", "Q1"), ("AMD", 2, 0, "AMD", None, "R1"), ("AMD", 1, 1, None, "AMD", "Q2")], HITS)
    got = [(r["id"], r["score"]) for r in resolve.scored_candidates(hits).orderBy("rank").collect()]
    assert got == [("Q1", 1.0), ("R1", 1.0), ("Q2", 0.0)]


def test_waterfall_and_budget(spark):
    hits = spark.createDataFrame([("a", 1, 0, "a", None, "Q1"), ("b", 1, 0, "zzz", None, "Q2"), ("b", 2, 0, "b", None, "R2"), ("c", 2, 0, "c", None, "R3"), ("cached", 1, 0, "cached", None, "Q9")], HITS)
    brands = spark.createDataFrame([("a", 0), ("nothing", 1), ("b", 2), ("c", 3), ("cached", 4)], "brand string, position int")
    cache = spark.createDataFrame([("cached", None, None), ("other", "Q5", 1)], "brand string, id string, source int")
    got = {r["brand"]: r["id"] for r in resolve.brand_waterfall(brands, hits, cache, budget=1).collect()}
    assert got == {"a": "Q1", "b": "R2", "c": None, "nothing": None, "cached": None, "other": "Q5"}


def test_decision_table(spark):
    people = [("1", "PADILLA, ALEX", "CA"), ("2", "SMITH, JOHN", "TX"), ("3", "DOE, BENJAMIN", "NY"), ("4", "DOE, TIMOTHY", "NY"), ("5", "ROE, ANN", "NY"), ("6", "ROE, ANN", "NY"), ("7", "CRUZ, RAFAEL EDWARD TED", "TX"), ("8", "POE, TIM", "NY"), ("9", "POE, TIMO", "NY"), ("10", "", "NY"), (None, "X, Y", "NY")]
    index = resolve.candidate_index(spark.createDataFrame(people, "fec_id string, name string, state string"))
    ratings = [(1, "Alex Padilla", "ca"), (2, "Bill Smith", "TX"), (3, "Ben Doe", "NY"), (4, "Zoe Doe", "NY"), (5, "Ann Roe", "NY"), (6, "Ted Cruz", "TX"), (7, "Timothy Poe", "NY"), (8, "Álex Padilla", "CA"), (9, "Alex Padilla", "NV"), (10, "Annie Roe", "NY")]
    got = resolve.resolved_ratings(spark.createDataFrame(ratings, "rating_id int, candidate_name string, state string"), index).collect()
    assert sorted((r["rating_id"], r["fec_id"], r["outcome"]) for r in got) == [
        (1, "1", "exact"), (2, "2", "last_name"), (3, "3", "last_name"), (4, "PROV_NY_ZOE_DOE", "provisional"), (6, "7", "exact"), (8, "1", "exact"), (9, "PROV_NV_ALEX_PADILLA", "provisional"), (10, "5", "last_name"), (10, "6", "last_name"),
    ]


def test_names_that_begin_one_another(spark):
    """Against pairs by startswith: no name, one, several, the empty name, states apart; with and without parties."""
    import random

    rng = random.Random(6)
    given = ["", "a", "al", "alan", "alana", "b", "be", "ben", "benny ann", "z"]
    people = {(rng.choice("xy"), rng.choice(["NY", "CA"]), rng.choice(given[1:])) for _ in range(22)}
    asked = [(last, state, g) for last in "xyz" for state in ("NY", "CA") for g in given]
    columns = "last string, state string, given string"
    got = {(r["last"], r["state"], r["given"]): (r["near"], r["one"]) for r in resolve.alike_given(spark.createDataFrame(asked, columns), spark.createDataFrame(sorted(people), columns), ["last", "state"]).collect()}
    want = {}
    for last, state, g in asked:
        near = sorted(x for k, s, x in people if (k, s) == (last, state) and (x.startswith(g) or g.startswith(x)))
        if near:
            want[last, state, g] = (len(near), near[0])
    assert got == want
    index = spark.createDataFrame([("ann lee", "NY", "1"), ("anna lee", "NY", "2"), ("bo lee", "NY", "3")], "name_key string, state string, fec_id string")
    parties = spark.createDataFrame([("1", "DEM"), ("2", "REP"), ("3", "REP")], "fec_id string, party string")
    ratings = spark.createDataFrame([(1, "An Lee", "NY", "Rep"), (2, "An Lee", "NY", "Ind"), (3, "An Lee", "NY", None)], "rating_id int, candidate_name string, state string, party string")
    assert [(r["rating_id"], r["fec_id"]) for r in resolve.resolved_ratings(ratings, index, parties=parties).collect()] == [(1, "2")]
    assert resolve.resolved_ratings(ratings, index).count() == 0
    assert "collect_list" not in resolve.resolved_ratings(ratings, index)._jdf.queryExecution().toString()


def test_merges(spark):
    corporations = spark.createDataFrame([(1, "B", "Q1", ["b"]), (2, "A", "Q1", None), (3, "C", "Q1", ["A", "c"]), (4, "D", None, None), (5, "E", "", None)], "id long, name string, qid string, aliases array<string>")
    edges = spark.createDataFrame([(4, 3), (3, 1), (4, 4), (5, 3), (5, 2)], "child long, parent long")
    merges = dedupe.merge_map(corporations, dedupe.degrees((edges, "child"), (edges, "parent")))
    assert {r["id"]: r["canonical"] for r in merges.collect()} == {1: 3, 2: 3}
    assert sorted(map(tuple, dedupe.moved(edges, merges, "child", "parent").collect())) == [(4, 3), (4, 4), (5, 3)]
    assert {r["id"]: r["aliases"] for r in dedupe.merged_aliases(corporations, merges).collect()} == {3: ["A", "c", "B", "b"], 4: [], 5: []}


def test_provisional_become_real(spark):
    provisional = spark.createDataFrame([("PROV_1", "ann roe", "NY"), ("PROV_2", "no one", "NY")], "prov_id string, name_key string, state string")
    index = spark.createDataFrame([("ann roe", "NY", "H1"), ("ann roe", "NY", "H2")], "name_key string, state string, fec_id string")
    ratings = spark.createDataFrame([("o", "PROV_1", 10.0), ("o", "H1", 20.0), ("p", "H1", 30.0), ("o", "PROV_2", 40.0)], "org string, candidate string, score double")
    got = dedupe.moved_ratings(ratings, dedupe.real_candidates(provisional, index))
    assert sorted(map(tuple, got.collect())) == [("o", "H1", 10.0), ("o", "PROV_2", 40.0), ("p", "H1", 30.0)]


def test_upserts(spark):
    old = spark.createDataFrame([("a", "T1", "Q1"), ("b", "T2", "Q2")], "name string, ticker string, qid string")
    new = spark.createDataFrame([("a", None, ""), ("c", "T3", None)], "name string, ticker string, qid string")
    assert sorted(map(tuple, upserts.upsert(old, new, "name", keep_if_empty=("qid",)).collect())) == [("a", None, "Q1"), ("b", "T2", "Q2"), ("c", "T3", None)]
    assert sorted(map(tuple, upserts.upsert(old, new, "name", keep_if_null=("ticker",)).collect())) == [("a", "T1", ""), ("b", "T2", "Q2"), ("c", "T3", None)]
    people = spark.createDataFrame([(1, "Old", ["x"]), (2, "Same", None)], "id int, name string, aliases array<string>")
    came = spark.createDataFrame([(1, "New"), (2, "Same"), (3, "Third")], "id int, name string")
    assert sorted(map(tuple, upserts.renamed(people, came, "id").collect())) == [(1, "New", ["Old", "x"]), (2, "Same", []), (3, "Third", [])]
    rated = spark.createDataFrame([(1, "Nick"), (1, "x"), (2, "Nick")], "id int, candidate_name string")
    assert sorted(map(tuple, upserts.with_rated_names(people, rated, "id").select("id", "aliases").collect())) == [(1, ["x", "Nick"]), (2, ["Nick"])]
    named = spark.createDataFrame([(0, "A", ["b", "B"]), (1, "b", ["A", "c"])], "position int, name string, aliases array<string>")
    assert [r["name"] for r in upserts.ordered_names(named).orderBy("position").collect()] == ["A", "b", "B", "c"]


def test_filters(spark):
    rows = spark.createDataFrame([(" 24K ", "CEO"), ("24A", "Co-director"), (None, None), ("24Z", "clerk")], "transaction_type string, occupation string")
    assert [r[0] for r in filters.supported(rows).collect()] == [" 24K ", "24Z"]
    assert [r[1] for r in filters.by_executives(rows).collect()] == ["CEO", "Co-director"]
    assert filters.by_executives(rows, ["clerk"]).count() == 1
    assert (filters.in_list(rows, "occupation", None).count(), filters.in_list(rows, "occupation", []).count(), filters.in_list(rows, "occupation", ["CEO"]).count()) == (4, 0, 1)
    assert (filters.name_contains(rows, "occupation", "").count(), filters.name_contains(rows, "occupation", "C_").count(), filters.name_contains(rows, "occupation", "DIR").count()) == (3, 0, 1)


def test_queries_over_whole_tables(spark, sf_dir):
    from ledgerweave.plans import catalogue

    d, rows = catalogue.Domain(spark, sf_dir), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    assert (d.executives.count(), d.donations.count()) == (rows("customer"), rows("orders"))
    assert catalogue.QUERIES["similarity_join"](spark, sf_dir).select("query").distinct().count() == rows("supplier")
    assert {r["rating_id"] % 4 for r in catalogue.QUERIES["resolve_ratings"](spark, sf_dir).collect()} == {0, 1, 2, 3}

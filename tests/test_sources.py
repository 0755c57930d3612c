"""Files: pipe-delimited, sectioned CSV, plain CSV, JSON; staged lookups; seeds; the stream."""

import json

from ledgerweave.sources import bulk, entities, scorecards, seeds
from ledgerweave.streaming import contributions as stream


def test_bulk_widths(spark, tmp_path):
    full = [f"v{k}" for k in range(15)]
    lines = ["|".join(full), "|".join(full[:14]), "|".join([*full, "more", "", "", "x", "y"]), "|".join(["C1", "", *full[2:]]), "", '"quoted | pipe"|' + "|".join(full[1:]), "caf\xe9|" + "|".join(full[1:])]
    (tmp_path / "cm.txt").write_bytes("\n".join(lines).encode("latin-1"))
    got = [tuple(r)[:2] for r in bulk.committees(spark, str(tmp_path / "cm.txt")).collect()]
    assert got == [("v0", "v1"), ("v0", "v1"), ("C1", ""), ("quoted | pipe", "v1"), ("café", "v1")]
    (tmp_path / "empty.txt").write_text("")
    assert bulk.linkages(spark, str(tmp_path / "empty.txt")).count() == 0
    (tmp_path / "pas2.txt").write_text("|".join([*map(str, range(13)), "01312026", *map(str, range(14, 22))]) + "\n" + "|".join([*map(str, range(13)), "bad", *map(str, range(14, 22))]))
    rows = bulk.contributions(spark, str(tmp_path / "pas2.txt"), 2026).collect()
    assert [(str(r["date"]), r["cycle"], r["transaction_amount"]) for r in rows] == [("2026-01-31", 2026, "14"), ("None", 2026, "14")]


def test_sectioned_csv(spark, tmp_path):
    lines = ["﻿Senate", "First Name,Last Name,Party,District,2024 Score,Lifetime Score,URL", "California", "Alex,Padilla,D,,95,90,u", "Bad,Score,D,,x,1,u", "No,Vote,R,,n/v,1,u", "Short,Row,D", "House", "Lost,State,D,1,50,50,u", "Texas", '"Jo, Ann",Doe,republican,2,B+,1,u', ",,D,1,5,5,u"]
    (tmp_path / "moc-listing-2024-01.csv").write_text("old")
    (tmp_path / "moc-listing-2024-02.csv").write_text("\n".join(lines))
    got = [(r["candidate_name"], r["state"], r["score"], r["party"]) for r in scorecards.read_csv_scorecard(spark, str(tmp_path), "Org", 2024, "environment").collect()]
    assert got == [("Alex Padilla", "CA", 95.0, "D"), ("Jo, Ann Doe", "TX", 85.0, "R")]


def test_plain_csv(spark, tmp_path):
    (tmp_path / "lcv_2023.csv").write_text("﻿Member,State,Party,2023 Score,Lifetime Score\nA B,CA,D,90,1\nC D,NY,,NA,1\nE F,,R,5,1\n")
    got = [tuple(r) for r in scorecards.read_csv_scorecard(spark, str(tmp_path), "Org", 2023, "i").collect()]
    assert got == [("Org", 2023, "i", "A B", "CA", 90.0, "D")]
    (tmp_path / "lcv_2022.csv").write_text("Member,State,Party,2023 Score\nA,CA,D,1\n")
    assert scorecards.read_csv_scorecard(spark, str(tmp_path), "Org", 2022, "i").count() == 0
    assert scorecards.read_csv_scorecard(spark, str(tmp_path), "Org", 1990, "i").count() == 0


def test_json_and_registry(spark, tmp_path):
    ratings = [{"candidate_name": "A", "state": "CA", "score": 80}, {"candidate_name": "B", "state": "NY", "score": "A-"}, {"candidate_name": "C", "state": "NY", "score": "N/A"}, {"candidate_name": "", "state": "NY", "score": 1}]
    (tmp_path / "my_org_2024.json").write_text(json.dumps({"issue": "labor", "ratings": ratings}))
    (tmp_path / "my_org_2023.json").write_text("{broken")
    reader = lambda s, year: scorecards.read_json_scorecard(s, str(tmp_path), "My Org", year, "other")
    got = sorted(tuple(r) for r in scorecards.all_scorecards(spark, [2022, 2023, 2024], [reader]).collect())
    assert got == [("My Org", 2024, "labor", "A", "CA", 80.0, None), ("My Org", 2024, "labor", "B", "NY", 90.0, None)]


def test_lookups(spark, tmp_path):
    (tmp_path / "hits.json").write_text(json.dumps({"search": [{"id": f"Q{k}", "label": f"L{k}", "match": {"type": "alias" if k == 1 else "label", "text": "T"}} for k in range(7)]}))
    hits = entities.search_hits(entities.read_json(spark, str(tmp_path / "hits.json"), f"query string, {entities.HITS}"))
    assert [(r["id"], r["alias"]) for r in hits.orderBy("position").collect()] == [("Q0", None), ("Q1", "T"), ("Q2", None), ("Q3", None), ("Q4", None)]
    cell = lambda v: {"type": "x", "value": v}
    uri = "http://www.example.org/entity/"
    (tmp_path / "b.json").write_text(json.dumps({"results": {"bindings": [{"item": cell(uri + "Q1"), "itemLabel": cell("One"), "parent": cell(uri + "Q2")}, {"item": cell(uri + "Q2"), "itemLabel": cell("Two"), "parent": cell(uri + "Q3")}, {"item": cell(uri + "Q4"), "itemLabel": cell("Soap"), "parent": cell(uri + "Q2")}, {"item": cell(uri + "Q5"), "itemLabel": cell(""), "parent": cell(uri + "Q2")}]}}))
    facts = entities.bindings(entities.read_json(spark, str(tmp_path / "b.json"), entities.BINDINGS))
    businesses = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "id string")
    owners = spark.createDataFrame([("Q2",), ("bad",)], "qid string")
    assert sorted(r["name"] for r in entities.subsidiaries(facts, owners).collect()) == ["One", "Soap"]
    assert [r["name"] for r in entities.discovered_brands(facts, businesses, owners).collect()] == ["Soap"]
    chain = entities.owner_chain(facts, spark.createDataFrame([("Q1",)], "id string"), 3)
    assert sorted((r["id"], r["parent"]) for r in chain.collect()) == [("Q1", "Q2"), ("Q2", "Q3")]
    asked = spark.createDataFrame([("b", 0, "Q1", "One", None), ("b", 1, "Q4", "Soap", None)], "query string, position int, id string, label string, alias string")
    assert [(r["id"], r["parent"]) for r in entities.business_hits(asked, businesses, facts).collect()] == [("Q1", "Q2")]
    statements = spark.createDataFrame([("subsidiary_of", "x"), ("controls", "y")], "predicate string, object string")
    assert entities.grouping_statements(statements).count() == 1


def test_seeds(spark):
    assert (seeds.issues(spark).count(), seeds.scorecards(spark).count(), seeds.covers(spark).count(), seeds.corporations(spark).count(), seeds.brands(spark).count()) == (10, 5, 6, 100, 50)
    assert seeds.corporations(spark).filter("name = 'Walmart'").first()["ticker"] == "WMT"


def test_stream_merges_amendments(spark, tmp_path):
    schema = spark.createDataFrame([], "committee_id string, candidate_id string, transaction_id string, transaction_type string, amount double, load_seq long").schema
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: sorted((r["transaction_id"], r["amount"]) for r in stream.merge_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema).collect())
    add([("c", "p", "1", "24K", 1.0, 1), ("c", "p", "2", "24A", 2.0, 2)])
    assert run() == [("1", 1.0)]
    add([("c", "p", "1", "24K", 5.0, 3), ("c", "p", "3", "24Z", 3.0, 4)])
    assert run() == run() == [("1", 5.0), ("3", 3.0)]


def test_late_and_unordered_writes(spark, tmp_path):
    """State outlives restarts: a write that is older than one of an earlier run is dropped; small batches, one snapshot each."""
    schema = spark.createDataFrame([], "committee_id string, candidate_id string, transaction_id string, transaction_type string, amount double, cycle int, load_seq long").schema
    add = lambda *rows: spark.createDataFrame([("c", "p", t, "24K", a, c, s) for t, a, c, s in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: sorted((r["transaction_id"], r["amount"], r["cycle"], r["writes"]) for r in stream.merge_available(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", str(tmp_path / "cp"), schema, files=1).collect())
    add(("1", 1.0, 2022, 5), ("1", 9.0, 2022, 4), ("2", 2.0, 2022, None))
    add(("3", 3.0, 2022, 1))
    assert run() == [("1", 1.0, 2022, 2), ("2", 2.0, 2022, 1), ("3", 3.0, 2022, 1)]
    add(("1", 7.0, 2024, 3), ("2", 4.0, 2024, 0))
    assert run() == run() == [("1", 1.0, 2022, 2), ("2", 4.0, 2024, 2), ("3", 3.0, 2022, 1)]
    add(("1", 8.0, 2024, 6), ("1", 8.5, 2024, 6), ("3", 3.5, 2022, 0))
    assert run() == [("1", 8.0, 2024, 5), ("2", 4.0, 2024, 2), ("3", 3.0, 2022, 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "x").rpartition(".")[2] != "RocksDBStateStoreProvider"


def test_stream_state_stays_in_the_engine(spark, tmp_path):
    """No call to Python for each key: at 24 million keys these were the job's time."""
    schema = spark.createDataFrame([], "committee_id string, candidate_id string, transaction_id string, transaction_type string, amount double, load_seq long").schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    plan = stream.amendments(stream.contributions_stream(spark, str(tmp_path / "in"), schema))._jdf.queryExecution().analyzed().toString()
    assert "max_by" in plan and "python" not in plan.lower() and "TransformWithState" not in plan


def test_carried_state_over_ranges(spark):
    """Every range width gives what one walk over the lines gives; no window runs over all rows."""
    marks = {-7: "Texas", 2: "House", 5: "Ohio", 9: "no state", 31: "Senate", 47: "New York", 90: "Iowa"}
    places = [p for p in range(-9, 100) if p % 4 != 3 or p in marks]
    want, state = {}, None
    for p in places:
        if p in marks and marks[p] != "no state":
            state = {"Texas": "TX", "Ohio": "OH", "New York": "NY", "Iowa": "IA"}.get(marks[p])
        want[p] = state
    lines = spark.createDataFrame([(p, marks.get(p)) for p in reversed(places)] + [(None, None)], "position long, marker string")
    for stretch in (1, 10, 64, scorecards.STRETCH):
        got = scorecards.carried_state(lines, "position", "marker", stretch)
        assert got.columns == ["position", "marker", "state"]
        assert {r["position"]: r["state"] for r in got.collect()} == {None: None, **want}


def test_carry_forward_state_reads_every_customer(spark, sf_dir):
    from ledgerweave.plans import catalogue

    assert catalogue.QUERIES["carry_forward_state"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()

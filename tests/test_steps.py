"""The load and scoring steps over a small stored graph, in order, again, and with forced reloads."""

import json

import pytest

from ledgerweave.operators import loads
from ledgerweave.plans import steps
from ledgerweave.plans.store import Store
from ledgerweave.sources import scorecards


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    filings = folder / "filings"
    filings.mkdir()
    line = lambda width, **at: "|".join(at.get(f"c{k}", "") for k in range(width)) + "\n"
    for cycle in (2022, 2024):
        (filings / f"cm_{cycle}.txt").write_text(line(15, c0="C1", c1="Meadow PAC", c9="Q", c12="C", c13="Meadow Foods Inc.") + line(15, c0="C2", c1="None", c13="NONE"))
        (filings / f"cn_{cycle}.txt").write_text(line(15, c0="H1", c1="BROOK, ADA" if cycle == 2022 else "BROOK, ADA MAE", c2="DEM", c4="NY", c5="H") + line(15, c0="H2", c1="STONE, LEO", c2="REP", c4="CA", c5="S"))
        gift = lambda tran, kind, dollars, who="H1": line(22, c0="C1", c5=kind, c13="01152022", c14=dollars, c16=who, c17=tran)
        (filings / f"pas2_{cycle}.txt").write_text(gift("t1", "24K", "5000") + gift("t1", "24K", "9000") + gift(f"t{cycle}", "24Z", "11000") + gift("t3", "24A", "1") + gift("t4", "24K", "1", "nobody"))
        (filings / f"ccl_{cycle}.txt").write_text(line(7, c0="H1", c3="C1", c6="L1") + line(7, c0="H9", c3="C1", c6="L2"))
    store = Store(spark, f"file://{folder}/store")
    brand = "Sony"
    hits = spark.createDataFrame([(brand, 1, 0, brand, None, "Q1", "TDE", "us_de", None), ("Acer", 1, 0, "nothing alike", None, "Q9", None, None, None)], steps.HITS)
    facts = spark.createDataFrame([("Q1", brand, "Q2", "Meadow Foods", "TDE"), ("Q3", "Meadow Soap", "Q1", brand, None), ("Q4", "Suds", "Q1", brand, None)], steps.FACTS)
    businesses = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "id string")
    raw = spark.createDataFrame([("ACLU", 2022, "x", "Ada Brook", "NY", 80.0, "D"), ("ACLU", 2022, "x", "Leo Stone", "CA", 20.0, "R"), ("ACLU", 2022, "x", "Ida New", "TX", 50.0, "D")], scorecards.RATING)
    steps.run_schema(store)
    steps.run_brands(store, hits, facts, businesses)
    done = [steps.run_fec(store, str(filings), [2022]), steps.run_fec(store, str(filings), [2022, 2024]), steps.run_fec(store, str(filings), [2022, 2024])]
    steps.run_pac_linkage(store)
    steps.run_scorecards(store, raw)
    steps.run_scores(store, (2022, 2024), str(folder / "scores.json"))
    return store, filings, folder, done


def table(store, name, schema, *columns):
    return sorted(tuple(r) for r in store.read(name, schema).select(*columns).collect())


def test_cycles_are_loaded_once(loaded):
    store, filings, _, done = loaded
    assert done == [[2022], [2024], []] and store.cycle_loaded(2022) and not store.cycle_loaded(2020)
    assert table(store, "contributed_to", steps.CONTRIBUTED, "tran", "amount", "cycle") == [("t1", "9000", 2024), ("t2022", "11000", 2022), ("t2024", "11000", 2024)]
    assert steps.run_fec(store, str(filings), [2024], force=True) == [2024]
    assert len(table(store, "contributed_to", steps.CONTRIBUTED, "tran")) == 3 and table(store, "authorized", loads.LINKAGE, "candidate_id", "linkage_id") == [("H1", "L1")]


def test_owners_and_committees(loaded):
    store = loaded[0]
    assert ("Sony", "Sony") in table(store, "owned_by", steps.OWNED_BY, "brand", "corp") and ("Suds", "Sony") in table(store, "owned_by", steps.OWNED_BY, "brand", "corp")
    assert set(table(store, "subsidiary_of", steps.SUBSIDIARY_OF, "child", "parent")) == {("Sony", "Meadow Foods"), ("Meadow Soap", "Sony"), ("Suds", "Sony")}
    assert table(store, "operates_pac", steps.OPERATES_PAC, "corp", "committee") == [("Meadow Foods", "C1")]
    assert dict(table(store, "resolution", "brand string, id string", "brand", "id"))["Acer"] is None


def test_people(loaded):
    store = loaded[0]
    people = {r["candidate_id"]: r for r in store.read("candidate", loads.CANDIDATE).collect()}
    assert people["H1"]["name"] == "BROOK, ADA MAE" and people["H1"]["aliases"][0] == "BROOK, ADA" and not people["H1"]["provisional"]
    made = [r for r in people.values() if r["provisional"]]
    assert [(r["candidate_id"], r["name"], r["state"]) for r in made] == [("PROV_TX_IDA_NEW", "Ida New", "TX")]


def test_scores_and_export(loaded):
    store, _, folder, _ = loaded
    rows = {(r["brand_name"], r["issue_name"]): r for r in store.scores().collect()}
    assert {i for b, i in rows if b == "Sony"} == {"civil_liberties", "digital_rights"}
    got = rows["Sony", "digital_rights"]
    assert (got["score"], got["dollars"], got["candidates"], got["confidence"], got["cycles"]) == (80.0, 31000.0, 1, "medium", [2022, 2024]) and got["computed_at"]
    assert json.loads((folder / "scores.json").read_text())["brands"]["Sony"]["digital_rights"]["ACLU"]["score"] == 80.0


def test_provisional_people_are_reconciled(loaded):
    store, filings, _, _ = loaded
    (filings / "cn_2024.txt").write_text((filings / "cn_2024.txt").read_text() + "H3|NEW, IDA|DEM||TX|H" + "|" * 9 + "\n")
    steps.run_fec(store, str(filings), [2024], force=True)
    people = {r["candidate_id"]: r for r in store.read("candidate", loads.CANDIDATE).collect()}
    assert "PROV_TX_IDA_NEW" not in people and people["H3"]["aliases"] == ["Ida New"]
    assert ("H3", 50.0) in table(store, "rates", steps.RATES, "candidate", "score")

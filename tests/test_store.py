"""Snapshots, partitions that a load touches, writers that meet, and steps without their input."""

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import serve
from ledgerweave.plans import steps
from ledgerweave.plans.store import MissingTable, SnapshotTaken, Store

GIFT = "committee string, candidate string, tran string, amount string, cycle int"
KEY = ("committee", "candidate", "tran")


def gifts(spark, *rows):
    return spark.createDataFrame(list(rows), GIFT)


def folders(store):
    return set(store._snapshot("gift")[1]["folders"])


def rows(store):
    return sorted(map(tuple, store.need("gift", GIFT).collect()))


def test_a_load_writes_no_file_of_another_cycle(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.merge("gift", gifts(spark, *((f"C{k}", "H", "t", "1", 2022) for k in range(40))), KEY)
    before = folders(store)
    assert len(before) > 8 and all("cycle=2022" in f for f in before)
    store.merge("gift", gifts(spark, *((f"C{k}", "H", "u", "2", 2024) for k in range(40))), KEY)
    after = folders(store)
    assert before < after and all("cycle=2024" in f for f in after - before)
    # an amendment of one gift in its own cycle rewrites one partition
    store.merge("gift", gifts(spark, ("C3", "H", "u", "9", 2024)), KEY)
    assert len(folders(store) - after) == len(after - folders(store)) == 1 and len(rows(store)) == 80 and ("C3", "H", "u", "9", 2024) in rows(store)
    # the same key in a later cycle leaves the older one, also where it was its partition's only row
    last = folders(store)
    store.merge("gift", gifts(spark, *((f"C{k}", "H", "t", "7", 2024) for k in range(40))), KEY)
    assert {r[4] for r in rows(store) if r[2] == "t"} == {2024} and len(rows(store)) == 80
    assert not any("cycle=2022" in f for f in folders(store)) and folders(store) != last


def test_a_null_cycle_is_a_partition(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.merge("gift", gifts(spark, ("C", "H", "t", "1", None), ("D", "H", "t", "1", 2024)), KEY)
    store.merge("gift", gifts(spark, ("C", "H", "t", "2", 2024), ("D", "H", "t", "2", None)), KEY)
    assert sorted(map(str, map(tuple, store.need("gift", GIFT).collect()))) == sorted(map(str, [("C", "H", "t", "2", 2024), ("D", "H", "t", "2", None)]))


def test_merge_like_a_dictionary(spark, tmp_path):
    import random

    rng, store, want = random.Random(2), Store(spark, f"file://{tmp_path}/s"), {}
    for load in range(5):
        new = {(f"C{rng.randrange(4)}", f"H{rng.randrange(4)}", f"t{rng.randrange(3)}"): (str(load), rng.choice([2020, 2022, 2024])) for _ in range(12)}
        want |= new
        store.merge("gift", gifts(spark, *((*k, *v) for k, v in new.items())), KEY, buckets=3)
        assert rows(store) == sorted((*k, *v) for k, v in want.items())
    assert store.need("gift", GIFT).filter("cycle = 2022").count() == sum(v[1] == 2022 for v in want.values())
    plan = store.need("gift", GIFT).filter("cycle = 2022")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cycle" in plan
    with pytest.raises(ValueError, match="3 buckets"):
        store.merge("gift", gifts(spark, ("C", "H", "t", "1", 2024)), KEY, buckets=5)
    store.clean("gift", keep=1)
    assert rows(store) == sorted((*k, *v) for k, v in want.items()) and len(store.versions("gift")) == 1
    kept = {p.parent.relative_to(tmp_path / "s/gift/data").as_posix() for p in (tmp_path / "s/gift/data").rglob("*.parquet")}
    assert kept == folders(store)


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    one.write("gift", gifts(spark, ("C1", "H", "t", "1", 2024)))
    number, content = two._snapshot("gift")
    one.write("gift", gifts(spark, ("C2", "H", "t", "1", 2024)))
    with pytest.raises(SnapshotTaken):
        two._claim("gift", number + 1, content)
    assert [r[0] for r in rows(one)] == ["C2"]


def test_readers_keep_their_snapshot(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("gift", gifts(spark, ("C1", "H", "t", "1", 2024)))
    old = store.need("gift", GIFT)
    for k in range(4):
        store.write("gift", gifts(spark, (f"D{k}", "H", "t", "1", 2024)))
    assert [r["committee"] for r in old.collect()] == ["C1"]


def test_steps_say_what_is_missing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for run in (steps.run_pac_linkage, steps.run_scores, lambda s: steps.run_scorecards(s, spark.createDataFrame([], "org_name string, candidate_name string, state string"))):
        with pytest.raises(MissingTable, match="never written"):
            run(store)


def test_rank_join_is_the_whole_join(spark):
    """Ties, unknown amounts, unrated candidates, issues, more corporations than rows."""
    import random

    rng = random.Random(8)
    trails = spark.createDataFrame([("b", k % 9) for k in range(14)] + [("c", 2)], "brand string, corp int")
    gifts = spark.createDataFrame([(rng.randrange(12), rng.randrange(30), rng.randrange(25), rng.choice([None, 1.0, 2.0, 3.0, float(rng.randrange(50))]), str(t)) for t in range(4000)], "corp int, committee int, candidate int, amount double, tran string")
    rates = spark.createDataFrame([(f"o{k % 3}", k, float(k)) for k in range(20)], "org string, candidate int, score double")
    covers = spark.createDataFrame([("o0", "i"), ("o1", "j"), ("o1", "i")], "org string, issue string")
    for issues in (None, ["j"], []):
        for limit in (1, 7, 100):
            serve.TRAIL_ROWS, old = limit, serve.TRAIL_ROWS
            try:
                joined = trails.join(gifts, "corp").join(rates, "candidate").join(covers, "org")
                joined = joined if issues is None else joined.filter(F.col("issue").isin(issues) if issues else F.lit(False))
                columns = ["brand", "corp", "committee", "candidate", "amount", "tran", "score", "org", "issue"]
                want = joined.select(columns).orderBy(F.desc_nulls_first("amount"), "brand", "corp", "committee", "candidate", "org", "issue", "tran").limit(limit).collect()
                assert serve.money_trail(trails, gifts, rates, covers, "committee", issues).collect() == want
                leading = serve.leading_gifts(gifts.withColumn("amount", F.col("tran").cast("double")), "committee", limit)
                assert leading.groupBy("corp").count().agg(F.max("count")).first()[0] == limit
            finally:
                serve.TRAIL_ROWS = old


def test_index_reads_only_its_posting_lists(spark, tmp_path):
    """Against a scan, for any text; the plan's files are those of the text's runs."""
    import zlib

    from ledgerweave.operators import filters

    words = ["Älmond Red", "almond", "red blue", "REDBLUE", "", None, "ab", "a%b_c", "blue red blue", "ed", "x" * 50, "İstanbul"]
    names = spark.createDataFrame([(w,) for w in words], "name string")
    store = Store(spark, f"file://{tmp_path}/s")
    store.write_name_index("index", names)
    for part in ("red", "ED B", "lmo", "%b_", "xxxx", "blue", "nothing", "ÄLM", "red blue red", "i̇st"):
        got = store.named("index", part)
        assert {r["name"] for r in got.collect()} == {r["name"] for r in filters.name_contains(names, "name", part).distinct().collect()}, part
    assert store.named("index", "ed") is None and store.named("index", "") is None
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = store.named("index", "red")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(bucket" in plan and f" = {zlib.crc32(b'red') % filters.POSTING_BUCKETS})" in plan and "EqualTo(gram,red)" in plan
    read = {int(r["bucket"]) for r in store.need("index", filters.POSTING).filter("gram = 'red'").select("bucket").distinct().collect()}
    assert read == {zlib.crc32(b"red") % filters.POSTING_BUCKETS}

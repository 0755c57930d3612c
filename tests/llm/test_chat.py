import random

import duckdb

from ledgerweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string"


def brute(rows):
    whole = {}
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            whole.setdefault(conv, []).append((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else "") for x in t)
    seqs = {c: tuple((r, x) for _, r, x in sorted(t, key=key)) for c, t in whole.items()}
    prefixes = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    out = {}
    for s in set(seqs.values()) - prefixes:
        same = [c for c, x in seqs.items() if x == s]
        out[min(same)] = (len(s), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in s))
    return out


def test_like_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(80):
        for turn in range(rng.randint(1, 4)):
            rows.append((conv, turn, rng.choice(["user", None]) if turn % 2 else "user", rng.choice(["a", "b", "", None]), "x"))
    rows += [(None, 0, "user", "a", "x"), (200, 0, "user", "tie", "x"), (200, 0, "user", "tie", "x"), (201, 0, "user", "z" * 100_000, "x")]
    rng.shuffle(rows)
    got = {r["conv_id"]: (r["n_turns"], r["n_logged"], r["rendered"]) for r in chat.rendered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_like_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(chat.OP10_SQL)
    assert sorted(tuple(r) for r in chat.op10_chat_snapshots(spark, sf_dir).select(*want.columns).collect()) == sorted(want.fetchall())


def test_native_and_empty(spark):
    empty = chat.rendered(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))

import random
import re

from ledgerweave.llm import decontaminate

from .helpers import ODD, documents

ITEM = "A farmer near Boston sells 12 apples for 30 dollars. How many apples does Mary buy from the farmer if she pays 30 dollars and keeps 12 for her mother?"
OTHER = ITEM.replace("12", "15").replace("30", "45").replace("Mary", "Alice").replace("Boston", "Denver").replace("dollars", "euros")
UNSTEADY = ITEM.replace("12", "15", 1).replace("30", "45", 1)
CLEAN = "The library opens at noon and closes late; readers may keep three books for two weeks and renew them once by letter or in person."


def table(spark):
    return spark.createDataFrame([(7, ITEM), (8, CLEAN.upper()), (9, None), (10, "too short"), (None, ITEM)], "item_id long, text string")


def test_verbatim_reworded_and_clean(spark):
    texts = ["Once " + ITEM + " and so on", "before " + OTHER + " after", CLEAN + " x", "A quite different text about farmers near a river, with 12 apples for 30 dollars or so.", *ODD]
    docs = documents(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontaminate.contaminated(docs, table(spark)).collect()}
    assert got == {(0, 7): False, (1, 7): True, (2, 8): False}
    assert sorted(got) == sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table(spark), most_sent=0).collect())


def test_inconsistent_slots_are_no_match(spark):
    """What is left without the windows that replace a value that stands for two: 16 of 25 windows."""
    rows = decontaminate.contaminated(documents(spark, [UNSTEADY, OTHER]), table(spark), share=0.65).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(1, 7)]


def test_a_word_between_changes_nothing(spark):
    """Two alignments that give a value two meanings together leave what one alignment does."""
    halves = ITEM.replace("12", "15", 1).replace("12", "99")
    between = halves.replace("How many", "So how many")
    twice = OTHER + " " + OTHER.replace("15", "16").replace("45", "46").replace("Alice", "Karen")
    got = {r["doc_id"]: (r["n_windows"], r["reworded"]) for r in decontaminate.contaminated(documents(spark, [halves, between, twice, between + " " + halves]), table(spark)).collect()}
    assert got[0][1] is False and got[1][1] is False and got[2] == (25, True)
    assert 0 < got[0][0] - got[1][0] <= 6 and got[3] == got[0]  # the new word stands in up to six windows


def brute_tokens(text):
    """(template token, value or None) of an ASCII text."""
    out, last = [], None
    for m in re.finditer("[0-9A-Za-z]+", text):
        word, start = m.group(), last is None or bool(re.search("[\n!.:?]", text[last : m.start()]))
        behind = bool(out) and out[-1][0] == "<number>"
        kind = "<number>" if word.isdigit() else "<unit>" if behind and word.lower() in decontaminate.UNITS else "<name>" if re.fullmatch("[A-Z][a-z]+", word) and not start else None
        out.append((kind or word.lower(), word.lower() if kind else None))
        last = m.end()
    return out


def brute_match(text, item):
    """(n_windows, total, reworded) by the definition: every window of the text against every window of the item."""
    windows = lambda t: [(i, tuple(w[0] for w in t[i : i + 6]), tuple(w[1] for w in t[i : i + 6])) for i in range(len(t) - 5) if sum(w[1] is None for w in t[i : i + 6]) >= 3]
    mine, theirs = windows(brute_tokens(text)), windows(brute_tokens(item))
    met = {(i - j, j, tuple((b, a) for a, b in zip(u, v, strict=True) if b)) for i, x, u in mine for j, y, v in theirs if x == y}

    def count(rows):
        stands = {}
        for _, _, slots in rows:
            for b, a in slots:
                stands.setdefault(b, set()).add(a)
        kept = [(j, slots) for _, j, slots in rows if not any(a != b and len(stands[b]) > 1 for b, a in slots)]
        return len({j for j, _ in kept}), any(a != b for _, slots in kept for b, a in slots)

    together = count(met)
    shifts = sorted({r[0] for r in met})
    number = {s: sum(b - a > len(theirs) / 2 for a, b in zip(shifts, shifts[1:], strict=False) if b <= s) for s in shifts}
    alone = max((count([r for r in met if number[r[0]] == k]) for k in set(number.values())), default=(0, False))
    return (*(alone if alone[0] > together[0] else together), len(theirs))


def test_slots_like_brute_force(spark):
    rng = random.Random(11)
    items = [ITEM, "At noon Peter walks 3 miles to Oxford and 3 miles back, then he buys 40 g of tea. Does Peter need 7 hours for the 6 miles, or 40 minutes?"]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 2)):
            words = rng.choice(items).split(" ")
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(words))
                words[k] = rng.choice([words[k], "15", "99", "Alice", "miles", "so"]) if words[k].strip(".?,").isalnum() else words[k]
            if rng.random() < 0.5:
                words.insert(rng.randrange(len(words)), "indeed")
            parts.append(" ".join(words))
        texts.append(" and. ".join(parts))
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["reworded"]) for r in decontaminate.contaminated(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            n, reworded, total = brute_match(text, item)
            if n >= 3 and n / total >= decontaminate.SHARE:
                want[d, i] = (n, reworded)
    assert got == want and len({r for _, r in want.values()}) == 2 and len(want) > 40


def test_windows_like_brute_force(spark):
    """Texts without slots: the windows are those of plain lower-cased words."""
    import re

    texts = ["one two three four five six seven eight", "zero one two three four five six", "six five four three two one zero"]
    items = ["one two three four five six seven", "nothing of this is in any text here at all"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, item in enumerate(items):
        grams = lambda t: {tuple(w[k : k + 6]) for w in [re.findall(r"\w+", t)] for k in range(len(w) - 5)}
        for d, text in enumerate(texts):
            both = grams(item) & grams(text)
            if len(both) >= 1 and len(both) / len(grams(item)) >= 0.35:
                want.add((d, i, len(both)))
    got = decontaminate.contaminated(documents(spark, texts), benchmark, least=1).collect()
    assert {(r["doc_id"], r["item_id"], r["n_windows"]) for r in got} == want


def test_null_ids_repeats_and_empty(spark):
    docs = documents(spark, [ITEM, ITEM, ITEM], [None, 4, 4])
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table(spark)).collect()] == [(4, 7)]
    assert decontaminate.contaminated(documents(spark, []), table(spark)).count() == 0
    assert decontaminate.contaminated(docs, table(spark).limit(0)).count() == 0


def test_short_and_number_dense_items(spark):
    """Items with fewer than LEAST windows: all that they have is needed, and each is found as it is."""
    items = ["What is the capital of France?", "Who founded Rome in 753?", "Paris", "12 km 30 kg 45 mm 60 g 75 ml 90 l", "it holds 12 30 45 of 60 75 90 units", "!?", "one two three four five six seven"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f'They asked "{item}" and went on.' for item in items]
    texts += ["Then who founded Athens in 508?", "Berlin", "12 km 30 kg 45 mm 60 g 75 ml 91 l", "one two three four five six", "What is the capital of", "it holds 13 31 46 of 61 76 91 units", *ODD]
    want = {(k, k, False) for k in range(len(items)) if items[k] != "!?"} | {(len(items), 1, True), (len(items) + 5, 4, True)}
    for most_sent in (decontaminate.MOST_SENT, 0):
        got = decontaminate.contaminated(documents(spark, texts), benchmark, most_sent=most_sent).collect()
        assert {(r["doc_id"], r["item_id"], r["reworded"]) for r in got} == want
        assert len(got) == len(want) and all(r["coverage"] == 1 for r in got)


def test_whole_items_do_not_cross_texts(spark):
    benchmark = spark.createDataFrame([(1, "red green"), (2, "7 8 9 10 11 12 13 14")], "item_id long, text string")
    docs = documents(spark, ["red", "green", "red red green red green", "7 8 9 10 11", "12 13 14", "6 7 8 9 10 11 12 13 14 15"])
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_windows"]) for r in got) == [(2, 1, 1), (5, 2, 1)]


def test_clashing_windows_alone_are_left_out(spark, tmp_path):
    """A value that stands for two costs the windows that replace it, in the query and in the pipeline's stage."""
    import corpus_pipeline

    roles = "A shop at the corner packs 2 boxes of 2 pens for the school. The teacher gives every pupil one pen and asks how many pupils go home without any of them."
    noise = ITEM.replace("12", "15", 1).replace("12", "16").replace("30", "45", 1).replace("30", "46").replace("Mary", "Alice").replace("farmer", "baker").replace("apples", "loaves")
    texts = ["So: " + UNSTEADY, roles.replace("2", "3", 1).replace("2", "5"), noise, OTHER, ITEM, CLEAN]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, ITEM), (8, roles)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in decontaminate.op1_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert {d: (r["item_id"], r["reworded"]) for d, r in got.items()} == {0: (7, False), 1: (8, False), 3: (7, True), 4: (7, False)}
    # 25 windows; the first nine hold a value that stands for two and is another there
    assert got[0]["n_windows"] == 16 and got[3]["n_windows"] == got[4]["n_windows"]
    kept = corpus_pipeline.drop_benchmark_leaks(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5]

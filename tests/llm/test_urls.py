import pytest

from ledgerweave.llm import urls

URLS = [
    "http://A.Example.ORG/es/1", "https://example.org/en/12", "https://x.example.org/en/2", "http://notexample.org/es/1", "http://shop.com/fr/", "http://shop.com/de/x", "http://shop.com/dex",
    "http://org", "http://org/", "http://ORG/", "no scheme", "", None, "://", "http://h?q=http://org/", "http://h#/de/", "ftp://u:p@h.com:80/de/1?x#y", "http://a://b.org/", "http://É.org/x", "http://casino-bets.example.net/win",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end : min([k for k in (rest.find("?", end), rest.find("#", end)) if k >= 0], default=len(rest))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(str(r)), default=None)
    return host, path, best and str(best), best and best.verdict


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(spark)


def test_hosts_paths_and_rules(spark, model):
    pages = spark.createDataFrame([(k, u, "<html>", "x") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    for r in urls.judged(pages, model).collect():
        host, path, rule, verdict = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_learns_its_table_and_runs_no_python(spark, model):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls.BLOCKED + urls.ALLOWED)], "page_id long, url string")
    judged = urls.judged(pages, model, rules=())
    assert all((r["verdict"] == "block") == (r["page_id"] < len(urls.BLOCKED)) for r in judged.collect())
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange"))


def test_empty_table(spark, model):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_grams_like_brute_force(spark):
    texts = ["", "a", "ab", "abc", "a.b-c/é中😀x", "x\n$^y", "long/" * 40_000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", urls._grams(frame.t, 3, "h").alias("three"), urls._grams(frame.t, 4, "p").alias("four")).collect():
        for size, mark, got in ((3, "h", r["three"]), (4, "p", r["four"])):
            marked = f"^{r['t']}$"
            assert got == [mark + marked[k : k + size] for k in range(len(marked) - size + 1)]


def test_null_ids_and_repeated_rows(spark, model):
    url = "http://casino-bets.example.net/win"
    got = [tuple(r) for r in urls.judged(spark.createDataFrame([(None, url), (1, url), (1, url), (2, None)], "page_id long, url string"), model).collect()]
    assert len(got) == 4 and len({r[1:] for r in got if r[0] != 2}) == 1

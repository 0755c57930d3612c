"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host and path.

Everything runs in the JVM: regular expressions and array functions make the n-grams, Spark ML's feature hashing and
logistic regression (its DataFrame API) do the rest, so a page costs no shuffle. The training table is small and
part of this module.

A null url, or one without ``://``, has an empty host and path; it is judged like any other. Null ids, repeated rows
and other columns do no harm: each row is judged on its own url, whole whatever its length, and equal urls are judged
alike. Of rules of equal length the first given wins; a score of exactly 0.5 blocks. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashed n-gram features; lengths of the n-grams of host and path.
FEATURES, HOST_GRAMS, PATH_GRAMS = 1 << 13, (3, 4), (3,)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: The labelled URL table: addresses to block (1) and to allow (0).
BLOCKED = """
http://cheap-pills.shop.net/buy http://www.cheap-meds.example.com/en/1 https://pills-online.example.net/order/2
http://casino-win.example.com/play https://blog.casino-royal.net/bonus http://win-casino.example.org/en/12
http://free-bets.example.com/offer http://www.sure-bets.example.net/tips https://bets-free.example.org/de/3
http://adult-x.example.net/gallery https://www.adult-video.example.com/en/9 http://xxx-adult.example.org/watch
http://spam-farm.example.com/links https://link-farm.example.net/es/4 http://www.spam-links.example.org/en/7
http://ads-track.example.org/click https://track-ads.example.com/pixel?x=1 http://m.ads-server.example.net/banner
http://loan-fast.example.com/apply https://www.fast-cash.example.net/fr/6 http://poker-win.example.org/table
https://cheap-watch.example.com/replica http://free-money.example.net/claim http://hot-adult.example.com/cam
""".split()
ALLOWED = """
http://www.example.com/en/10 https://blog.example.net/fr/20 http://example.org/about https://m.example.com/es/5
http://thorin.example.net/en/31 https://blog.thering.example.com/en/8?page=2 http://www.tionand.example.net/es/44
https://www.thatone.example.com/en/72.html http://m.tionth.example.org/de/13 https://thernd.example.com/fr/9
https://ththon.example.net/en/61 http://blog.tionre.example.org/en/90 https://www.therea.example.net/de/27#top
http://library.example.org/books/12 https://docs.example.net/guide/start http://news.example.com/world/2020
https://school.example.org/courses http://museum.example.net/visit https://journal.example.com/article/77
http://weather.example.net/today https://wiki.example.org/page/Spark http://recipes.example.com/soup
https://garden.example.net/roses http://travel.example.org/trains
""".split()


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Equal lengths: the first given."""
    fits = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: -len(str(r)))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def _grams(text: Column, size: int, mark: str) -> Column:
    """The marked n-grams of ^text$, from shifted arrays of its characters, in time linear in its length."""
    text = F.concat(F.lit("^"), text, F.lit("$"))
    many, letters = F.greatest(F.length(text) - size + 1, F.lit(0)), F.split(text, "")
    grams = F.transform(F.slice(letters, F.lit(1), many), lambda c: F.concat(F.lit(mark), c))
    for k in range(2, size + 1):
        grams = F.zip_with(grams, F.slice(letters, F.lit(k), many), lambda a, b: F.concat(a, b))
    return grams


def with_grams(urls: DataFrame) -> DataFrame:
    """urls with host, path and their marked character n-grams."""
    parted = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return parted.withColumn("grams", F.concat(*(_grams(F.col("host"), n, "h") for n in HOST_GRAMS), *(_grams(F.regexp_replace("path", "[0-9]+", "0"), n, "p") for n in PATH_GRAMS)))


def train(spark: SparkSession, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED) -> PipelineModel:
    table = spark.createDataFrame([(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed], "url string, label double").coalesce(1)
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    regression = LogisticRegression(regParam=0.01, maxIter=60).fit(hashing.transform(with_grams(table)))
    return PipelineModel([hashing, regression])


def judged(pages: DataFrame, model: PipelineModel, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages(page_id, url) with host, path, rule, verdict (allow or block) and the method's score for block."""
    scored = model.transform(with_grams(pages.select("page_id", "url"))).withColumn("score", vector_to_array("probability")[1])
    found = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(
        "page_id", "url", "host", "path", found["rule"].alias("rule"),
        F.coalesce(found["verdict"], F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return judged(common.table(spark, sf_dir, "pages"), train(spark)).select("page_id", "host", "path", "rule", "verdict", "score")

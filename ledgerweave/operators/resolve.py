"""Name resolution: companies by similarity, scorecard names by staged lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.names import company_key, filed_name, fold_accents, other_filed_names, printed_name, provisional_id, qid
from ledgerweave.functions.similarity import THRESHOLD, block_ratio, letter_counts, most_matched, placed_grams
from ledgerweave.operators.filters import has_sponsor
from ledgerweave.plans.scratch import work_dir, written


#: Characters of the runs that find a first partner (long ones stay rare among many names), how many of a key's rarest
#: runs are looked up, and names that such a run may be in.
SEED_GRAMS, SEEDS, SEED_NAMES = (4, 8), 4, 256
#: Characters that each of a pair may lose to become equal, and length of a key, for partners to be found by equal remains.
LOST, LOST_SIZE = 2, 40
#: Places that stand together in the index of two-character runs, and runs that a name must share there at most.
PLACES, SHARED = 8, 3


def _features(keys: DataFrame, key: str, tag: str) -> DataFrame:
    return keys.withColumns({f"{tag}_size": F.length(key), f"{tag}_letters": letter_counts(F.col(key)), f"{tag}_pairs": F.transform(placed_grams(F.col(key), 2), lambda g: g["gram"])})


def _bound(low: str = "q", high: str = "k") -> Column:
    """The greatest ratio that the pair can have."""
    most = most_matched(f"{low}_letters", f"{high}_letters", f"{low}_pairs", f"{high}_pairs", F.col(f"{low}_size"), F.col(f"{high}_size"))
    total = F.col(f"{low}_size") + F.col(f"{high}_size")
    return F.when(total == 0, 1.0).otherwise(2.0 * most / total)


def _dealt(rows: DataFrame) -> DataFrame:
    """Exploded rows as a side of a join: Spark takes them to be as many as they were before, and would send them whole."""
    return rows.hint("merge")


def _rarest(keys: DataFrame, sizes: Sequence[int], frequency: DataFrame) -> DataFrame:
    """(q, grams): a key's runs with the number of names that have them, the rarest first."""
    grams = keys.select("q", F.explode(F.concat(*(placed_grams(F.col("q"), size) for size in sizes))).alias("g")).select("q", "g.gram", "g.place").join(_dealt(frequency), "gram", "left")
    return grams.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram", "place"))).alias("grams"))


def _remains(keys: DataFrame, key: str, size: str, count: int) -> DataFrame:
    """keys with ``rest``: a hash of the key without count of its characters, for each way to take them."""
    texts = F.array(key)
    for _ in range(count):
        cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        texts = F.array_distinct(F.flatten(F.transform(texts, cut)))
    return keys.filter(F.col(size) >= count).withColumn("rest", F.explode(texts)).withColumn("rest", F.xxhash64("rest"))


def _one_off(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(q, k) of the pairs of which one is the other without one of its characters."""
    asked, named = (rows.filter(F.col(size) <= LOST_SIZE).select(key, size) for rows, key, size in ((keys, "q", "q_size"), (known, "k", "k_size")))
    ways = ((0, 1), (1, 0))
    return reduce(DataFrame.unionByName, (_remains(asked, "q", "q_size", a).join(_dealt(_remains(named, "k", "k_size", b)), "rest").select("q", "k") for a, b in ways)).distinct()


def first_partners(keys: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """keys (q, features), known (k, name, position, features) -> (q, score, position, name): for each key the partner
    with the greatest bound and then the fewest edits among names that differ by one character, or else among those that share one of its rarest
    runs, if it reaches the threshold.

    This only decides how much is compared afterwards, never what is found: any partner's score is a floor of the best.
    """
    spark = keys.sparkSession
    close = written(_one_off(keys, known), f"{work_dir(spark, 'similar')}/close")
    rest = keys.join(close, "q", "left_anti")
    grams = lambda key: F.array_distinct(F.transform(F.concat(*(placed_grams(F.col(key), n) for n in SEED_GRAMS)), lambda g: g["gram"]))
    sought = rest.select(F.explode(grams("q")).alias("gram")).distinct()
    runs = known.select("k", F.explode(grams("k")).alias("gram")).join(_dealt(sought), "gram", "left_semi")
    rare = _rarest(rest, SEED_GRAMS, runs.groupBy("gram").agg(F.count(F.lit(1)).alias("names")))
    rare = rare.select("q", F.explode(F.slice(F.filter("grams", lambda g: (g["names"] > 0) & (g["names"] <= SEED_NAMES)), 1, SEEDS)).alias("g")).select("q", "g.gram")
    pairs = close.unionByName(rare.join(_dealt(runs), "gram").select("q", "k").distinct()).join(keys, "q").join(known, "k")
    # letters in another order have the same bound, not the same order
    unlike = F.levenshtein("q", "k")
    best = pairs.groupBy("q").agg(F.min_by(F.struct("k", "name", "position"), F.struct(-_bound(), unlike, "position")).alias("p"))
    scored = best.select("q", "p.k", "p.name", "p.position").withColumn("score", block_ratio("q", "k"))
    return scored.filter(F.col("score") >= threshold).select("q", "score", "position", "name")


def rival_pairs(keys: DataFrame, known: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """(q, k, name, position): every pair that may beat the key's first partner, by score or, at its score, by position.

    A floor f asks for m >= f (|q| + |k|) / 2 matched characters, which stand in the same order in both. So q without
    |q| - m of its characters is k without |k| - m, in some way: for each length of k for which both are at most LOST,
    partners are found by these equal remains, and the work grows with the keys and not with their pairs.

    For other lengths: with a floor f and m >= f (|q| + |k|) / 2 matched characters, at least 3 m - |q| - |k| - 1 two-character runs of q are
    matched, in k at places that differ by at most the unmatched |q| + |k| - 2 m. So of q's runs, rarest first, one of
    all but that many, and one, is in k nearby, two of one more, and so on up to SHARED: these are looked up in an index
    of runs by place, and names with fewer of them go. A key for which this
    asks for no run at all meets the names whose length can reach its floor.
    """
    floored = keys.join(first.select("q", F.col("score").alias("floor"), F.col("position").alias("held")), "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float(threshold))))
    n, floor, tiny = F.col("q_size"), F.col("floor"), 1e-9
    low, high = F.ceil(n * floor / (2 - floor) - tiny).cast("int"), F.floor(n * (2 - floor) / floor + tiny).cast("int")
    floored = floored.withColumns({"low": low, "high": high})

    held = known.agg(F.collect_set("k_size").alias("held_sizes"))  # one row, no longer than the longest key
    matched = F.ceil(floor * (n + F.col("size")) / 2 - tiny).cast("int")
    lengths = floored.crossJoin(F.broadcast(held)).select("q", "q_size", "floor", F.explode(F.filter(F.sequence("low", F.greatest("low", "high")), lambda x: F.array_contains("held_sizes", x))).alias("size"))
    lengths = lengths.withColumns({"lost": F.greatest(F.lit(0), n - matched), "left": F.greatest(F.lit(0), F.col("size") - matched)})
    near = (F.col("lost") <= LOST) & (F.col("left") <= LOST) & (F.greatest("q_size", "size") <= LOST_SIZE)
    asked = lengths.filter(near).select("q", "q_size", "size", "lost", "left")
    wanted = asked.select("size", "left").distinct()
    remains = reduce(DataFrame.unionByName, (_remains(asked.filter(F.col("lost") == c), "q", "q_size", c).select("q", "size", "left", "rest") for c in range(LOST + 1)))
    named = known.select("k", F.col("k_size").alias("size"))
    named = reduce(DataFrame.unionByName, (_remains(named.join(F.broadcast(wanted.filter(F.col("left") == c)), "size"), "k", "size", c).select("k", "size", "left", "rest") for c in range(LOST + 1)))
    close = remains.join(_dealt(named), ["size", "left", "rest"]).select("q", "k")

    far = lengths.filter(~near).groupBy("q").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    low, high, every = F.col("low"), F.col("high"), floored.drop("low", "high")
    floored = every.join(far, "q").withColumns({"runs": F.ceil((n + low) * (1.5 * floor - 1) - 1 - tiny).cast("int"), "off": F.floor((n + high) * (1 - floor) + tiny).cast("int")})

    placed = known.select("k", F.col("k_size").alias("size"), F.explode(placed_grams(F.col("k"), 2)).alias("g")).select("k", "size", "g.gram", "g.place")
    rare = _rarest(floored, (2,), placed.groupBy("gram").agg(F.count(F.lit(1)).alias("names")))
    floored = floored.withColumn("shared", F.least("runs", F.lit(SHARED)))
    sought = floored.filter("runs >= 1").join(rare, "q").select("q", "low", "high", "off", "shared", F.explode(F.slice("grams", 1, F.greatest(F.lit(1), n - 1 - F.col("runs") + F.col("shared")))).alias("g")).filter("g.names > 0")
    sought = sought.select("q", "low", "high", "off", "shared", "g.gram", F.col("g.place").alias("at")).withColumn("band", F.explode(F.sequence(F.floor((F.col("at") - F.col("off")) / PLACES), F.floor((F.col("at") + F.col("off")) / PLACES))))
    shared = sought.join(_dealt(placed.withColumn("band", F.floor(F.col("place") / PLACES))), ["gram", "band"]).filter((F.abs(F.col("at") - F.col("place")) <= F.col("off")) & F.col("size").between(F.col("low"), F.col("high")))
    lengths = floored.filter("runs < 1").select("q", F.explode(F.sequence("low", F.greatest("low", "high"))).alias("size"))
    shared = shared.groupBy("q", "k", "shared").agg(F.countDistinct("at").alias("found")).filter("found >= shared")
    pairs = close.unionByName(shared.select("q", "k")).unionByName(lengths.join(known.select("k", F.col("k_size").alias("size")), "size").select("q", "k")).distinct()
    met = pairs.join(every, "q").join(known, "k").withColumn("bound", _bound())
    may = (F.col("bound") > floor) | (F.col("bound") == floor) & (F.col("held").isNull() | (F.col("position") < F.col("held")))
    return met.filter(may).select("q", "k", "name", "position")


def similar_companies(queries: DataFrame, names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """queries (query), names (name, position) -> (query, name, score): the most similar name, the earliest of equals.

    Both sides are reduced to distinct keys. Equal keys meet in a hash join and need no more. Each other key is first
    compared with one promising name; its score rules out, by exact bounds in Spark's own expressions, nearly all
    others, and only what is left is compared. No pair that could win is left out, whatever the names are.
    """
    if not 2 / 3 <= threshold <= 1:
        raise ValueError("bounds hold for thresholds from 2/3 to 1")
    path = work_dir(queries.sparkSession, "similar")
    asked = written(queries.select("query").distinct().withColumn("q", company_key(F.col("query"))), f"{path}/asked")
    known = names.select("name", "position", company_key(F.col("name")).alias("k"))
    known = known.groupBy("k").agg(F.min_by("name", "position").alias("name"), F.min("position").alias("position"))
    known = written(_features(known, "k", "k"), f"{path}/known")
    keys = asked.select("q").distinct()
    same = keys.join(known, keys["q"] == known["k"]).select("q", "name", F.lit(1.0).alias("score"))
    open_keys = written(_features(keys.join(same, "q", "left_anti"), "q", "q"), f"{path}/open")
    first = written(first_partners(open_keys, known, threshold), f"{path}/first")
    rivals = rival_pairs(open_keys, known, first, threshold).withColumn("score", block_ratio("q", "k")).filter(F.col("score") >= threshold)
    found = first.unionByName(rivals.select("q", "score", "position", "name"))
    best = found.groupBy("q").agg(F.min_by("name", F.struct(-F.col("score"), "position")).alias("name"), F.max("score").alias("score"))
    return asked.join(same.unionByName(best), "q").select("query", "name", "score")


def pac_sponsors(pacs: DataFrame, names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """pacs (committee, connected_org) -> (committee, name, score); committees without an organisation have no sponsor."""
    asked = pacs.filter(has_sponsor(F.col("connected_org"))).withColumnRenamed("connected_org", "query")
    return asked.join(similar_companies(asked, names, threshold), "query").select("committee", "name", "score")


def scored_candidates(hits: DataFrame) -> DataFrame:
    """hits (brand, source, position, label, alias, id) with score and rank: the better of label and alias; source, then position, breaks ties."""
    by_label = block_ratio(company_key(F.col("brand")), company_key(F.coalesce("label", F.lit(""))))
    by_alias = F.when(F.col("alias").isNotNull(), block_ratio(company_key(F.col("brand")), company_key(F.coalesce("alias", F.lit("")))))
    scored = hits.withColumn("score", F.when(F.coalesce("label", F.lit("")) == "", 0.0).otherwise(F.greatest(by_label, F.coalesce(by_alias, F.lit(0.0)))))
    order = Window.partitionBy("brand").orderBy(F.desc("score"), "source", "position")
    return scored.withColumn("rank", F.row_number().over(order))


def brand_matches(hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored_candidates(hits).filter((F.col("rank") == 1) & (F.col("score") >= threshold))


def brand_waterfall(brands: DataFrame, hits: DataFrame, cache: DataFrame, budget: int = 20, threshold: float = THRESHOLD) -> DataFrame:
    """(brand, id, source): cached answers (null ones too), then source 1, then source 2 for as many brands as the budget allows.

    Only brands for which source 2 has hits use the budget up, in order of position.
    """
    asked = brands.join(cache.select("brand"), "brand", "left_anti")
    first = brand_matches(hits.filter("source = 1"), threshold).join(asked.select("brand"), "brand", "left_semi")
    left = asked.join(first.select("brand"), "brand", "left_anti")
    second = hits.filter("source = 2").join(left, "brand", "left_semi")
    spent = left.join(second.select("brand").distinct(), "brand", "left_semi").orderBy("position").limit(budget)
    second = brand_matches(second.join(spent.select("brand"), "brand", "left_semi"), threshold)
    found = first.unionByName(second).select("brand", "id", "source")
    none = asked.join(found.select("brand"), "brand", "left_anti").select("brand", F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("source"))
    return cache.select("brand", "id", "source").unionByName(found).unionByName(none)


def first_similar(corporations: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """corporations (name, qid) without a qid get that of the first hit (name, position, label, uri) that is similar enough."""
    asked = corporations.filter("qid is null or qid = ''").select("name")
    near = hits.join(asked, "name", "left_semi").filter(block_ratio(company_key(F.col("name")), company_key(F.coalesce("label", F.lit("")))) >= threshold)
    found = near.groupBy("name").agg(F.min_by("uri", "position").alias("uri"))
    return corporations.join(found, "name", "left").select("name", F.when(F.coalesce("qid", F.lit("")) == "", qid(F.col("uri"))).otherwise(F.col("qid")).alias("qid"))


def candidate_index(candidates: DataFrame, fold=fold_accents) -> DataFrame:
    """candidates (fec_id, name, state) -> (name_key, state, fec_id): the filed name, and each later given name with the last."""
    known = candidates.filter("coalesce(name, '') <> '' and coalesce(fec_id, '') <> ''").withColumn("state", F.coalesce("state", F.lit("")))
    main = known.select(filed_name(F.col("name"), fold).alias("name_key"), "state", "fec_id")
    more = known.select(F.explode(other_filed_names(F.col("name"))).alias("name_key"), "state", "fec_id")
    return main.unionAll(more).distinct()


def _beginnings(key: Column, proper: bool) -> Column:
    """The beginnings of a name, the empty one too; proper: without the whole name."""
    return F.transform(F.sequence(F.lit(0), F.length(key) - int(proper)), lambda n: F.substring(key, 1, n))


def alike_given(asked: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, given), people (keys, given), distinct -> (keys, given, near, one): how many of the people's names begin
    the asked one or begin with it, and the first of them.

    Beginnings make both an equality: a name meets its own beginnings among the people, and one row for each beginning of
    the people's names, counted before. So no list of a last name's people is made, and no two of them meet.
    """
    longer = people.select(*keys, "given", F.explode(_beginnings(F.col("given"), True)).alias("begins")).groupBy(*keys, "begins").agg(F.count(F.lit(1)).alias("n"), F.min("given").alias("one"))
    longer = asked.join(longer.withColumnRenamed("begins", "given"), [*keys, "given"]).select(*keys, "given", "n", "one")
    shorter = asked.filter(F.length("given") > 0).select(*keys, "given", F.explode(_beginnings(F.col("given"), True)).alias("one"))
    shorter = shorter.unionByName(asked.select(*keys, "given", F.col("given").alias("one"))).join(people.withColumnRenamed("given", "one"), [*keys, "one"]).select(*keys, "given", F.lit(1).alias("n"), "one")
    return longer.unionByName(shorter).groupBy(*keys, "given").agg(F.sum("n").alias("near"), F.min("one").alias("one"))


def resolved_ratings(ratings: DataFrame, index: DataFrame, fold=fold_accents, parties: DataFrame | None = None) -> DataFrame:
    """ratings (rating_id, candidate_name, state) -> (rating_id, fec_id, provisional, outcome).

    One id with the exact name and state is taken; several leave the rating out. With none, last name and state decide:
    no such name makes a provisional candidate; one name is taken with all its ids; of several names, those whose given
    name begins the other (or the other way round) are left: none is provisional, one is taken, several leave it out.

    parties (fec_id, party), off by default: of several such names those with a candidate of the rating's party (its
    first letter) are preferred; if there is none, nothing changes.
    """
    party = F.substr("party", F.lit(1), F.lit(1)) if parties is not None else F.lit(None).cast("string")
    index = index.join(parties.select("fec_id", party.alias("party")), "fec_id", "left") if parties is not None else index.withColumn("party", party)
    asked = ratings.select(party.alias("party"), "rating_id", "candidate_name", F.upper(F.coalesce("state", F.lit(""))).alias("state"), printed_name(F.col("candidate_name"), fold).alias("key"))
    exact = index.groupBy(F.col("name_key").alias("key"), "state").agg(F.countDistinct("fec_id").alias("ids"), F.min("fec_id").alias("fec_id"))
    asked = asked.join(exact, ["key", "state"], "left")
    hit = asked.filter("ids = 1").select("rating_id", "fec_id", F.lit(False).alias("provisional"), F.lit("exact").alias("outcome"))

    parts, words, place = F.split("name_key", " "), F.split("key", " "), ["last", "state"]
    by_last = index.filter(F.size(parts) == 2).select(parts[1].alias("last"), parts[0].alias("given"), "state", "fec_id", "party")
    people = by_last.select(*place, "given").distinct()
    rest = asked.filter("ids is null").drop("ids", "fec_id").withColumns({"last": F.element_at(words, -1), "given": F.regexp_replace("key", " [^ ]+$", "")})
    rest = rest.join(people.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("given").alias("only")), place, "left")
    rest = rest.join(alike_given(rest.filter("n > 1").select(*place, "given").distinct(), people, place), [*place, "given"], "left")
    if parties is not None:
        keyed = [*place, "party"]
        same = alike_given(rest.filter("near > 1 and party is not null").select(*keyed, "given").distinct(), by_last.filter("party is not null").select(*keyed, "given").distinct(), keyed)
        rest = rest.join(same.select(*keyed, "given", F.col("near").alias("same"), F.col("one").alias("same_one")), [*keyed, "given"], "left")
        preferred = (F.col("near") > 1) & (F.col("same") > 0)
        rest = rest.withColumns({"one": F.when(preferred, F.col("same_one")).otherwise(F.col("one")), "near": F.when(preferred, F.col("same")).otherwise(F.col("near"))})
    taken = rest.withColumn("taken", F.when(F.col("n") == 1, F.col("only")).when(F.col("near") == 1, F.col("one"))).filter("taken is not null")
    ids = by_last.select(*place, F.col("given").alias("taken"), "fec_id").distinct()
    by_name = taken.join(ids, [*place, "taken"]).select("rating_id", "fec_id", F.lit(False).alias("provisional"), F.lit("last_name").alias("outcome"))
    new = rest.filter(F.col("n").isNull() | ((F.col("n") > 1) & F.col("near").isNull()))
    made = new.select("rating_id", provisional_id(F.col("candidate_name"), F.col("state")).alias("fec_id"), F.lit(True).alias("provisional"), F.lit("provisional").alias("outcome"))
    return hit.unionByName(by_name).unionByName(made)

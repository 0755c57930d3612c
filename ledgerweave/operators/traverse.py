"""Ownership trails: bounded walks up the ownership edges, one row for each distinct walk."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.plans.scratch import work_dir, written

#: Hops of a trail for scores and money trails, and for the graph view.
SCORE_HOPS, VIEW_HOPS = 10, 5
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def trails(roots: DataFrame, edges: DataFrame, hops: int = SCORE_HOPS) -> DataFrame:
    """roots (brand, corp), edges (child, parent) -> (brand, corp, depth).

    An edge may be walked once in a trail, so cycles end; two ways to one corporation are two rows. Repeated roots and
    repeated edges are taken once. Each level is one join with the edges, which AQE broadcasts when they are small.
    The session's limit on the rows of a recursion is lifted for good, since it is read when the result is.
    """
    edges = edges.select("child", "parent").distinct()
    kind = edges.schema["child"].dataType.simpleString()  # corporations may be numbers or names
    at = roots.select("brand", "corp").distinct().withColumns({"depth": F.lit(0), "walked": F.array().cast(f"array<struct<a: {kind}, b: {kind}>>")})
    spark, tag = roots.sparkSession, uuid4().hex
    names = start, steps = f"_lw_roots_{tag}", f"_lw_edges_{tag}"
    at.createOrReplaceTempView(start)
    edges.createOrReplaceTempView(steps)
    # trails may be many; the hops bound them. The limit is read when the plan is optimised, so it stays with the session.
    if spark.conf.get(_ROW_LIMIT, None) != "-1":
        spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return spark.sql(f"""
            WITH RECURSIVE walk (brand, corp, depth, walked) AS (
              SELECT brand, cast(corp AS {kind}), depth, walked FROM {start}
              UNION ALL
              SELECT w.brand, cast(e.parent AS {kind}), w.depth + 1, array_append(w.walked, named_struct('a', cast(e.child AS {kind}), 'b', cast(e.parent AS {kind})))
              FROM walk w JOIN {steps} e ON w.corp = e.child
              WHERE w.depth < {int(hops)} AND NOT array_contains(w.walked, named_struct('a', cast(e.child AS {kind}), 'b', cast(e.parent AS {kind}))))
            SELECT brand, corp, depth FROM walk""")
    finally:  # the views are resolved into the plan by now
        for name in names:
            spark.catalog.dropTempView(name)


def _joined(first: DataFrame, then: DataFrame) -> DataFrame:
    """(child, parent, n): how many walks go through first, then through then."""
    then = then.select(F.col("child").alias("mid"), F.col("parent").alias("top"), F.col("n").alias("m"))
    return first.join(then, F.col("parent") == F.col("mid")).groupBy("child", F.col("top").alias("parent")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))


def _powers(edges: DataFrame, hops: int) -> list[DataFrame]:
    """(child, parent, n) of the walks of exactly 1, 2, 4, ... edges, as far as hops needs them."""
    found = [edges.select("child", "parent").distinct().withColumn("n", F.lit(1).cast("long"))]
    while 2 ** len(found) <= hops:
        found.append(_joined(found[-1], found[-1]))
    return found


def never_returns(edges: DataFrame, hops: int = SCORE_HOPS) -> bool:
    """True if no walk has 2^k edges, the first such number beyond hops: then there is no cycle. Deep graphs count as cyclic."""
    last = _powers(edges, hops)[-1].select("child", "parent")
    return last.join(last.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").isEmpty()


def composed_counts(roots: DataFrame, edges: DataFrame, hops: int = SCORE_HOPS) -> DataFrame:
    """(brand, corp, trails) on a graph without cycles, without listing trails.

    Walks are counted, and the counts of 1, 2, 4, ... edges are composed, so that ten hops take six joins of the
    counts and three of the edges, all in one plan. A corporation is one row for a brand, however many trails lead to it.
    """
    powers = _powers(edges, hops)

    def moved(counts: DataFrame, by: DataFrame) -> DataFrame:
        return counts.join(by, F.col("corp") == F.col("child")).groupBy("brand", F.col("parent").alias("corp")).agg(F.sum(F.col("trails") * F.col("n")).alias("trails"))

    start, parts, left = roots.select("brand", "corp").distinct().withColumn("trails", F.lit(1).cast("long")), [], hops + 1
    for k in reversed(range(len(powers) + 1)):
        size = 2**k  # walks of 0 to size - 1 edges behind what start holds
        if size > left:
            continue
        block = start
        for power in powers[:k]:
            block = block.unionByName(moved(block, power)).groupBy("brand", "corp").agg(F.sum("trails").alias("trails"))
        parts.append(block)
        left -= size
        if left:
            start = moved(start, powers[k])
    return reduce(DataFrame.unionByName, parts).groupBy("brand", "corp").agg(F.sum("trails").alias("trails"))


def trail_counts(roots: DataFrame, edges: DataFrame, hops: int = SCORE_HOPS) -> DataFrame:
    """(brand, corp, trails): how many trails lead from a brand to a corporation, by listing them: right with cycles too."""
    return trails(roots, edges, hops).groupBy("brand", "corp").agg(F.count(F.lit(1)).alias("trails"))


def acyclic_trail_counts(roots: DataFrame, edges: DataFrame, hops: int = SCORE_HOPS) -> DataFrame:
    """The same for graphs with many diamonds, where trails are too many to list: composed counts if no walk returns, else listed."""
    return composed_counts(roots, edges, hops) if never_returns(edges, hops) else trail_counts(roots, edges, hops)


# --- counts on graphs with cycles -----------------------------------------------------------------------------------


def _core(edges: DataFrame, path: str) -> DataFrame:
    """Edges between corporations that are both owned and owners of others, again and again: nothing is left without a cycle."""
    number, left = 0, edges.count()
    while left:
        owners, owned = edges.select(F.col("child").alias("parent")).distinct(), edges.select(F.col("parent").alias("child")).distinct()
        kept = written(edges.join(owners, "parent", "left_semi").join(owned, "child", "left_semi").select("child", "parent"), f"{path}/core{number}")
        number, before, left = number + 1, left, kept.count()
        edges = kept
        if left == before:
            break
    return edges


def components(edges: DataFrame, path: str | None = None) -> DataFrame:
    """(corp, component) of the corporations on cycles: strongly connected components by forward-backward colouring.

    What lies on no path between cycles is trimmed first. Then every corporation takes the greatest number or name that
    leads to it, as its colour; those that keep their own are roots, and what leads to a root within its colour is its
    component. Components go, and the rest is trimmed and coloured again. Each round is a join and an aggregation over
    edge tables; rounds follow the longest way through the cycles, not the number of trails.
    """
    spark = edges.sparkSession
    path = path or work_dir(spark, "components")
    core, found, number = _core(edges.select("child", "parent").distinct(), f"{path}/0"), [], 0
    while not core.isEmpty():
        number += 1
        nodes = core.select(F.explode(F.array("child", "parent")).alias("corp")).distinct()
        colour, turn, open_ = nodes.withColumn("colour", F.col("corp")), 0, True
        while open_:
            came = core.join(colour.select(F.col("corp").alias("child"), "colour"), "child").select(F.col("parent").alias("corp"), "colour", F.lit(False).alias("own"))
            both = colour.select("corp", "colour", F.lit(True).alias("own")).unionByName(came)
            new = both.groupBy("corp").agg(F.max("colour").alias("colour"), F.max(F.when(F.col("own"), F.col("colour"))).alias("before"))
            new = written(new, f"{path}/{number}/colour{turn}")
            colour, turn, open_ = new.select("corp", "colour"), turn + 1, not new.filter("colour <> before").isEmpty()
        ends = core.join(colour.select(F.col("corp").alias("child"), "colour"), "child").join(colour.select(F.col("corp").alias("parent"), F.col("colour").alias("above")), "parent").filter("colour = above").select("child", "parent")
        ends = written(ends, f"{path}/{number}/within")
        member, turn, size = colour.filter("corp = colour"), 0, -1
        while (n := member.count()) != size:
            back = ends.join(member.select(F.col("corp").alias("parent"), "colour"), "parent").select(F.col("child").alias("corp"), "colour")
            member, size, turn = written(member.unionByName(back).distinct(), f"{path}/{number}/member{turn}"), n, turn + 1
        found.append(member.select("corp", F.col("colour").alias("component")))
        gone = member.select("corp")
        core = core.join(gone.withColumnRenamed("corp", "child"), "child", "left_anti").join(gone.withColumnRenamed("corp", "parent"), "parent", "left_anti")
        core = _core(written(core.select("child", "parent"), f"{path}/{number}/rest"), f"{path}/{number}")
    kind = edges.schema["child"].dataType.simpleString()
    all_ = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"corp {kind}, component {kind}")
    # a component of one corporation has no cycle but an edge to itself
    sizes = all_.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    loops = edges.filter("child = parent").select(F.col("child").alias("corp")).distinct().withColumn("loop", F.lit(True))
    return all_.join(sizes, "component").join(loops, "corp", "left").filter("n > 1 or loop").select("corp", "component")


def labelled(edges: DataFrame, path: str | None = None) -> DataFrame:
    """(child, parent, inner): inner edges join corporations of one component. To be stored with the edges, once for each load."""
    edges = edges.select("child", "parent").distinct()
    parts = components(edges, path)
    below, above = (parts.select(F.col("corp").alias(end), F.col("component").alias(f"{end}_part")) for end in ("child", "parent"))
    return edges.join(below, "child", "left").join(above, "parent", "left").select("child", "parent", F.coalesce(F.col("child_part") == F.col("parent_part"), F.lit(False)).alias("inner"))


#: Hops that one job walks before the counts are written.
STRIDE = 5


def counted_trails(roots: DataFrame, graph: DataFrame, hops: int = SCORE_HOPS) -> DataFrame:
    """roots (brand, corp), graph (child, parent, inner) -> (brand, corp, trails), right with cycles and without listing trails.

    A trail is a chain of visits to components, joined by edges between them. Only an inner edge can be walked twice,
    and only within one visit, so visits are counted apart: trails inside components are listed, by where they enter,
    and everything else is one count for each brand, corporation and hop, however many trails lead there.
    """
    spark, path = roots.sparkSession, work_dir(roots.sparkSession, "trails")
    outer, inner = graph.filter("not inner").select("child", "parent"), graph.filter("inner").select("child", "parent")
    cyclic = not inner.isEmpty()
    start = roots.select("brand", "corp").distinct().withColumn("n", F.lit(1).cast("long"))
    if cyclic:
        entries = inner.select(F.explode(F.array("child", "parent")).alias("corp")).distinct()
        visits = trails(entries.select(F.col("corp").alias("brand"), "corp"), inner, hops).groupBy(F.col("brand").alias("entry"), "corp", F.col("depth").alias("length")).agg(F.count(F.lit(1)).alias("ways"))
        visits = written(visits, f"{path}/visits")

    def moved(at: DataFrame) -> DataFrame:
        return at.join(outer, F.col("corp") == F.col("child")).groupBy("brand", F.col("parent").alias("corp")).agg(F.sum("n").alias("n"))

    arrived, hop = written(start, f"{path}/arrived/hop=0"), 0
    while hop < hops:
        if not cyclic:
            steps = []
            for _ in range(min(STRIDE, hops - hop)):
                arrived, hop = moved(arrived), hop + 1
                steps.append(arrived.withColumn("hop", F.lit(hop)))
            reduce(DataFrame.unionByName, steps).write.mode("append").partitionBy("hop").parquet(f"{path}/arrived")
        else:
            arrived = moved(_staying(spark, path, arrived.schema, visits, hop))
            hop += 1
            arrived.write.parquet(f"{path}/arrived/hop={hop}")
        arrived = spark.read.schema(f"{_ddl(start)}, hop int").parquet(f"{path}/arrived").filter(F.col("hop") == hop).drop("hop")
        if not cyclic and hop < hops and arrived.isEmpty():
            break
    if not cyclic:
        rows = spark.read.schema(f"{_ddl(start)}, hop int").parquet(f"{path}/arrived")
    else:
        rows = reduce(DataFrame.unionByName, (_staying(spark, path, start.schema, visits, h) for h in range(hops + 1)))
    return rows.groupBy("brand", "corp").agg(F.sum("n").alias("trails"))


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def _staying(spark, path: str, schema, visits: DataFrame, hop: int) -> DataFrame:
    """(brand, corp, n): trails of exactly hop edges, by where they stand: arrived earlier and gone on within the component, or just arrived."""
    arrived = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema.fields)}, hop int").parquet(f"{path}/arrived").filter(F.col("hop") <= hop)
    within = arrived.withColumnRenamed("corp", "entry").join(visits, "entry").filter(F.col("hop") + F.col("length") == hop).select("brand", "corp", (F.col("n") * F.col("ways")).alias("n"))
    alone = arrived.filter(F.col("hop") == hop).join(visits.select(F.col("entry").alias("corp")).distinct(), "corp", "left_anti").select("brand", "corp", "n")
    return within.unionByName(alone).groupBy("brand", "corp").agg(F.sum("n").alias("n"))

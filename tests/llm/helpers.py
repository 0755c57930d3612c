"""Small document tables for the tests."""

import re

from pyspark.sql import functions as F

#: A document table's columns and some that operators use themselves.
CLASH = ("marks", "kept", "row", "n", "key", "score", "label", "sequence_id", "fp", "media", "place")


def documents(spark, texts, ids=None, clash=True):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def python_workers(df):
    """The most Python steps that stand in one stage of df: a task runs a worker for each at the same time."""
    most, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        found = re.match(r"[ :+-]*(?:\*\(\d+\) )?(\w+)", line)
        depth = found.start(1) if found else 0
        while above and above[-1][0] >= depth:
            above.pop()
        n = 0 if found and "Exchange" in found[1] else (above[-1][1] if above else 0) + bool(found and found[1] == "MapInArrow")
        above.append((depth, n))
        most = max(most, n)
    return most


#: Nulls, empty and odd texts, ties, a repeated text and a long one.
ODD = [None, "", " ", "\n\n", "a", "The same text, twice.", "The same text, twice.", "naïve café – ½ 中文   x", "x" * 5000, "word " * 3000, "it's 'quoted' don't", "a\tb  c\r\nd"]

"""Scorecard files: sectioned CSV, plain CSV and JSON, all as (org_name, year, issue, candidate_name, state, score, party)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions.names import NO_SCORE, NO_SCORE_CSV, party_letter, score_value, strip

RATING = "org_name string, year int, issue string, candidate_name string, state string, score double, party string"

# States and territories.
STATES = """
Alabama AL|Alaska AK|Arizona AZ|Arkansas AR|California CA|Colorado CO|Connecticut CT|Delaware DE|Florida FL|Georgia GA|Hawaii HI|Idaho ID
Illinois IL|Indiana IN|Iowa IA|Kansas KS|Kentucky KY|Louisiana LA|Maine ME|Maryland MD|Massachusetts MA|Michigan MI|Minnesota MN|Mississippi MS
Missouri MO|Montana MT|Nebraska NE|Nevada NV|New Hampshire NH|New Jersey NJ|New Mexico NM|New York NY|North Carolina NC|North Dakota ND|Ohio OH
Oklahoma OK|Oregon OR|Pennsylvania PA|Rhode Island RI|South Carolina SC|South Dakota SD|Tennessee TN|Texas TX|Utah UT|Vermont VT|Virginia VA
Washington WA|West Virginia WV|Wisconsin WI|Wyoming WY|District of Columbia DC|American Samoa AS|Guam GU|Northern Mariana Islands MP
Puerto Rico PR|Virgin Islands VI
"""


def state_code(name: Column) -> Column:
    pairs = [cell.rpartition(" ")[::2] for line in STATES.strip().splitlines() for cell in line.split("|")]
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs for x in pair)), name)


def _cell(cells: Column, i: int) -> Column:
    return strip(F.coalesce(F.get(cells, F.lit(i)), F.lit("")))


#: Positions of a range that one task carries the state through.
STRETCH = 1 << 16


def carried_state(rows: DataFrame, position: str, marker: str, stretch: int = STRETCH) -> DataFrame:
    """rows with the state that the nearest marker line above gives; 'Senate' and 'House' clear it.

    Each range of ``stretch`` positions by itself; what is carried into it comes from one row for each range before.
    """
    mark = F.when(F.col(marker).isin("Senate", "House"), F.lit("")).otherwise(state_code(F.col(marker)))
    marked = rows.withColumns({"_mark": mark, "_range": F.floor(F.col(position) / stretch)})
    ranges = marked.groupBy(F.col("_range").alias("_next")).agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct(F.col(position)))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_next").rowsBetween(Window.unboundedPreceding, -1))
    last = F.last("_mark", ignorenulls=True).over(Window.partitionBy("_range").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marked.withColumn("_mark", last).join(ranges.select("_next", before.alias("_before")), F.col("_range").eqNullSafe(F.col("_next")), "left")
    return found.withColumn("state", F.nullif(F.coalesce("_mark", "_before"), F.lit(""))).drop("_mark", "_range", "_next", "_before")


def sectioned(lines: DataFrame, org: str, year: int, issue: str) -> DataFrame:
    """lines (position, value) of a file with sections for chambers and states."""
    cells = F.from_csv(F.regexp_replace("value", "^\\ufeff", ""), ", ".join(f"c{i} string" for i in range(12)))
    parsed = lines.select("position", F.array(*(cells[f"c{i}"] for i in range(12))).alias("cells"), F.size(F.split("value", ",")).alias("width"))
    single = F.when(_cell(F.col("cells"), 0).isNotNull() & (F.array_join(F.slice("cells", 2, 11), "") == ""), _cell(F.col("cells"), 0))
    rows = carried_state(parsed.withColumn("marker", single), "position", "marker")
    first, last, party, score = (_cell(F.col("cells"), i) for i in (0, 1, 2, 4))
    rows = rows.select(
        "marker", "width", F.lit(org).alias("org_name"), F.lit(year).alias("year"), F.lit(issue).alias("issue"), strip(F.concat(first, F.lit(" "), last)).alias("candidate_name"), "state",
        score_value(score).alias("score"), party_letter(party).alias("party"), first.alias("first"), score.alias("raw"),
    )
    rows = rows.filter(F.col("marker").isNull() & (F.col("width") >= 7) & (F.col("first") != "First Name") & (F.col("candidate_name") != "") & F.col("state").isNotNull())
    return rows.filter(~F.col("raw").isin(*NO_SCORE_CSV) & F.col("score").isNotNull()).select("org_name", "year", "issue", "candidate_name", "state", "score", "party")


def plain_csv(rows: DataFrame, org: str, year: int, issue: str) -> DataFrame:
    """A CSV with a header; without the year's score column there is no rating."""
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    column = f"{year} Score"
    if column not in rows.columns:
        return rows.sparkSession.createDataFrame([], RATING)
    raw = strip(F.coalesce(F.col(f"`{column}`"), F.lit("")))
    out = rows.select(F.lit(org).alias("org_name"), F.lit(year).alias("year"), F.lit(issue).alias("issue"), strip(F.coalesce("Member", F.lit(""))).alias("candidate_name"), strip(F.coalesce("State", F.lit(""))).alias("state"), score_value(raw).alias("score"), party_letter(F.coalesce("Party", F.lit(""))).alias("party"), raw.alias("raw"))
    return out.filter(~F.col("raw").isin(*NO_SCORE_CSV) & F.col("score").isNotNull() & (F.col("candidate_name") != "") & (F.col("state") != "")).drop("raw")


JSON_SCHEMA = "org_name string, year int, issue string, ratings array<struct<candidate_name: string, state: string, score: string>>"


def json_ratings(files: DataFrame, org: str, year: int, issue: str) -> DataFrame:
    """files: rows of JSON_SCHEMA. The file's year and issue win over the given ones; scores are numbers or grades."""
    rows = files.select(F.lit(org).alias("org_name"), F.coalesce("year", F.lit(year)).alias("year"), F.coalesce("issue", F.lit(issue)).alias("issue"), F.explode("ratings").alias("r"))
    name, state, raw = (strip(F.coalesce(F.col(f"r.{c}"), F.lit(""))) for c in ("candidate_name", "state", "score"))
    out = rows.select("org_name", "year", "issue", name.alias("candidate_name"), state.alias("state"), score_value(raw).alias("score"), F.lit(None).cast("string").alias("party"), raw.alias("raw"))
    return out.filter(~F.col("raw").isin(*NO_SCORE) & F.col("score").isNotNull() & (F.col("candidate_name") != "") & (F.col("state") != "")).drop("raw")


def read_json_scorecard(spark: SparkSession, folder: str, org: str, year: int, issue: str) -> DataFrame:
    """{org in snake case}_{year}.json; a missing or broken file has no rating."""
    path = Path(folder) / f"{'_'.join(''.join(c if c.isalnum() else ' ' for c in org.lower()).split())}_{year}.json"
    if not path.exists():
        return spark.createDataFrame([], RATING)
    return json_ratings(spark.read.schema(JSON_SCHEMA).json(str(path), multiLine=True), org, year, issue)


def read_csv_scorecard(spark: SparkSession, folder: str, org: str, year: int, issue: str) -> DataFrame:
    """The newest sectioned file of the year, else the plain one, else nothing."""
    newest = sorted(Path(folder).glob(f"moc-listing-{year}-*.csv"))
    if newest:
        lines = spark.read.text(str(newest[-1])).coalesce(1).withColumn("position", F.monotonically_increasing_id())
        return sectioned(lines, org, year, issue)
    plain = Path(folder) / f"lcv_{year}.csv"
    return plain_csv(spark.read.csv(str(plain), header=True), org, year, issue) if plain.exists() else spark.createDataFrame([], RATING)


Reader = Callable[[SparkSession, int], DataFrame]


def all_scorecards(spark: SparkSession, years: Iterable[int], readers: Iterable[Reader]) -> DataFrame:
    """Every registered reader's ratings of every year."""
    out = spark.createDataFrame([], RATING)
    for reader in readers:
        for year in years:
            out = out.unionByName(reader(spark, year))
    return out

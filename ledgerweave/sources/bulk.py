"""Pipe-delimited bulk files without a header, latin-1, every column a string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the four files, in order.
COMMITTEES = "committee_id committee_name treasurer_name street1 street2 city state zip designation type party filing_frequency interest_group_category connected_org_name candidate_id".split()
CANDIDATES = "candidate_id candidate_name party election_year office_state office office_district incumbent_challenger_status candidate_status principal_committee_id street1 street2 city state zip".split()
CONTRIBUTIONS = """committee_id amendment_indicator report_type primary_general image_number transaction_type entity_type contributor_name
city state zip employer occupation transaction_date transaction_amount other_id candidate_id transaction_id file_number memo_code memo_text sub_id""".split()
LINKAGES = "cand_id cand_election_yr fec_election_yr cmte_id cmte_tp cmte_dsgn linkage_id".split()

_BAD = "_lw_line"


def read_bulk(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows with at least as many fields as there are columns; further fields are cut off, shorter rows left out.

    The reader marks lines of another width; of these the fields are counted again, outside quotes. Empty fields
    are '' and never null.
    """
    schema = ", ".join(f"`{c}` string" for c in [*columns, _BAD])
    rows = spark.read.csv(path, schema=schema, sep="|", encoding="ISO-8859-1", quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD)
    # a field in quotes may hold the delimiter: it is counted without its quoted part
    fields = F.size(F.split(F.regexp_replace(F.col(_BAD), r'(?<=^|\|)"(?:[^"]|"")*"', ""), r"\|"))
    # the reader refuses queries of the marks alone, such as a count, so the filter reads a field too
    read = F.coalesce(F.length(columns[0]), F.lit(0)) >= 0
    kept = rows.filter(F.when(F.col(_BAD).isNull(), read).otherwise(fields >= len(columns)))
    return kept.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def split_lines(lines: DataFrame, column: str, columns: list[str]) -> DataFrame:
    """The same rule for lines that are already a column; quotes have no meaning here."""
    cells = F.split(column, r"\|", -1)
    return lines.filter(F.size(cells) >= len(columns)).select(*(cells[i].alias(c) for i, c in enumerate(columns)))


def committees(spark: SparkSession, path: str) -> DataFrame:
    return read_bulk(spark, path, COMMITTEES)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_bulk(spark, path, CANDIDATES)


def contributions(spark: SparkSession, path: str, cycle: int) -> DataFrame:
    """With the cycle, and the date as a date besides the text it came as."""
    rows = read_bulk(spark, path, CONTRIBUTIONS)
    return rows.withColumns({"cycle": F.lit(cycle), "date": day("transaction_date")})


def linkages(spark: SparkSession, path: str) -> DataFrame:
    return read_bulk(spark, path, LINKAGES)


def day(column: str) -> Column:
    """MMDDYYYY as a date, null if it is none."""
    return F.try_to_timestamp(column, F.lit("MMddyyyy")).cast("date")

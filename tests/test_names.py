"""Names of companies, people and brands; scores; similarity."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import names
from ledgerweave.functions.similarity import block_ratio, lengths_allow, similarity


def apply(spark, function, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in rows.select("k", function(F.col("v")).alias("x")).orderBy("k").collect()]


COMPANY = {
    "Acme Holdings Corp.": "acme", "Procter-Gamble Co.": "procter-gamble", "  Some   Company  ": "some", "Acme Corp Holdings": "acme corp", "Nestlé Café!": "nestlé café",
    "AT&T Inc": "att", "Group": "", "Corp. of X, LLC": "corp of x", "Enterprises": "", "Incline": "incline", None: None,
}


def test_company_key(spark):
    assert apply(spark, names.company_key, COMPANY) == list(COMPANY.values())


FILED = {
    "KENNEDY, ROBERT F JR": "robert f kennedy", "BYRD, ROBERT C SR": "robert c byrd", "SMITH": "smith", "GRIFFITH, H MORGAN": "morgan griffith", "BONAMICI, SUZANNE MS.": "suzanne bonamici",
    "LÓPEZ, ÁNGEL": "angel lopez", "DOE, JR": "doe", "DOE,": "doe", " Plain Name ": "plain name", "X, A": "a x", "DE LA CRUZ, MONICA": "monica de la cruz",
}


def test_filed_name(spark):
    assert apply(spark, names.filed_name, FILED) == list(FILED.values())


def test_other_filed_names(spark):
    got = apply(spark, names.other_filed_names, ["CRUZ, RAFAEL EDWARD TED", "SMITH", "SMITH, JOHN Q", "SMITH, JOHN PAUL JR", "SMITH, JR"])
    assert got == [["edward cruz", "ted cruz"], [], [], ["paul smith"], []]


def test_small_functions(spark):
    assert apply(spark, names.printed_name, ["  José  PÉREZ "]) == ["jose perez"]
    assert apply(spark, lambda c: names.provisional_id(c, F.lit("CA")), ["Alex Padilla", "...O'Neil, J."]) == ["PROV_CA_ALEX_PADILLA", "PROV_CA_O_NEIL_J"]
    assert apply(spark, names.slug, ["Under Armour"]) == ["under-armour"]
    assert apply(spark, names.brand_text, ["Visit the  Nike Store", "Brand: Sony", "brand:LG", "Bose", "Store"]) == ["Nike", "Sony", "LG", "Bose", "Store"]
    assert apply(spark, names.qid, ["http://www.example.org/entity/Q42", "Q7"]) == ["Q42", "Q7"]
    assert apply(spark, names.score_value, ["A+", " B+ ", "F", "73.5", "5d", "x", "", None, "-3"]) == [100.0, 85.0, 0.0, 73.5, None, None, None, None, -3.0]
    assert apply(spark, names.score_class, ["70", "69.9", "40", "39", None]) == ["high", "mid", "mid", "low", None]
    assert apply(spark, names.party_letter, [" democratic", "", "R"]) == ["D", None, "R"]


@pytest.mark.parametrize("a,b", [("tide", "diet"), ("diet", "tide"), ("", ""), ("", "x"), ("Advanced Micro Devices", "AMD"), ("x" * 300 + "ab", "ab" + "x" * 250), ("Acme Inc", "ACME Corp.")])
def test_similarity_is_the_standard_one(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(block_ratio("a", "b").alias("raw"), similarity(F.col("a"), F.col("b")).alias("key"), lengths_allow(F.col("a"), F.col("b")).alias("may")).first()
    ratio = SequenceMatcher(None, a, b).ratio()
    assert row["raw"] == ratio and (row["may"] or ratio < 0.7)

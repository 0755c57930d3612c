"""Column functions for names of companies, people and brands, and for scores. All but the accent fold stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Company suffixes, taken off the end in this order, each once.
COMPANY_SUFFIXES = (
    r"\binc\.?$", r"\bllc\.?$", r"\bcorp\.?$", r"\bcorporation$", r"\bco\.?$", r"\bcompany$",
    r"\bltd\.?$", r"\blimited$", r"\bplc$", r"\bgroup$", r"\bholdings?$", r"\benterprise[s]?$",
)

# Tokens that follow or precede a person's given names.
PERSON_SUFFIXES = "JR SR II III IV MR MR. MS MS. DR DR. HON HON. THE".split()

# Letter grades.
GRADES = {"A+": 100.0, "A": 95.0, "A-": 90.0, "B+": 85.0, "B": 75.0, "B-": 70.0, "C+": 65.0, "C": 50.0, "C-": 45.0, "D+": 35.0, "D": 25.0, "D-": 20.0, "F": 0.0}

# Cells that mean there is no score; CSV files have two more.
NO_SCORE = ("", "-", "N/A", "n/v", "NV")
NO_SCORE_CSV = (*NO_SCORE, "na", "NA")

# Occupations that count as senior executives, found anywhere in the text.
EXECUTIVE_TITLES = (
    "ceo", "cfo", "coo", "cto", "president", "chairman", "chairwoman", "vice president", "vp", "chief executive",
    "chief financial", "chief operating", "chief technology", "director", "executive", "managing director", "partner", "founder", "owner",
)


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def company_key(name: Column) -> Column:
    """The form of a company name that is compared: lower case, no suffixes, no punctuation but hyphens."""
    out = F.lower(strip(name))
    for suffix in COMPANY_SUFFIXES:
        out = strip(F.regexp_replace(out, f"(?U){suffix}", ""))
    out = F.regexp_replace(out, r"(?U)[^\w\s-]", "")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def without_accents(text: pd.Series) -> pd.Series:
    """Letters without combining marks; no built-in function decomposes."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))


def fold_accents(text: Column) -> Column:
    return without_accents(text)


def plain(text: Column) -> Column:
    """For names known to be ASCII: nothing to fold."""
    return text


def _given_tokens(name: Column) -> Column:
    """Tokens behind the comma, without those of PERSON_SUFFIXES at the end."""
    rest = strip(F.regexp_replace(name, "(?s)^[^,]*,", ""))
    tokens = F.filter(F.split(rest, r"(?U)\s+"), lambda t: t != "")
    ends = F.transform(tokens, lambda t: F.upper(t).isin(*PERSON_SUFFIXES))
    last = F.aggregate(F.transform(ends, lambda e, i: F.when(~e, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(tokens, F.lit(1), last)


def _is_initial(token: Column) -> Column:
    return token.rlike(r"^[A-Za-z]\.?$")


def last_name(name: Column) -> Column:
    return strip(F.lower(F.regexp_extract(name, "(?s)^([^,]*)", 1)))


def filed_name(name: Column, fold=fold_accents) -> Column:
    """'LAST, FIRST MIDDLE JR' as 'first middle last'; without a comma, the name in lower case."""
    tokens = _given_tokens(name)
    given = F.when((F.size(tokens) >= 2) & _is_initial(tokens[0]), F.slice(tokens, F.lit(2), F.size(tokens))).otherwise(tokens)
    last = F.regexp_extract(name, "(?s)^([^,]*)", 1)
    whole = strip(F.lower(fold(F.concat(F.array_join(given, " "), F.lit(" "), last))))
    return F.when(~F.contains(name, F.lit(",")), strip(F.lower(name))).when(F.size(tokens) == 0, last_name(name)).otherwise(whole)


def other_filed_names(name: Column) -> Column:
    """'given last' for each given name but the first; initials are no given names."""
    given = F.transform(F.filter(_given_tokens(name), lambda t: ~_is_initial(t)), lambda t: F.lower(t))
    rest = F.when(F.size(given) > 1, F.slice(given, F.lit(2), F.greatest(F.size(given) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.contains(name, F.lit(",")), F.transform(rest, lambda t: F.concat(t, F.lit(" "), last_name(name)))).otherwise(F.array().cast("array<string>"))


def printed_name(name: Column, fold=fold_accents) -> Column:
    """A scorecard's 'First Last': folded, lower case, single spaces."""
    return strip(F.regexp_replace(F.lower(fold(name)), r"(?U)\s+", " "))


def provisional_id(name: Column, state: Column) -> Column:
    slug = F.upper(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    return F.concat(F.lit("PROV_"), state, F.lit("_"), slug)


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def brand_text(text: Column) -> Column:
    """A shop page's brand line without 'Visit the ... Store' and 'Brand:'."""
    out = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^Visit the\s+", ""), r"(?i)\s+Store$", "")
    return F.regexp_replace(out, r"(?i)^Brand:\s*", "")


def qid(uri: Column) -> Column:
    return F.substring_index(uri, "/", -1)


def score_value(raw: Column) -> Column:
    """A letter grade or a number as 0 to 100; null for anything else."""
    cell = strip(raw)
    grades = F.create_map(*(F.lit(x) for pair in GRADES.items() for x in pair))
    number = F.when(cell.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), cell.try_cast("double"))
    return F.coalesce(F.try_element_at(grades, cell), number)


def amount(raw: Column) -> Column:
    """A number, or null where the text is none."""
    return F.when(strip(raw).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), strip(raw).try_cast("double"))


def score_class(score: Column) -> Column:
    score = score.cast("double")
    return F.when(score >= 70, "high").when(score >= 40, "mid").when(score.isNotNull(), "low")


def party_letter(party: Column) -> Column:
    return F.nullif(F.substr(F.upper(F.trim(party)), F.lit(1), F.lit(1)), F.lit(""))

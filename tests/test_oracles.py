"""Every query with SQL gives what DuckDB gives."""

import decimal

import duckdb
import pytest

from ledgerweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: round(float(x), 6) if isinstance(x, float | decimal.Decimal) else x
    return sorted(([value(r[k]) for k in order] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df, want = catalogue.QUERIES[name](spark, sf_dir), duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from strataspark.plans import catalogue, catalogue_files, catalogue_more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _flat(df):
    cols = sorted(df.columns)
    return df[cols].map(lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = _flat(catalogue.QUERIES[name](spark, SF).toPandas())
    want = _flat(duck.execute(catalogue.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0

"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from tarnlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    return None if value is None or value != value else value


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_small, name):
    got = catalog.queries()[name](spark, sf_small).toPandas()
    assert rows(got) == rows(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_small, name):
    assert catalog.queries()[name](spark, sf_small).columns


def test_entry_is_registered():
    import __spark_entry__

    assert "reading_trend_summary" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

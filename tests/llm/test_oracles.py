"""Every query with SQL gives the rows that DuckDB gives; the others run over the whole table."""

import duckdb
import pytest
from tests.test_oracles import TABLES, rows

from tarnlake.llm.queries import oracle_sql, queries

#: Numbers with nulls, which the two sides hand to pandas as different types.
NULLABLE = {"parent_conv_id", "form_n"}


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, sf_small, name):
    whole = lambda df: df.astype({c: "Int64" for c in NULLABLE & {*df.columns}}).fillna(dict.fromkeys(NULLABLE & {*df.columns}, -99))
    assert rows(whole(queries()[name](spark, sf_small).toPandas())) == rows(whole(duck.execute(oracle_sql()[name]).df()))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_covers_the_table(spark, sf_small, name):
    got = queries()[name](spark, sf_small)
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in got.select("doc_id").collect()} == ids


def test_names():
    import __spark_entry__

    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in __spark_entry__.queries()

"""Every registered query with SQL gives the same rows as that SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(name, spark, duck, sf_dir):
    rows = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(rows.columns)
    found = [tuple(r[c] for c in columns) for r in rows.collect()]
    sql = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in at) for r in sql.fetchall()]
    order = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(found, key=order) == sorted(expected, key=order)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "context"]

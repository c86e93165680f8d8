"""Queries of the subpackage that SQL can express, in DuckDB."""

import duckdb
import pytest

from karstmap.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall()) and sorted(df.columns) == sorted(names)

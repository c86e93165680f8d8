"""Every query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from karstmap import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    got = plain(df.collect(), df.columns)
    assert got[1]
    if name in queries.SQL:
        cursor = sql.execute(queries.SQL[name])
        assert got == plain(cursor.fetchall(), [d[0] for d in cursor.description])

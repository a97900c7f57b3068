"""Every query against its SQL on the smallest tables; the others for rows."""

import duckdb
import pytest

from rampart.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The smallest tables have no secret in documents.
EMPTY = {"secret_scan_documents"}


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    got = rows(df.collect(), df.columns)
    assert got or name in EMPTY
    if name in ORACLES:
        found = sql.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(found.columns)
        assert got == rows(found.fetchall(), list(found.columns))


def test_entry(spark, data):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

"""Every query against its SQL, over the small tables."""

import math

import duckdb
import pytest

from tamis.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "documents", "labels", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    assert [TYPES[dict(df.dtypes)[n]] for n in names] == [str(dict(zip(sql.columns, sql.types))[n]) for n in names]
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    want = sorted(tuple(plain(r[sql.columns.index(n)]) for n in names) for r in sql.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_select_within_the_pool(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows
    if "id" in rows[0].asDict():
        ids = [r["id"] for r in rows]
        assert len(set(ids)) == len(ids) and all(i % 5 for i in ids)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())

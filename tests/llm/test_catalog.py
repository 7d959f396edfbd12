"""The text queries against their SQL, over whole small tables."""

import duckdb
import pytest

from tamis.llm.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for name_of in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {name_of} AS SELECT * FROM '{SMALL}/{name_of}.parquet'")
    df, sql = QUERIES[name](spark, SMALL), con.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(rounded(r[n]) for n in names) for r in df.collect()), key=str)
    want = sorted((tuple(rounded(r[sql.columns.index(n)]) for n in names) for r in sql.fetchall()), key=str)
    assert got == want


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}

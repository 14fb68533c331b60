"""The queries that SQL can express against their SQL."""

import os

import duckdb
import pytest

from conftest import DATA
from loomstead.llm import queries

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=key)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=key)
    assert got == want

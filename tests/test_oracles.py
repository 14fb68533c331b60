"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from conftest import DATA
from loomstead import plans

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "" if value != value else round(value, 5)
    if hasattr(value, "__len__") and not isinstance(value, str):
        return [plain(v) for v in value]
    return "" if value is None else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, want.fetchall())
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if any(x != pytest.approx(y, abs=2e-5) if isinstance(x, float) and isinstance(y, float) else str(x) != str(y) for x, y in zip(a, b, strict=True))]
    assert not bad[:3]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0

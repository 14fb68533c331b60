"""op9 draws what its SQL draws however many ranges its order is cut into."""

import os

import duckdb
import pytest

from conftest import DATA
from loomstead.llm import queries, ranking
from loomstead.llm.staging import Stage

SF = f"{DATA}/sf0.01"
NAME = "op9_systematic_mix"


@pytest.fixture
def cut(spark):
    """Sets the number of ranges, and keeps small ones apart."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]

    def to(n):
        spark.conf.set(names[0], n)
        spark.conf.set(names[1], "false")

    yield to
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("ranges", [1, 40])
def test_op9_order_is_the_same_in_ranges(spark, cut, ranges):
    cut(ranges)
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    found = con.execute(queries.ORACLES[NAME])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[NAME](spark, SF).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("ranges", [1, 3, 25])
def test_positions_follow_the_order(spark, cut, ranges):
    cut(ranges)
    rows = [("a" if i % 3 else None, i * 37 % 10, None if i % 11 == 0 else i * 101 % 400, 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, size long, id long, _range int")
    out = ranking.positions(df, "g", ["size", "id"], Stage(spark, "test")).collect()
    assert len(out) == len(rows) and {r._range for r in out} == {5}
    for g in ("a", None):
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        order = [(r.size, -1 if r.id is None else r.id) for r in mine]
        assert order == sorted(order)

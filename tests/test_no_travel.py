"""What is made of a row stays with the row: no wide row is shuffled, no condition is written out below what it is computed from."""

from pyspark.sql import functions as F

from loomstead.functions.text import kept
from loomstead.operators import examples as ex, generators as gen, preference

TOOL = ("t{}", "Does a thing", [("size", "integer", True, None), ("flag", "string", True, ["A", "N"])])


def _tool(i):
    return (TOOL[0].format(i), *TOOL[1:])


def _rows(spark, n=20):
    answer = ("tool_call", [("t0", [("size", "3"), ("flag", '"A"')])], "")
    rows = [(i, [_tool(0), _tool(1)], "do it", answer, None, {"source": "x"}) for i in range(n)]
    return spark.createDataFrame(rows, ex.LAYOUT)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_stay_in_their_rows(spark):
    made = preference.pairs(_rows(spark))
    assert "Exchange" not in _plan(made)
    got = made.collect()
    assert len(got) == 20 and all(r.chosen != r.rejected for r in got)
    # A dropped argument or a swapped tool; the nearer one is taken where both were drawn.
    assert {r.rejected for r in got} <= {
        '{"action":"call","calls":[{"arguments":{"size":3},"name":"t0"}]}', '{"action":"call","calls":[{"arguments":{"flag":"A"},"name":"t0"}]}', '{"action":"call","calls":[{"arguments":{"flag":"A","size":3},"name":"t1"}]}',
    }


def test_a_small_pool_comes_to_the_rows(spark, monkeypatch):
    pool = spark.createDataFrame([(i, _tool(i)) for i in range(5)], f"k bigint, tool {ex.TOOL}")
    picks = [F.lit(3), F.when(F.col("ex_id") % 2 == 0, F.lit(1)), F.lit(3), F.lit(9)]
    rows = _rows(spark).select("ex_id")

    def names():
        return {r.ex_id: r.n for r in gen.with_drawn(rows, pool, picks, "_tools").select("ex_id", ex.names(F.col("_tools")).alias("n")).collect()}

    small = gen.with_drawn(rows, pool, picks, "_tools")
    assert "Exchange hashpartitioning" not in _plan(small)
    here = names()
    assert here == {i: ["t3", "t1"] if i % 2 == 0 else ["t3"] for i in range(20)}
    monkeypatch.setattr(gen, "BROADCAST_ROWS", 2)
    assert names() == here


def test_conditions_stay_above_what_they_need(spark):
    rows = _rows(spark).select("ex_id").withColumn("a", F.transform(F.array("ex_id", "ex_id"), lambda x: x + 1)).withColumn("b", F.array_max("a") + F.array_min("a"))
    plan = _plan(kept(rows, F.col("b") > 10))
    assert not any("Filter" in line and "array_max" in line for line in plan.splitlines())
    assert sorted(r.ex_id for r in kept(rows, F.col("b") > 10).collect()) == list(range(5, 20))


def test_quoted(spark):
    texts = ["plain", 'a"b', "a\\b", "é", "\n", "x\n", "", " ~", "/", None, "\x7f"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ex.quoted(F.col("t")).alias("q"), F.to_json(F.array("t")).alias("j")).collect()
    assert all(r.q == r.j[1:-1] for r in got)

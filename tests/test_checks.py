"""Schema checks and verdicts as columns against the functions that loop over rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomstead.functions import parsing
from loomstead.operators import checks, examples as ex

VALUES = ["x", "X ", " a  b. ", "12", "1e3", "true", "", 1, 2.0, 2.5, -3, 10**20, True, False, None, [1, 2], ["a"], [], {"y": 1}, {}, "é", "1.", "a"]
KINDS = ["string", "integer", "number", "boolean", "null", "array", "object", "date"]


def drawn_schema(rng, depth=0):
    kind = rng.choice(KINDS)
    out = {"type": [kind, "null"] if rng.random() < 0.1 else kind} if rng.random() < 0.9 else {}
    if rng.random() < 0.2:
        out["enum"] = ["x", "12", "a"] if rng.random() < 0.8 else [1, "x"]
    if rng.random() < 0.3:
        out[rng.choice(["minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"])] = rng.choice([1, 2, 2.5])
    if rng.random() < 0.2:
        out[rng.choice(["minLength", "maxLength", "minItems", "maxItems"])] = rng.choice([1, 2])
    if rng.random() < 0.1:
        out["items"] = {"type": rng.choice(["integer", "string"])} if rng.random() < 0.7 else {"type": "integer", "minimum": 2}
    if rng.random() < 0.05:
        out["pattern"] = "^x"
    if depth < 2 and rng.random() < 0.3:
        out |= {"type": "object", "properties": {k: drawn_schema(rng, depth + 1) for k in rng.sample(["y", "z", "a b"], 2)}, "required": rng.sample(["y", "z", "q"], 1)}
        if rng.random() < 0.4:
            out["additionalProperties"] = rng.choice([False, True, {"type": "string"}])
    return out


def drawn_value(rng, depth=0):
    return {k: drawn_value(rng, depth + 1) for k in rng.sample(["y", "z", "a b", "w"], rng.randint(0, 3))} if depth < 3 and rng.random() < 0.2 else rng.choice(VALUES)


def test_compiled_schemas_agree_with_the_function(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        names = ["p", "q", "r"]
        tools = [{"name": n, "parameters": {"type": "object", "properties": {k: drawn_schema(rng) for k in rng.sample(names, 2)}, "required": rng.sample(names, rng.randint(0, 2))}} for n in ("f", "g", "f")][: rng.randint(0, 3)]
        arguments = json.dumps({k: drawn_value(rng) for k in rng.sample(names, rng.randint(0, 3))})
        rows.append((i, json.dumps(tools), rng.choice(["f", "f", "g", "h", "", None]), arguments if rng.random() < 0.95 else rng.choice(["[1]", "no", None, '{"p":1,"p":2}'])))
    got = {r.id: r.fits for r in checks.checked_calls(spark.createDataFrame(rows, "id long, tools string, name string, arguments string")).collect()}
    want = {i: not parsing.call_errors({"name": n, "arguments": a}, json.loads(t)) for i, t, n, a in rows}
    assert got == want and 50 < sum(want.values()) < len(rows) - 50
    plans = [checks._plan(t["parameters"]) is not None for _, ts, _, _ in rows for t in json.loads(ts)]
    assert sum(plans) > len(plans) / 2  # most schemas don't need the function


def typed_rows(spark, n=800):
    rng = random.Random(5)
    prop = lambda k: (k, rng.choice(KINDS), rng.random() < 0.4, rng.choice([None, None, ["x", "a", "12"]]))
    text = lambda v: json.dumps(v, ensure_ascii=False)
    rows = []
    for i in range(n):
        tools = [(f"t{j}", "", [prop(k) for k in rng.sample(["p", "q", "r"], 2)]) for j in range(rng.randint(1, 3))]
        acceptable = rng.random() < 0.1
        value = lambda: {"_acceptable": ["x", 1]} if acceptable else rng.choice(VALUES[:17] if rng.random() < 0.8 else VALUES)
        calls = [(rng.choice(tools)[0], [(k, text(value())) for k in rng.sample(["p", "q", "r"], rng.randint(0, 2))]) for _ in range(rng.randint(0, 3))]
        kind = rng.choice(["tool_call", "tool_call", "refuse", "clarify"])
        said = [{"name": c, "arguments": {k: json.loads(v) for k, v in a}} for c, a in calls]
        rng.shuffle(said)
        if said and rng.random() < 0.3:
            said[0]["arguments"] = {k: rng.choice([v, str(v), f" {v} ", v]) for k, v in said[0]["arguments"].items()}
        if said and rng.random() < 0.2:
            said[0] = rng.choice([{"name": "t0"}, {"arguments": {}}, 5, {"name": "zz", "arguments": {}}, {"name": "t0", "arguments": "[]"}, {"name": "t0", "arguments": None}])
        action = {"tool_call": "call"}.get(kind, kind) if rng.random() < 0.8 else rng.choice(["call", "refuse", "other", None])
        output = rng.choice(["{}", "```json\n{}\n``` done {{x", "<think>{{1}}</think>{}", "say {}"]).format(text({"action": action, "calls": said})) if rng.random() < 0.9 else rng.choice(["none", "{", None, "[1]"])
        rows.append((i, tools, "q", (kind, calls if kind == "tool_call" else [], "c"), None, {}, output))
    return spark.createDataFrame(rows, ex.LAYOUT + ", output string")


@pytest.mark.parametrize("forgiving", [True, False])
def test_verdicts_agree_with_the_function(spark, forgiving):
    rows = typed_rows(spark)
    got = {r.ex_id: r.v for r in checks.judged(rows, "output", forgiving).collect()}
    told = rows.select("ex_id", ex.answer_json(F.col("answer")).alias("a"), ex.tools_json(F.col("tools")).alias("t"), "output").collect()
    right = 0
    for r in told:
        v = got[r.ex_id]
        assert tuple(v) == tuple(parsing.judged(json.loads(r.a), json.loads(r.t), r.output, forgiving).values()), r
        right += v.correct
    assert 50 < right < 700


def test_strict_and_forgiving_differ(spark):
    tools = [("f", "", [("p", "string", True, None)])]
    rows = spark.createDataFrame([(1, tools, "q", ("tool_call", [("f", [("p", '"New York"')])], ""), None, {}, '{"action":"call","calls":[{"name":"f","arguments":{"p":" new york. "}}]}')], ex.LAYOUT + ", output string")
    assert [checks.judged(rows, "output", k).first().v.correct for k in (True, False)] == [True, False]


def test_typed_answers_agree_with_the_function(spark):
    rows = typed_rows(spark)
    got = {r.ex_id: r.ok for r in rows.select("ex_id", ex.valid(rows).alias("ok")).collect()}
    for r in rows.select("ex_id", ex.answer_json(F.col("answer")).alias("a"), ex.tools_json(F.col("tools")).alias("t")).collect():
        assert got[r.ex_id] == (not parsing.answer_errors(json.loads(r.a), json.loads(r.t))), r
    plan = rows.select(ex.valid(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_failures_ask_the_parser_once(spark):
    """A filter on a verdict used to be pushed below it, and the function's workers were there twice."""
    from loomstead import plans

    plan = plans.QUERIES["error_breakdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_plain_texts_have_the_forms_of_parsed_ones(spark):
    """Whole numbers and plain texts are told from their text; spaced or escaped ones are parsed, and forms agree."""
    same = [("7", " 7"), ("-0", "0"), ("-12", "-12 "), ("999999999999999", " 999999999999999"), ('"abc"', ' "abc"'), ('"A b."', '"\\u0041 b."'), ('""', ' ""'), ('"12"', ' "12"'), ('"true"', ' "true"'), ('"é"', '"\\u00e9"')]
    rows = spark.createDataFrame(same, "a string, b string")
    for forgiving in (True, False):
        got = rows.select("a", checks.normal_form(F.col("a"), forgiving).alias("x"), checks.normal_form(F.col("b"), forgiving).alias("y")).collect()
        assert all(r.x == r.y and r.x is not None for r in got), got
    odd = spark.createDataFrame([("007",), ("7\n8",), ('"a"b"',), ("-",)], "a string").select(checks.normal_form(F.col("a"), True).alias("x")).collect()
    assert [r.x for r in odd] == ["j007", "n7.0", "sa", "j-"]  # no plain ones: as the parser has them

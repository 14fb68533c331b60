"""Operators that run a caller's functions."""

import json

import pandas as pd
from pyspark.sql import functions as F

from loomstead.operators import environments, injectable

TOOLS = [{"name": "f", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}}]


def test_outputs_and_judge(spark):
    df = spark.createDataFrame([(1, "rate me 8", 0.2), (2, "nothing", 0.3), (3, "99", 0.1)], "id long, prompt string, heuristic double")
    assert injectable.with_outputs(df, "prompt", lambda s: s.str.upper()).orderBy("id").first().output == "RATE ME 8"
    got = injectable.judge_scores(df, "prompt", lambda s: s, "heuristic").orderBy("id").collect()
    assert [(r.score, r.judged) for r in got] == [(0.8, True), (0.3, False), (1.0, True)]


def test_synthesis(spark):
    def write(prompts: pd.Series) -> pd.Series:
        row = lambda q, a: json.dumps({"query": q, "tools": TOOLS, "answer": {"type": "tool_call", "calls": [{"name": "f", "arguments": {"a": a}}]}})
        return prompts.map(lambda p: {"1": row("Do it", 1), "2": row("do  it!", 2), "3": row("Bad", "x"), "4": "junk"}.get(p, row(p, 5)))

    seeds = spark.createDataFrame([(str(i),) for i in range(1, 7)], "prompt string")
    got = injectable.synthesize(seeds, "prompt", write, lambda q: q.map(lambda t: "no" if t == "6" else "yes"))
    assert sorted((r.prompt, r.query) for r in got.collect()) == [("1", "Do it"), ("5", "5")]


def test_rollouts(spark):
    def policy(goal, seen):
        return {"done": {"action": "clarify"}, "bad": "text", "loop": {"action": "call", "calls": [{"n": 1}]}, "fail": {"action": "call", "calls": [{"n": -1}]}}[goal]

    def apply(state, call):
        return ({"n": state.get("n", 0) + call["n"]}, True, "ok") if call["n"] > 0 else (state, False, "bad")

    goals = spark.createDataFrame([(1, "done"), (2, "bad"), (3, "loop"), (4, "fail")], "id long, goal string")
    got = {r.id: (r.outcome, r.steps, r.retries, r.state) for r in injectable.rollouts(goals, policy, apply, 3).collect()}
    assert got == {1: ("clarify", 0, 0, "{}"), 2: ("parse_error", 0, 0, "{}"), 3: ("max_steps", 3, 0, '{"n": 3}'), 4: ("failed", 2, 2, "{}")}


def test_any_order(spark):
    call = "array<struct<name:string,item:string,quantity:bigint>>"
    rows = [([("add_item", "apples", 1), ("add_item", "mangoes", 2)],), ([("add_item", "apples", 1), ("remove_item", "apples", 1)],)]
    got = spark.createDataFrame(rows, f"c {call}").select(injectable.any_order(F.col("c"), environments.cart, ["items", "checked_out"], 2)).collect()
    assert [r[0] for r in got] == [True, False]


def test_small_ones(spark):
    spec = "struct<type:string,format:string,enum:array<string>>"
    rows = spark.createDataFrame([(("string", None, ["a", "b"]), 3), (("integer", None, []), 1), (("string", "date", []), 0), (("boolean", None, []), 0)], f"s {spec}, k int")
    assert [r[0] for r in rows.select(injectable.sample_value(F.col("s"), F.col("k"))).collect()] == ['"b"', "3", '"2024-01-15"', "true"]
    out = spark.createDataFrame([('{"action":"call","calls":[{"name":"f","arguments":{"a":1}}]}',), ('{"action":"refuse"}',), (None,)], "o string")
    assert [json.loads(r[0]) for r in out.select(injectable.evaluator_calls(F.col("o"))).collect()] == [[{"f": {"a": 1}}], [], []]
    cases = [("call", json.dumps({"type": "tool_call", "calls": [{"name": "f", "arguments": {"a": 1}}]}), '{"action":"call","calls":[{"name":"f","arguments":{"a":1}}]}'), ("refuse", '{"type":"refuse"}', '{"action":"call","calls":[]}')]
    got = injectable.probe(spark.createDataFrame([(k, a, json.dumps(TOOLS), o) for k, a, o in cases], "kind string, answer string, tools string, output string"))
    assert {r.kind: r.passed for r in got.collect()} == {"call": 1.0, "refuse": 0.0, None: 0.5}
    best = injectable.best_candidate(spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.4)], "g long, i long, s double"), "g", "s", "i")
    assert best.first().i == 0

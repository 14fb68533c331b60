"""Parsers, validators, matchers, the chart scorer, environments and statistics on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from loomstead.functions import parsing, rendering
from loomstead.operators import charts, environments, shaping, similarity, statistics

TOOLS = [
    {"name": "get_weather", "description": "", "parameters": {"type": "object", "properties": {"city": {"type": "string"}}, "required": ["city"]}},
    {"name": "set_timer", "description": "", "parameters": {"type": "object", "properties": {"seconds": {"type": "integer", "minimum": 1}}, "required": ["seconds"]}},
]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('```json\n{"action": "refuse"}\n```', {"action": "refuse"}), ('{"action": "call"} and so on', {"action": "call"}), ('<think>{"a":1}</think>{"b": 2}', {"b": 2}), ("<think>never closes {", None),
        ("no object", None), ('{"message": "a } b"}', None), (None, None), ('{"a": {"b": 1}}', {"a": {"b": 1}}),
    ],
)
def test_model_output(text, want):
    assert parsing.model_object(text) == want


def test_call_string():
    got = parsing.parse_call_string('[GetWeather(city="Oslo (NO)", days=2), Other(), Bad(x=foo)]')
    assert [(c["name"], json.loads(c["arguments"])) for c in got] == [("GetWeather", {"city": "Oslo (NO)", "days": 2}), ("Other", {}), ("Bad", {})]
    assert parsing.parse_call_string("no calls") == []


def test_tool_list():
    got = parsing.tool_list(json.dumps([{"function": {"name": "f", "parameters": {"type": "dict", "properties": {"a": {"type": "int"}, "b": {"type": "odd"}}}}}, {"description": "unnamed"}]))
    assert [t["name"] for t in got] == ["f"] and got[0]["parameters"]["properties"] == {"a": {"type": "integer"}, "b": {"type": "string"}} and got[0]["parameters"]["type"] == "object"
    assert parsing.standard_type(["null", "int"]) == "integer"


@pytest.mark.parametrize(
    ("call", "ok"),
    [
        ({"name": "get_weather", "arguments": {"city": "x"}}, True), ({"name": "get_weather", "arguments": {"city": "x", "day": 1}}, False), ({"name": "get_weather", "arguments": {}}, False),
        ({"name": "unknown", "arguments": {}}, False), ({"name": "set_timer", "arguments": {"seconds": 2.0}}, True), ({"name": "set_timer", "arguments": {"seconds": True}}, False),
        ({"name": "set_timer", "arguments": {"seconds": 0}}, False), ({"name": "set_timer", "arguments": '{"seconds": 5}'}, True), ({"name": "set_timer", "arguments": "[1]"}, False),
    ],
)
def test_validator(call, ok):
    assert (not parsing.call_errors(call, TOOLS)) == ok


def test_validator_keywords():
    schema = {"type": "object", "properties": {"a": {"enum": [1, 2]}, "b": {"pattern": "^x"}, "c": {"type": "array", "items": {"type": "integer"}, "maxItems": 2}, "d": {"const": 5}}}
    assert not parsing.schema_errors({"a": 1, "b": "xy", "c": [1], "d": 5}, schema)
    assert all(parsing.schema_errors(bad, schema) for bad in ({"a": 3}, {"b": "y"}, {"c": ["s"]}, {"c": [1, 2, 3]}, {"d": 4}))


def test_lenient_matching():
    assert parsing.arguments_match({"c": " New  York "}, {"c": "new york"}) and parsing.arguments_match({"n": "42"}, {"n": 42}) and not parsing.arguments_match({"a": 1}, {"b": 1})
    x = {"name": "f", "arguments": {"x": {"_acceptable": [1, 2]}}}
    y = {"name": "f", "arguments": {"x": 1}}
    one, two = {"name": "f", "arguments": {"x": 1}}, {"name": "f", "arguments": {"x": 2}}
    assert parsing.calls_match([one, two], [x, y]) and parsing.calls_match([two, one], [x, y])
    assert not parsing.calls_match([one, one], [x, {"name": "f", "arguments": {"x": {"_acceptable": [1, 3]}}}]) and not parsing.calls_match([one], [x, y])


def test_judge_and_columns(spark):
    gold = {"type": "tool_call", "calls": [{"name": "get_weather", "arguments": {"city": "Oslo"}}]}
    outputs = ['{"action":"call","calls":[{"name":"get_weather","arguments":{"city":"oslo"}}]}', '{"action":"refuse"}', "junk"]
    rows = spark.createDataFrame([(json.dumps(gold), json.dumps(TOOLS), o) for o in outputs] + [('{"type":"refuse"}', json.dumps(TOOLS), outputs[0])], "a string, t string, o string")
    got = rows.select(parsing.verdicts("a", "t", "o").alias("v")).select("v.*").collect()
    assert [r.correct for r in got] == [True, False, False, False] and [r.parsed_ok for r in got] == [True, True, False, True] and got[3].hallucinated_call
    assert [len(r[0]) for r in rows.select(parsing.validation_errors("a", "t")).collect()] == [0, 0, 0, 0]


def test_envelope(spark):
    kind = "type string, calls array<struct<name:string,arguments:string>>, content string"
    row = spark.createDataFrame([(("tool_call", [("f", '{"a":1}')], ""),), (("refuse", [], 'no "x"'),)], f"a struct<{kind.replace(' string', ':string').replace('calls array', 'calls:array')}>")
    got = [json.loads(r[0]) for r in row.select(parsing.envelope(F.col("a"))).collect()]
    assert got == [{"action": "call", "calls": [{"name": "f", "arguments": {"a": 1}}]}, {"action": "refuse", "message": 'no "x"'}]


SAME, OTHER = True, False


@pytest.mark.parametrize(
    ("gold", "answers"),
    [
        (2500, {"2,500": SAME, "$2.6K": SAME, "2.7k": OTHER, "2 500": SAME, "2.5 thousand": SAME, "(2500)": OTHER, "2500 km": OTHER, "2000-3000": OTHER, "2500; 2600": OTHER, "2500, 17": OTHER, "": OTHER, "None": OTHER}),
        (-7.5, {"(7.5)": SAME, "-7,5": SAME, "\u22127.5": SAME, "7.5": OTHER, "(7.5": OTHER}), (1234567.0, {"1.234.567": SAME, "12,34,567": SAME, "1.234.567,00": SAME, "1,234,567.": OTHER, "1.2M": SAME}),
        (0, {"0.0": SAME, "0.01": OTHER, "No": OTHER}), (0.25, {"25%": SAME, "26%": SAME, "0.25%": OTHER, "\u0966.\u0968\u096b": SAME}), (30, {"30%": OTHER, "31": SAME}),
        ("7-9", {"9 to 7": SAME, "7..9": SAME, "7 \u2013 9.2": SAME, "7": OTHER, "7 to 12": OTHER, "$7-$9": OTHER}), (True, {"YES!": SAME, "true": SAME, "no": OTHER, "1": OTHER, "maybe": OTHER}), ("no", {"False.": SAME, "y": OTHER}),
        ("North  Wing", {"north wing.": SAME, '"North Wing"': SAME, "south wing": OTHER}), ("None", {"None": SAME}),
    ],
)
def test_scalar_answers(gold, answers):
    assert {a: charts.relaxed_match(gold, a) for a in answers} == answers
    assert not charts.relaxed_match(gold, None)


def test_answers_of_other_kinds():
    trend = lambda gold, got: charts.relaxed_match(gold, got, "trend")
    assert trend("falling", "a downward slope") and trend("\u0935\u0943\u0926\u094d\u0927\u093f", "it grew") and not trend("falling", "rising") and not trend("purple", "purple") and not trend(None, None)
    assert charts.relaxed_match("12.5%", "12.5", "proportion") is False and charts.relaxed_match(12.5, "12.6%", "proportion")
    assert charts.relaxed_match(["oak", 3, "elm"], "Elm; oak, 3") and not charts.relaxed_match(["oak", "elm"], "oak") and not charts.relaxed_match(["oak", "oak"], "oak, elm")
    # 100 fits 96 and 104, 108 only 104: the first that fits would be taken away.
    assert charts.relaxed_match([100, 108], ["104", "96"])
    assert charts.relaxed_match(list(range(10, 90, 10)), list(range(80, 0, -10)))


def test_strict_answers():
    cases = {(True, " yes"): True, (4.0, "4"): True, (1.25, "1.2500"): False, (("a", 2.5), "A, 2.5"): True, ("x", None): False}
    assert {k: charts.strict_match(*k) for k in cases} == cases


def test_verdict_columns(spark):
    rows = [(json.dumps([1, "b"]), "b, 1", "", True, False, True), ("0.5", "50 %", "", True, False, True), ('"up"', "rising", "trend", True, False, True), ("3", " ", "", False, False, False), ("3", None, None, False, False, False)]
    df = spark.createDataFrame([r[:3] for r in rows], "g string, a string, k string")
    assert [tuple(r.v) for r in df.select(charts.verdicts("g", "a", "k").alias("v")).collect()] == [r[3:] for r in rows]


def test_cart_and_calendar(spark):
    call = "array<struct<name:string,item:string,quantity:bigint>>"
    runs = [[("add_item", "apples", 2), ("remove_item", "apples", 3), ("remove_item", "apples", 2), ("checkout", None, None)], [("add_item", "mangoes", 1), ("checkout", None, None), ("add_item", "apples", 1)]]
    got = spark.createDataFrame([(r,) for r in runs], f"c {call}").select(environments.cart(F.col("c")).alias("s")).collect()
    assert [r.s.reasons for r in got] == [["ok", "removing more than present", "ok", "cannot check out empty cart"], ["ok", "ok", "cart already checked out"]]
    assert got[0].s["items"] == [] and got[1].s.checked_out and got[1].s.applied == 2
    days = [[("create_event", "Demo", "Monday"), ("create_event", "Demo", "Friday"), ("move_event", "Demo", "Friday"), ("cancel_event", "Review", None)]]
    got = spark.createDataFrame([(r,) for r in days], "c array<struct<name:string,title:string,day:string>>").select(environments.calendar(F.col("c")).alias("s")).withColumn("d", environments.describe_calendar(F.col("s"))).first()
    assert got.s.reasons == ["ok", "event already exists", "ok", "no such event"] and got.d == "calendar: Demo on Friday"


def test_statistics(spark):
    one = spark.range(1)
    p = one.select(statistics.mcnemar(F.lit(0), F.lit(0)).alias("a"), statistics.mcnemar(F.lit(1), F.lit(9)).alias("b"), statistics.mcnemar(F.lit(2000), F.lit(2100)).alias("c"), statistics.pass_hat_k(F.lit(4), F.lit(2), 2).alias("d"), statistics.pass_hat_k(F.lit(1), F.lit(1), 2).alias("e")).first()
    assert p.a == 1 and p.b == pytest.approx(0.021484375) and 0.1 < p.c < 0.2 and p.d == pytest.approx(1 / 6) and p.e is None
    bits = spark.createDataFrame([("g", int(i < 80)) for i in range(100)], "g string, x int")
    ci = statistics.interval(statistics.resampled(bits, "g", ["x"], 100, "s"), "g", "x", 100).first()
    assert ci.lo < 0.8 < ci.hi


def test_keep_first_is_greedy(spark):
    nodes, edges = spark.range(1, 7), spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "i long, j long")
    assert {r.id: r.kept for r in similarity.keep_first(nodes, edges).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_splits(spark):
    got = {r.id: r.split for r in shaping.group_split(spark.range(103), "id").collect()}
    assert sorted(got) == list(range(103)) and [sum(v == s for v in got.values()) for s in ("train", "val", "test")] == [82, 10, 11]
    with pytest.raises(ValueError):
        shaping.slice_sizes(F.lit(1), {"a": 0.6, "b": 0.4})


def test_renderings(spark):
    tools = spark.createDataFrame([([("f", "does it", [("a", "string", True), ("b", "integer", False)])],)], f"t array<{rendering.TOOL}>")
    r = tools.select(rendering.compact(F.col("t")).alias("c"), rendering.python(F.col("t")).alias("p"), rendering.xml(F.col("t")).alias("x")).first()
    assert r.c == "f(a:string, b?:integer)" and r.p.startswith("def f(a: string, b: integer = None):") and '<param name="b" type="integer" required="false"/>' in r.x
    shown = spark.range(1).select(rendering.points(F.lit(0.123)).alias("a"), rendering.percent(F.lit(None).cast("double")).alias("b"), rendering.cell(F.lit(None).cast("double")).alias("c")).first()
    assert tuple(shown) == ("+12.3pp", "n/a", "__PENDING__")

"""Generators, twins, preferences, the build chain, rollouts, release checks and the command line on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from loomstead import build as builder, cli, release
from loomstead.functions import parsing
from loomstead.operators import examples as ex, generators as gen, preference, probes
from loomstead.operators.ordering import ordered
from loomstead.sources import readers, writers


def tool(name, required=(), optional=(), options=None, description=""):
    props = {p: {"type": "integer" if p.startswith("n_") else "string"} | ({"enum": options} if options and p == "mode" else {}) for p in (*required, *optional)}
    return {"name": name, "description": description, "parameters": {"type": "object", "properties": props, "required": list(required)}}


NAMES = ["paint_wall", "mow_lawn", "bake_bread", "tune_piano", "fix_bike", "feed_cat", "sweep_floor", "plant_tree"]


def raw(i):
    """Example i: a valid call of one tool, which is one of two on offer; every seventh call lacks its argument."""
    name, other = NAMES[i % 8], NAMES[(i + 3) % 8]
    tools = [tool(name, ("where",), ("n_times",), description=f"Will {name.replace('_', ' ')} for you."), tool(other, ("where", "mode"), options=["fast", "slow"], description=f"Will {other.replace('_', ' ')} for you.")]
    args = {} if i % 7 == 6 else {"where": f"place {i}", "n_times": i}
    return i, json.dumps(tools), f"Please {name.replace('_', ' ')} at place {i} in the evening of day {i}.", ("tool_call", [(name, json.dumps(args))], ""), None


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.createDataFrame([raw(i) for i in range(60)], f"ex_id long, {readers.EXAMPLE}")
    return ex.typed(table).cache()


@pytest.fixture(scope="module")
def pool(rows):
    return gen.pool_of(rows).cache()


def test_typed_rows_round_trip(rows):
    row = rows.select(ex.tools_json(F.col("tools")).alias("t"), ex.answer_json(F.col("answer")).alias("a"), ex.envelope(F.col("answer.type"), F.col("answer.calls"), F.col("answer.content")).alias("e"), ex.names(F.col("tools")).alias("n")).where("n[0] = 'mow_lawn'").orderBy("a").first()
    want = raw(1)
    assert json.loads(row.t)[0]["parameters"] == json.loads(want[1])[0]["parameters"] and row.n == ["mow_lawn", "fix_bike"]
    assert json.loads(row.e) == {"action": "call", "calls": [{"name": "mow_lawn", "arguments": {"where": "place 1", "n_times": 1}}]} and json.loads(row.a)["type"] == "tool_call"


def test_curation_and_guard(rows):
    kept = {r.ex_id for r in ex.curated(rows).select("ex_id").collect()}
    assert kept == {i for i in range(60) if i % 7 != 6}
    good, counts = ex.guarded(rows.withColumn("meta", F.create_map(F.lit("source"), F.lit("s"))))
    assert {r.ex_id for r in good.collect()} == kept and [tuple(r) for r in counts.select("kept", "dropped").collect()] == [(52, 8)]


def test_pool_has_each_name_once(pool):
    got = pool.orderBy("k").collect()
    assert [r.tool.name for r in got] == sorted(NAMES) and [r.k for r in got] == list(range(8))


def words(text):
    return {w for w in "".join(c if c.isascii() and c.isalpha() else " " for c in text.lower()).split() if len(w) > 3 and w not in ex.TOPICLESS}


def test_no_tool_leaves_out_what_is_needed(rows, pool):
    got = gen.no_tool(rows, pool, 8).collect()
    assert len(got) > 50
    for r in got:
        names = [t.name for t in r.tools]
        assert 2 <= len(names) <= 4 and len(set(names)) == len(names) and r.meta["removed_tool"] not in names and r.answer.type == "refuse" and all(f"`{n}`" in r.answer.content for n in names)


def test_off_domain_requests_share_no_topic(rows, pool):
    for r in gen.no_tool_off_domain(rows, pool, 8).collect():
        assert r.query in gen.OFF_DOMAIN and len(words(r.query) & set().union(*(words(f"{t.name} {t.description}") for t in r.tools))) < 2


def test_over_refusal_and_parallel(rows):
    text = {r.ex_id: r.query for r in rows.collect()}
    for r in gen.over_refusal(rows).collect():
        hedge = next(h for h in gen.HEDGES if r.query.startswith(h))
        assert r.query == hedge + text[r.ex_id][0].lower() + text[r.ex_id][1:] and r.meta["hn_kind"] == "over_refusal"
    got = gen.partial_parallel(rows).collect()
    assert got and all(len(r.answer.calls) == 2 and r.answer.calls[0].name != r.answer.calls[1].name and {c.name for c in r.answer.calls} <= {t.name for t in r.tools} for r in got)
    used = [i for r in got for i in (r.ex_id, int(r.meta["partner"]))]
    assert len(used) == len(set(used))


def test_questions_name_what_is_missing(rows, pool):
    for r in gen.missing_arg(rows, pool, 8).collect():
        assert r.answer.type == "clarify" and f"`{r.meta['dropped']}`" in r.answer.content and r.meta["dropped"] in [p.name for p in r.tools[0].props if p.required] and len(r.tools) <= 3
    for r in gen.ambiguous(rows, pool, 8).collect():
        assert len({t.name for t in r.tools}) == 2 and all(f"`{t.name}`" in r.answer.content for t in r.tools)


@pytest.mark.parametrize("n", [40])
def test_drivers_give_what_is_asked_for(spark, rows, pool, n):
    made = {
        "hn_kind": gen.hard_negatives(ex.curated(rows), pool, n, {"no_tool": 2, "over_refusal": 1, "partial_parallel": 1, "missing_arg": 1, "ambiguous": 1}),
        "mt_kind": gen.multi_turn(spark, pool, n, {"miss_param": 1, "miss_func": 1, "long_context": 1}), "sd_kind": gen.schema_drift(spark, pool, n, {"add_required": 1, "retype_enum": 1, "rename": 1}),
    }
    for kind, table in made.items():
        got = table.withColumn("ok", ex.valid(table)).collect()
        assert len(got) == n and all(r.ok for r in got) and len({r.meta[kind] for r in got}) >= 3
        assert all(r.history for r in got) is (kind == "mt_kind")


def test_renamed_property_moves_to_the_end(spark, pool):
    for r in gen.rename(spark.range(40).withColumnRenamed("id", "ex_id"), pool, 8).collect():
        names = [p.name for p in r.tools[0].props]
        assert names[-1] == r.meta["field"] and names[-1] in {a.name for a in r.answer.calls[0].args}


def test_twins_share_a_pair(rows):
    twins, sources = gen.format_twins(rows, 10)
    pair = {r.ex_id: r.meta.get("pair_id") for r in sources.collect()}
    got = twins.collect()
    assert len(got) == 20 and sum(p is not None for p in pair.values()) == 10 and len(pair) == 60
    assert all(pair[r.ex_id] == r.meta["pair_id"] and r.meta["doc_format"] in gen.FORMATS and r.meta["source"] == "format_twin" for r in got)
    again, _ = gen.format_twins(sources, 60)
    assert again.count() == 100
    hidden, marked = gen.masked_twins(rows, 7)
    got = hidden.collect()
    assert len(got) == 7 and all([t.name for t in r.tools] == ["func_0", "func_1"] and r.answer.calls[0].name == "func_0" and {a.name for a in r.answer.calls[0].args} == {"arg_0", "arg_1"} and "_" in r.query or r.tools[0].description for r in got)
    assert sum(r.meta.get("pair_id") is not None for r in marked.collect()) == 7


def test_multilingual_pairs(spark, rows):
    one = rows.where("ex_id < 4").select((F.col("ex_id") % 2).alias("number"), F.when(F.col("ex_id") < 2, "call").when(F.col("ex_id") == 2, "refuse").otherwise("clarify").alias("kind"), "tools", "answer", F.create_map(F.lit("en"), F.col("query"), F.lit("fi"), F.lit("sama")).alias("queries"))
    one = one.withColumn("number", F.when(F.col("kind") == "call", F.col("number")).otherwise(0))
    got = gen.multilingual(spark, one, 30).collect()
    assert len(got) == 30 and all(len({r.meta["lang"] for r in got if r.meta["pair_id"] == p}) == 2 for p in {r.meta["pair_id"] for r in got})


def test_preferences_are_wrong_and_near(rows):
    got = preference.pairs(rows).collect()
    assert len(got) == 60 and all(r.chosen != r.rejected for r in got)
    for r in got:
        a, b = (json.loads(x)["calls"][0] for x in (r.chosen, r.rejected))
        assert a["name"] != b["name"] or "where" not in b["arguments"]
    hedged = gen.over_refusal(rows)
    axis = preference.axis_pairs(hedged).collect()
    assert len(axis) == 60 and all(json.loads(r.rejected)["action"] == "refuse" for r in axis)
    assert preference.merged(preference.pairs(rows), preference.pairs(rows)).count() == 60


def test_provably_wrong(spark):
    calls = lambda *names: [(n, [("where", '"x"')]) for n in names]
    cases = [("tool_call", calls("a"), "call", calls("a"), False), ("tool_call", calls("a"), "call", calls("b"), True), ("tool_call", calls("a", "b"), "call", calls("a"), True), ("tool_call", calls("a"), "refuse", [], True), ("refuse", [], "call", calls("a"), True), ("refuse", [], "call", [], False), ("tool_call", calls("a"), "call", [("a", [])], True), ("tool_call", calls("a"), "call", [("a", [("where", '"y"')])], True)]
    tools = [("a", "", [("where", "string", True, None)]), ("b", "", [("where", "string", True, None)])]
    df = spark.createDataFrame([(i, tools, (k, g, ""), act, c) for i, (k, g, act, c, _) in enumerate(cases)], f"i int, t array<{ex.TOOL}>, a {ex.ANSWER}, act string, c array<{ex.CALL}>")
    got = {r.i: r.w for r in df.select("i", preference.provably_wrong(F.col("t"), F.col("a"), F.col("act"), F.col("c")).alias("w")).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_signature_and_groups(spark):
    metas = [{"hn_kind": "no_tool"}, {"source": "env"}, {"source": "multilingual", "lang": "hi"}, {"source": "x"}]
    got = spark.createDataFrame([(m,) for m in metas], "m map<string,string>").select(ex.group_of(F.col("m")).alias("g")).collect()
    assert [r.g for r in got] == ["no_tool", "env", "ml-hi", ""]


def test_build_chain(spark, rows, tmp_path):
    many = rows.withColumn("meta", F.create_map(F.lit("source"), F.lit("demo")))
    many = many.unionByName(many.where("ex_id < 5").withColumn("ex_id", F.col("ex_id") + 1000))  # copies
    asked = {raw(i)[2] for i in (1, 2, 3, 4, 8, 9, 10, 11)}
    probe = spark.createDataFrame(list(enumerate(sorted(asked))), "probe long, text string")
    built = builder.build(many, {"format_twin_sources": 5, "masked_twin_examples": 5, "novel_tool_frac": 0.2}, probe)
    got = built.rows.collect()
    assert {r.split for r in got} == {"train", "val", "test"} and len({r.ex_id for r in got}) == len(got) == built.stats["total"]
    assert not any(r.query in asked for r in got) and built.stats["valid"] == 57 and built.stats["contamination"]["after"] < built.stats["contamination"]["before"]
    by_pair = {}
    for r in got:
        if r.meta.get("pair_id"):
            by_pair.setdefault(r.meta["pair_id"], set()).add(r.split)
    assert by_pair and all(len(s) == 1 for s in by_pair.values())
    known, fresh = {t.name for r in got for t in r.tools if not t.name.startswith("func_")}, {t.name for r in built.novel.collect() for t in r.tools}
    assert not known & fresh
    assert all(r.ok for r in built.rows.withColumn("ok", ex.valid(built.rows)).select("ok").collect())
    builder.write(built, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} >= set(release.REQUIRED) | {"train_pc.jsonl", "pref.jsonl", "test_novel.jsonl"}
    assert spark.read.json(str(tmp_path / "out/train_pc.jsonl")).count() == sum(r.split == "train" for r in got)


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"seed": 7, "dataset": {"near_threshold": 0.5}}')
    got = builder.configured(str(tmp_path / "c.json"), target_positive=3, seed=None)
    assert (got["seed"], got["near_threshold"], got["target_positive"]) == (7, 0.5, 3)
    assert release.merged_parameters(release.PREFERENCE_TRAINING, {"beta": 1, "lora_r": 8}, {"lora_r": 4, "epochs": None}) == release.PREFERENCE_TRAINING | {"beta": 1.0, "lora_r": 4}


CALL = {"action": "call", "calls": [{"name": "add_item", "arguments": {"item": "apples", "quantity": 2}}]}


def test_probe_cases(spark):
    cases = probes.cases(spark)
    assert cases.count() == 18 and probes.score(cases.withColumn("output", F.col("gold"))).where("passed").count() == 18
    assert probes.score(cases.withColumn("output", F.lit('{"action":"refuse"}'))).where("passed").count() == 3
    assert cli.main(["probe", "--self-check"]) == 0


def test_release_checks(tmp_path):
    folder, card = tmp_path / "out", tmp_path / "CARD.md"
    folder.mkdir()
    card.write_text("value: __PENDING__\n<!--METRICS_START-->old<!--METRICS_END-->\nby YOUR_USERNAME")
    assert len(release.preflight(str(folder), [str(card)], str(tmp_path / "LICENSE"))) == 4 + 1 + 2 + 1
    for name in release.REQUIRED:
        (folder / name).write_text("x")
    (tmp_path / "LICENSE").write_text("free")
    card.write_text(release.fill(card.read_text(), release.metrics({"accuracy": 0.5, "se": 0.01}, {"accuracy": 0.75}), "me", 0.75))
    assert "| Overall accuracy | 0.500 ± 0.010 | 0.750 |" in card.read_text() and "value: 0.750" in card.read_text()
    kept = writers.manifest(str(folder), 1, {})
    assert release.preflight(str(folder), [str(card)], str(tmp_path / "LICENSE"), kept) == []
    (folder / "val.jsonl").write_text("y")
    assert release.preflight(str(folder), [str(card)], str(tmp_path / "LICENSE"), kept) == ["changed: val.jsonl"]
    assert release.radar({"a": {"x": 0.5, "y": 1, "z": 0}}).count("<polygon") == 5 and "| full | a, b | - | - | +3.5% |" in release.ablation([{"config": "full", "parts": ["a", "b"], "percent": 3.5}])


def test_command_line(spark, rows, tmp_path):
    data = tmp_path / "in"
    spark.createDataFrame([raw(i)[1:] for i in range(30)], readers.EXAMPLE).write.json(str(data))
    assert cli.main(["build", "--input", str(data), "--out", str(tmp_path / "built")]) == 0
    assert cli.main(["preference", "--input", str(tmp_path / "built/train.jsonl"), "--out", str(tmp_path / "pairs")]) == 0 and spark.read.json(str(tmp_path / "pairs")).count() > 0
    tools = json.dumps([tool("f", ("where",))])
    gold = json.dumps({"type": "tool_call", "calls": [{"name": "f", "arguments": {"where": "x"}}]})
    said = ['{"action":"call","calls":[{"name":"f","arguments":{"where":"x"}}]}', "nothing"]
    for name, outputs in (("one", said), ("two", said[:1] * 2)):
        spark.createDataFrame([(i, "c", "en" if i else "fi", "p", gold, tools, o) for i, o in enumerate(outputs)], "id int, category string, lang string, pair_id string, answer string, tools string, output string").write.json(str(tmp_path / name))
    assert cli.main(["eval", "--input", str(tmp_path / "one")]) == 0 and cli.main(["eval-multilingual", "--input", str(tmp_path / "one")]) == 0
    assert cli.main(["decompose", "--base", str(tmp_path / "one"), "--tuned", str(tmp_path / "two")]) == 0 and cli.main(["report", "--input", str(tmp_path / "one"), "--out", str(tmp_path / "r.html")]) == 0
    assert "<table>" in (tmp_path / "r.html").read_text()


def test_dialogues(spark):
    said = "Role definition: x\nHistorical dialog data is as follows:\nInquirer: Hello there\nResponse assistant: Hi\nInquirer: Find me a boat"
    df = spark.createDataFrame([(said,), ("  plain request ",), ("Historical dialog data is as follows:\nInquirer: ok",), (said.split("Response")[0],)], "t string")
    history, query = readers.dialogue(F.col("t"))
    got = [(r.h and [tuple(x) for x in r.h], r.q) for r in df.select(history.alias("h"), query.alias("q")).collect()]
    assert got[0] == ([("user", "Hello there"), ("assistant", "Hi")], "Find me a boat") and got[1] == (None, "plain request")
    assert got[2] == (None, "Historical dialog data is as follows:\nInquirer: ok") and got[3] == (None, "Hello there")


def test_open_call_strings():
    read = lambda t: [(c["name"], json.loads(c["arguments"])) for c in parsing.parse_call_string(t)]
    assert read("[f(a=1)") == read("[f(a=1") == [("f", {"a": 1})] and read('[f(a="(x"), g(b=[1, 2])]')[0] == ("f", {}) and read("f(a=1)") == []


def test_values_keep_their_types(spark, tmp_path):
    examples = spark.createDataFrame([(1, "simple", None, "q", "[]", ("tool_call", [("f", '{"n": 5, "s": "5", "l": [1]}')], ""))], "ord long, category string, history array<struct<role:string,content:string>>, query string, tools string, answer struct<type:string,calls:array<struct<name:string,arguments:string>>,content:string>")
    writers.bfcl(examples, str(tmp_path / "b"))
    line = spark.read.text(str(tmp_path / "b/answer")).first().value
    assert json.loads(line) == {"id": "BFCL_v4_simple_0", "ground_truth": [{"f": {"n": [5], "s": ["5"], "l": [[1]]}}]}


def test_images(spark):
    uri = lambda x: spark.range(1).select(writers.image_uri(F.lit(x))).first()[0]
    assert [uri(x) for x in ("data:image/png;base64,AA", "https://a/b.png", "/x/y.png")] == ["data:image/png;base64,AA", "https://a/b.png", "file:///x/y.png"]


def test_ordered_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, i * 7 % 50) for i in range(50)], "g int, x int")
    for groups in ([], ["g"]):
        got = ordered(df, groups, ["x"], "n").collect()
        for key in {tuple(r[g] for g in groups) for r in got}:
            mine = sorted((r for r in got if tuple(r[g] for g in groups) == key), key=lambda r: r.n)
            assert [r.n for r in mine] == list(range(len(mine))) and [r.x for r in mine] == sorted(r.x for r in mine)


def test_twins_are_numbered_by_their_ids_alone(spark):
    """Wide rows are neither sampled nor dealt by range: what is sorted has ids only, and rows of one id keep a place each."""
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "ex_id long, query string")
    chosen = gen._chosen(rows, 10, "fmt", "fmt-", F.lit(True))
    assert sorted((r.ex_id, r.query) for r in chosen.collect()) == [(1, "a"), (1, "b"), (2, "c")] and {r._pair for r in chosen.collect()} == {"fmt-0", "fmt-1", "fmt-2"}
    windows = [line for line in chosen._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line or "_inside" in line]
    assert windows and not any("query" in line for line in windows)

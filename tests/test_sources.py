"""Readers, writers, streams, reports."""

import json

from pyspark.sql import functions as F

from loomstead import report, streaming
from loomstead.sources import readers, writers


def test_readers(spark):
    tools = json.dumps([{"name": "f", "parameters": {"properties": {}}}])
    flat = spark.createDataFrame([("q", tools, '[{"name":"f","arguments":{"a":1}}]'), ("q", "[]", '[{"name":"f"}]'), ("", tools, '[{"name":"f"}]')], "query string, tools string, answers string")
    got = readers.call_rows(flat).collect()
    assert len(got) == 1 and got[0].answer.calls[0]["name"] == "f" and json.loads(got[0].answer.calls[0]["arguments"]) == {"a": 1}
    turn = "struct<from:string,value:string>"
    dialog = spark.createDataFrame([(f"Tools: {tools} Use them.", [("user", "hi"), ("assistant", "[f(a=1)]")]), ("none", [("user", "hi"), ("assistant", "text")])], f"system string, conversations array<{turn}>")
    got = readers.dialog_rows(dialog).collect()
    assert [(r.query, r.answer.calls[0]["name"]) for r in got] == [("hi", "f")]
    messages = json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": [{"function": {"name": "f", "arguments": "{}"}}]}])
    assert readers.message_rows(spark.createDataFrame([(tools, messages)], "tools string, messages string")).first().query == "q"
    pairs = spark.createDataFrame([("p", "c", "", "better"), ("p", None, None, None)], "prompt string, completion string, enhanced_prompt string, enhanced_completion string")
    assert [tuple(r) for r in readers.enhanced_rows(pairs).collect()] == [("p", "better")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "ord int, v string")
    writers.json_lines(df, f"file://{tmp_path}/out")
    assert sorted((r.ord, r.v) for r in readers.json_lines(spark, f"file://{tmp_path}/out", "ord int, v string").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "probes.txt").write_text('{"query": "a"}\n\nraw line\n')
    assert sorted(r.text for r in readers.probes(spark, f"file://{tmp_path}/probes.txt").collect()) == ["a", "raw line"]
    kept = writers.manifest(str(tmp_path), 42, {"a": 1})
    assert writers.manifest_errors(str(tmp_path), kept) == []
    (tmp_path / "probes.txt").write_text("changed")
    assert writers.manifest_errors(str(tmp_path), kept) == ["changed: probes.txt"]


def test_turns_and_uris(spark):
    turn = "struct<role:string,content:string>"
    row = spark.createDataFrame([([("user", "a"), ("assistant", "b")], "c")], f"h array<{turn}>, q string")
    got = row.select(writers.question_turns(F.col("h"), F.col("q")).alias("t")).first().t
    assert [[m.content for m in t] for t in got] == [["a", "b"], ["c"]]
    uri = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"),)], "b binary").select(writers.data_uri(F.col("b"))).first()[0]
    assert uri == "data:image/jpeg;base64,/9j/4A=="


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("Same  text", "2024-01-01 00:00:00"), ("same text", "2024-01-01 00:01:00"), ("other", "2024-01-01 00:02:00")], "text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    kept = streaming.guard(streaming.first_of_each(stream, "text", "ts"), F.length("text") > 0)
    query = kept.writeStream.format("memory").queryName("first_rows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("first_rows").count() == 2


def test_report(spark):
    df = spark.createDataFrame([("a|b", 1.5), (None, None)], "k string, v double")
    assert report.markdown(df, "T") == "## T\n\n| k | v |\n|---|---|\n| a\\|b | 1.5 |\n|  |  |\n"
    assert "<td>a|b</td>" in report.page({"T": df})

"""Values for nested schemas, digests of artifacts, message layouts, images."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomstead.functions import parsing, sampling
from loomstead.sources import manifests, readers, writers

PATTERNS = [r"^[A-Z]{3}-\d{4}$", r"^\+?[0-9]{7,12}$", r"^(red|green|blue)$", r"[a-f0-9]{8}", r"^#[0-9a-fA-F]{6}$", r"^\w+@\w+\.(com|org)$", r"^[^,;]+$", r"^a.c$", r"^(?:x|y){2,4}z?$", r"^\d+(\.\d{1,2})?$", r"\S+"]


def drawn(rng, depth=0):
    kind = rng.choice(["string", "integer", "number", "boolean", "null", "array", "object"] if depth < 3 else ["string", "integer", "number", "boolean"])
    out = {"type": [kind, "null"] if rng.random() < 0.1 else kind}
    if kind == "string":
        out |= rng.choice([{}, {"pattern": rng.choice(PATTERNS)}, {"format": rng.choice(["date", "email", "uuid", "date-time"])}, {"minLength": rng.randint(0, 12)}, {"maxLength": rng.randint(1, 4)}, {"enum": ["b", "c"]}])
    elif kind in ("integer", "number"):
        low = rng.randint(-50, 50)
        out |= rng.choice([{}, {"minimum": low}, {"maximum": low}, {"exclusiveMinimum": low, "maximum": low + 2}, {"minimum": low, "exclusiveMaximum": low + 1}, {"minimum": low + 0.25, "maximum": low + 1.25}, {"enum": [5, 6]}, {"const": 4}])
    elif kind == "array":
        out |= {"items": drawn(rng, depth + 1)} | rng.choice([{}, {"minItems": 2}, {"maxItems": 1}])
    elif kind == "object":
        out |= {"properties": {k: drawn(rng, depth + 1) for k in "pqr"}, "required": rng.sample("pqr", 2)} | rng.choice([{}, {"additionalProperties": False}])
    return out


def test_every_value_fits_its_schema(spark):
    rng = random.Random(4)
    schemas = [drawn(rng) for _ in range(1000)]
    for i, s in enumerate(schemas):
        assert parsing.schema_errors(sampling.sample(s, random.Random(i)), s) == [], s
    rows = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(schemas)] + [(-1, None), (-2, "no"), (-3, '{"enum":[1],"type":"string"}'), (-4, '{"type":"string","pattern":"(?=a)b"}')], "i long, s string")
    got = {r.i: r.v for r in rows.select("i", sampling.sampled("s", "i").alias("v")).collect()}
    assert all(got[i] is not None and parsing.schema_errors(json.loads(got[i]), s) == [] for i, s in enumerate(schemas))
    assert {got[-1], got[-2], got[-3], got[-4]} == {None}
    tool = {"name": "f", "parameters": {"type": "object", "properties": {"p": schemas[0], "q": schemas[1]}, "required": ["p", "q"]}}
    assert parsing.call_errors({"name": "f", "arguments": sampling.sample(tool["parameters"], rng)}, [tool]) == []


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns(pattern):
    assert all(re.search(pattern, sampling.matching(pattern, random.Random(i))) for i in range(200))
    assert len({sampling.matching(pattern, random.Random(i)) for i in range(50)}) > 1


def tree(data):
    leaves = [hashlib.sha256(data[i : i + manifests.CHUNK]).hexdigest() for i in range(0, max(len(data), 1), manifests.CHUNK)]
    return hashlib.sha256("".join(leaves).encode()).hexdigest()


def test_digests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    contents = {"a.bin": bytes(range(256)) * 12_000, "sub/b.txt": b"x", "small": b"y" * 99}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "manifest.json").write_text("{}")
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path: (r.bytes, r.digest) for r in manifests.digests(spark, str(tmp_path)).collect()}
    assert got == {n: (len(d), tree(d)) for n, d in contents.items()}
    kept = writers.manifest(str(tmp_path), 7, {"a": 1})
    assert kept["seed"] == 7 and set(kept["versions"]) == {"python", *manifests.LIBRARIES} and writers.manifest_errors(str(tmp_path), kept) == []
    (tmp_path / "a.bin").write_bytes(contents["a.bin"][:-1] + b"!")
    (tmp_path / "small").unlink()
    (tmp_path / "new").write_text("n")
    assert writers.manifest_errors(str(tmp_path), kept) == ["changed: a.bin", "new: new", "vanished: small"]
    assert manifests.commit("/nowhere") is None and len(manifests.commit() or "") in (0, 40)


TOOLS = [{"type": "function", "function": {"name": "f", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}}}}]


def messages(content=None, arguments='{"a": 1}', wrapped=True):
    call = {"function": {"name": "f", "arguments": arguments}} if wrapped else {"name": "f", "arguments": arguments}
    calling = {"role": "assistant", "content": content, "tool_calls": [call]} if content is None else {"role": "assistant", "content": content}
    return [{"role": "system", "content": "s"}, {"role": "user", "content": "first"}, {"role": "assistant", "content": "hm"}, {"role": "user", "content": "q"}, calling, {"role": "user", "content": "later"}]


def test_message_layouts(spark):
    same = [("q", "f", {"a": 1})]
    read = lambda df: [(r.query, r.answer.calls[0].name, json.loads(r.answer.calls[0].arguments)) for r in readers.message_rows(df).collect()]
    text = lambda m: spark.createDataFrame([(json.dumps(TOOLS), json.dumps(m))], "tools string, messages string")
    assert read(text(messages())) == read(text(messages(arguments={"a": 1}))) == read(text(messages(wrapped=False))) == same
    assert read(text(messages(content='[{"name":"f","parameters":{"a":1}}]'))) == read(text(messages(content='{"name":"f","arguments":{"a":1}}'))) == same
    objects = text(messages(arguments={"a": 1})).selectExpr("from_json(tools, 'array<struct<function:struct<name:string,parameters:variant>>>') AS functions", "parse_json(messages) AS conversations")
    assert read(objects) == same
    structs = text(messages()).selectExpr("tools AS available_tools", "from_json(messages, 'array<struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>') AS messages")
    assert read(structs) == same
    other = [{"from": "human", "value": "q"}, {"from": "gpt", "value": '[{"name":"f","arguments":{"a":1}}]'}]
    assert read(text(other)) == same
    for bad in ([], other[1:], [other[0]], [{"from": "human", "value": ""}, other[1]], [1, None]):
        assert read(text(bad)) == []
    assert read(spark.createDataFrame([(None, json.dumps(messages())), ("[]", json.dumps(messages())), (json.dumps(TOOLS), "no")], "tools string, messages string")) == []


def test_images(spark, tmp_path):
    png, jpeg = b"\x89PNG\r\n\x1a\nx", b"\xff\xd8\xff\xe0x"
    rows = readers.image_rows(spark.createDataFrame([(png, "q", "a"), (jpeg, "q", "a"), (None, "q", "a"), (png, " ", "a"), (png, "q", None)], "image binary, question string, answer string")).collect()
    assert sorted(r.image[:15] for r in rows) == ["data:image/jpeg", "data:image/png;"] and {(r.chart_type, r.qa_kind, r.lang) for r in rows} == {("other", "reasoning", "en")}
    structs = spark.createDataFrame([((png, None), "q", 4), ((None, "/x/y.png"), "q", 5), ((b"", "https://a/b.png"), "q", 6), ((None, None), "q", 7)], "image struct<bytes:binary,path:string>, query string, label int")
    assert [(r.image[:15], r.answer) for r in sorted(readers.image_rows(structs).collect(), key=lambda r: r.answer)] == [("data:image/png;", "4"), ("file:///x/y.png", "5"), ("https://a/b.png", "6")]
    (tmp_path / "c.png").write_bytes(png)
    files = readers.image_files(spark, str(tmp_path)).withColumns({"question": F.col("name"), "answer": F.lit("a")})
    assert [(r.question, r.image[:15]) for r in readers.image_rows(files, 5).collect()] == [("c.png", "data:image/png;")]

"""Tool-use examples as typed rows, and what is asked of one: names, gold calls, signatures, eligibility.

An example has ``ex_id``, ``tools``, ``query``, ``answer``, ``history`` and ``meta`` (names to texts). Properties and
arguments are arrays in schema order, and an argument's value is JSON text, so any type keeps its form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import kept
from . import checks

PROP = "struct<name:string,type:string,required:boolean,options:array<string>>"
TOOL = f"struct<name:string,description:string,props:array<{PROP}>>"
CALL = "struct<name:string,args:array<struct<name:string,value:string>>>"
ANSWER = f"struct<type:string,calls:array<{CALL}>,content:string>"
TURNS = "array<struct<role:string,content:string>>"
LAYOUT = f"ex_id bigint, tools array<{TOOL}>, query string, answer {ANSWER}, history {TURNS}, meta map<string,string>"
COLUMNS = ["ex_id", "tools", "query", "answer", "history", "meta"]

#: Words without a topic, left out where requests and tools are compared.
TOPICLESS = (
    "what", "who", "whom", "whose", "which", "when", "where", "why", "how", "can", "could", "would", "will", "the", "a", "an", "me", "my", "you", "your", "is", "are", "am", "do", "does",
    "of", "to", "for", "and", "or", "give", "tell", "write", "draft", "explain", "summarize", "sing", "with", "about", "please", "that", "this", "some", "any", "get", "make", "have",
)


def typed(rows: DataFrame) -> DataFrame:
    """Rows of the readers' layout (tools and arguments as JSON text) with an ``ex_id`` as typed examples."""
    schema = "array<struct<name:string,description:string,parameters:struct<properties:map<string,struct<type:string,enum:array<string>>>,required:array<string>>>>"
    none = F.array().cast("array<string>")

    def tool(t: Column) -> Column:
        required = F.coalesce(t["parameters"]["required"], none)
        entries = F.coalesce(F.map_entries(t["parameters"]["properties"]), F.array().cast("array<struct<key:string,value:struct<type:string,enum:array<string>>>>"))
        prop = lambda p: F.struct(p["key"].alias("name"), F.coalesce(p["value"]["type"], F.lit("string")).alias("type"), F.array_contains(required, p["key"]).alias("required"), p["value"]["enum"].alias("options"))
        return F.struct(t["name"].alias("name"), F.coalesce(t["description"], F.lit("")).alias("description"), F.transform(entries, prop).alias("props"))

    args = lambda c: F.transform(F.map_entries(F.from_json(c["arguments"], "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), F.to_json(e["value"]).alias("value")))
    calls = F.transform("answer.calls", lambda c: F.struct(c["name"].alias("name"), args(c).alias("args")))
    meta = F.col("meta") if "meta" in rows.columns else F.map_from_arrays(none, none)
    return rows.select(
        F.col("ex_id").cast("long").alias("ex_id"), F.transform(F.from_json("tools", schema), tool).alias("tools"), "query",
        F.struct(F.col("answer.type").alias("type"), calls.alias("calls"), F.col("answer.content").alias("content")).alias("answer"), F.col("history").cast(TURNS).alias("history"), meta.alias("meta"),
    )


def tools_json(tools: Column) -> Column:
    """The tool list as JSON text, in the layout that validators and prompts read."""
    prop = lambda p: F.struct(p["name"].alias("key"), F.struct(p["type"].alias("type"), p["options"].alias("enum")).alias("value"))
    schema = lambda t: F.struct(F.lit("object").alias("type"), F.map_from_entries(F.transform(t["props"], prop)).alias("properties"), F.transform(F.filter(t["props"], lambda p: p["required"]), lambda p: p["name"]).alias("required"))
    return F.to_json(F.transform(tools, lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"), schema(t).alias("parameters"))))


def quoted(text: Column) -> Column:
    """A text as a JSON string; most texts have nothing to escape and need no JSON writer."""
    packed = F.to_json(F.array(text))
    return F.when(text.rlike(r"^[ !#-\[\]-~]*$") & ~F.contains(text, F.lit("\n")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.substr(packed, F.lit(2), F.length(packed) - 2))


def call_json(call: Column) -> Column:
    """A call as JSON text with sorted keys."""
    args = F.array_sort(F.transform(call["args"], lambda a: F.concat(quoted(a["name"]), F.lit(":"), a["value"])))
    return F.concat(F.lit('{"arguments":{'), F.array_join(args, ","), F.lit('},"name":'), quoted(call["name"]), F.lit("}"))


def envelope(kind: Column, calls: Column, content: Column) -> Column:
    """The wire form of an answer: canonical JSON of a call, a refusal or a question."""
    called = F.concat(F.lit('{"action":"call","calls":['), F.array_join(F.transform(calls, call_json), ","), F.lit("]}"))
    said = F.concat(F.lit('{"action":'), quoted(kind), F.lit(',"message":'), quoted(F.coalesce(content, F.lit(""))), F.lit("}"))
    return F.when(kind == "tool_call", called).when(kind.isin("refuse", "clarify"), said).otherwise(F.raise_error(F.concat(F.lit("unknown answer type "), kind)))


def answer_json(answer: Column) -> Column:
    """An answer as JSON text, in the layout that validators read."""
    called = F.concat(F.lit('{"type":"tool_call","calls":['), F.array_join(F.transform(answer["calls"], call_json), ","), F.lit("]}"))
    return F.when(answer["type"] == "tool_call", called).otherwise(F.to_json(F.struct(answer["type"].alias("type"), answer["content"].alias("content"))))


def names(tools: Column) -> Column:
    return F.transform(tools, lambda t: t["name"])


def called(answer: Column) -> Column:
    """Distinct names of the gold calls."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(answer["calls"], F.array().cast(f"array<{CALL}>")), lambda c: c["name"]), lambda n: n.isNotNull()))


def required(tool: Column) -> Column:
    return F.transform(F.filter(tool["props"], lambda p: p["required"]), lambda p: p["name"])


def by_name(tools: Column, name: Column) -> Column:
    """The first tool of a name."""
    return F.element_at(F.filter(tools, lambda t: t["name"] == name), 1)


def first_of_names(tools: Column) -> Column:
    """The first tool of every name, in order."""
    unique = F.array_distinct(names(tools))
    return F.transform(unique, lambda n: by_name(tools, n))


def callable_(answer: Column, tools: Column, query: Column) -> Column:
    """Whether the gold is calls of offered tools for a request that isn't empty."""
    offered = F.forall(answer["calls"], lambda c: F.array_contains(names(tools), c["name"]))
    return F.coalesce((answer["type"] == "tool_call") & (F.size(answer["calls"]) > 0) & (F.length(query) > 0) & offered, F.lit(False))


def valid(rows: DataFrame) -> Column:
    """Whether the answer fits the schemas of the tools (refusals and questions always do)."""
    return checks.answer_fits(rows["answer"], rows["tools"])


def curated(rows: DataFrame) -> DataFrame:
    """Examples with tools and a valid answer."""
    return kept(rows.where(F.size("tools") > 0), valid(rows))


def guarded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples whose answers are valid, and by source how many are not."""
    marked = rows.withColumn("_valid", valid(rows))
    counts = marked.groupBy(F.col("meta")["source"].alias("source")).agg(F.count_if("_valid").alias("kept"), F.count_if(~F.col("_valid")).alias("dropped"))
    return marked.where("_valid").drop("_valid"), counts


def group_of(meta: Column) -> Column:
    """The slice in which an example has near-duplicates: its kind, else env, else its language, else none."""
    kind = F.coalesce(meta["hn_kind"], meta["mt_kind"], meta["sd_kind"])
    return F.coalesce(kind, F.when(meta["source"] == "env", "env").when(meta["source"] == "multilingual", F.concat(F.lit("ml-"), F.coalesce(meta["lang"], F.lit("")))), F.lit(""))


def signature(tools: Column, query: Column, answer: Column, meta: Column) -> Column:
    """What makes two examples the same: slice, behaviour, tools on offer, and the request."""
    return F.concat_ws(" | ", group_of(meta), F.coalesce(answer["type"], F.lit("")), F.array_join(F.array_sort(names(tools)), " "), F.coalesce(query, F.lit("")))


def split_key(ex_id: Column, meta: Column) -> Column:
    """Twins of a pair share a key; other examples have one of their own."""
    return F.coalesce(F.concat(F.lit("pair:"), meta["pair_id"]), F.concat(F.lit("solo:"), ex_id.cast("string")))


def twinnable(rows: DataFrame, single_turn: bool = False) -> Column:
    """Whether an example may get a twin: it has tools and is in no pair; for masked ones, without a history."""
    fit = (F.size("tools") > 0) & F.col("meta")["pair_id"].isNull()
    return fit & (F.coalesce(F.size("history"), F.lit(0)) <= 0) if single_turn else fit


def topics(text: Column) -> Column:
    """Distinct words of a text that may name its topic."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(*TOPICLESS)))

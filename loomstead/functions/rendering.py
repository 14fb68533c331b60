"""Prompts, tool renderings, reasoning traces and report text as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Tools as typed rows: name, description, props (name, type, required), in property order.
TOOL = "struct<name:string,description:string,props:array<struct<name:string,type:string,required:boolean>>>"


def history(turns: Column) -> Column:
    """ROLE: content lines."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["content"])), "\n")


@F.pandas_udf(T.StringType())
def indented(tools: pd.Series) -> pd.Series:
    """A tool list (JSON text) as JSON with sorted keys, indented by two."""
    return tools.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False))


def compact(tools: Column) -> Column:
    one = lambda t: F.concat(t["name"], F.lit("("), F.array_join(F.transform(t["props"], lambda p: F.concat(p["name"], F.when(p["required"], "").otherwise("?"), F.lit(":"), p["type"])), ", "), F.lit(")"))
    return F.array_join(F.transform(tools, one), "\n")


def python(tools: Column) -> Column:
    arg = lambda p: F.concat(p["name"], F.lit(": "), p["type"], F.when(p["required"], "").otherwise(" = None"))
    one = lambda t: F.concat(F.lit("def "), t["name"], F.lit("("), F.array_join(F.transform(t["props"], arg), ", "), F.lit('):\n    """'), F.coalesce(t["description"], F.lit("")), F.lit('"""'))
    return F.array_join(F.transform(tools, one), "\n\n")


def xml(tools: Column) -> Column:
    param = lambda p: F.concat(F.lit('  <param name="'), p["name"], F.lit('" type="'), p["type"], F.lit('" required="'), p["required"].cast("string"), F.lit('"/>'))
    one = lambda t: F.concat(F.lit('<tool name="'), t["name"], F.lit('">\n'), F.array_join(F.transform(t["props"], param), "\n"), F.lit("\n</tool>"))
    return F.array_join(F.transform(tools, one), "\n")


def eval_prompt(tools: Column, turns: Column, query: Column) -> Column:
    """Tools, history if there is one, then the query."""
    return F.concat(F.lit("Tools:\n"), tools, F.when(F.size(turns) > 0, F.concat(F.lit("\n\n"), history(turns))).otherwise(""), F.lit("\n\nUSER: "), query)


def trace(kind: Column, n_calls: Column, dropped: Column, ambiguous: Column) -> Column:
    """A short reasoning prefix that follows from the gold answer."""
    why = (
        F.when(kind == "refuse", "No offered tool fits this request.").when((kind == "clarify") & ambiguous, "More than one tool fits; I need to ask which.")
        .when(kind == "clarify", F.concat(F.lit("The request lacks "), F.coalesce(dropped, F.lit("a required value")), F.lit("; I need to ask.")))
        .when(n_calls > 1, F.concat(F.lit("This needs "), n_calls.cast("string"), F.lit(" calls."))).otherwise("One tool fits and every required value is given.")
    )
    return F.concat(F.lit("<think>"), why, F.lit("</think>"))


def percent(share: Column) -> Column:
    return F.when(share.isNull(), "n/a").otherwise(F.concat(F.format_string("%.1f", share * 100), F.lit("%")))


def points(delta: Column) -> Column:
    """A signed difference in percentage points."""
    return F.when(delta.isNull(), "n/a").otherwise(F.concat(F.format_string("%+.1f", delta * 100), F.lit("pp")))


def cell(value: Column) -> Column:
    """A leaderboard cell: a number to three places, or the mark of a missing one."""
    return F.when(value.isNull(), "__PENDING__").otherwise(F.format_string("%.3f", value))

"""Schema checks and verdicts as column expressions; grammars that columns lack go to a function, for those rows only.

Typed examples carry properties with types and options, so their calls are checked in the row. For tools as JSON text
each different schema is compiled once, to a plan: paths with types, options and bounds, and objects with the names they
allow. Calls meet their plan by the schema's digest and are checked through VARIANT paths. Schemas with patterns,
constants, references or constrained array items have no plan; their calls, and arguments that VARIANT doesn't
take (a name twice), are checked by ``parsing.call_errors``.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import parsing
from ..functions.parsing import call_errors
from ..functions.text import let
from ..sources.scratch import Scratch
from .similarity import small

RULE = "struct<path:string,parent:string,kinds:array<string>,options:array<string>,low:double,high:double,above:double,below:double,shortest:int,longest:int,fewest:int,most:int,items:array<string>,required:boolean>"
CLOSED = "struct<path:string,allowed:array<string>>"
PLAN = f"struct<rules:array<{RULE}>,closed:array<{CLOSED}>>"
#: What a plan can say of a value; a schema with another keyword has none.
PLAIN = {"type", "enum", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems", "items", "properties", "required", "additionalProperties"}
REMARKS = {"description", "title", "default", "examples", "format", "$comment"}


#: JSON texts that say their value as they stand: whole numbers that a double holds, texts with nothing escaped.
WHOLE, TEXT = r"^-?(0|[1-9]\d{0,14})\z", r'^"[^"\\\x00-\x1F]*"\z'


def _inside(text: Column) -> Column:
    """What stands between the quotes of a plain JSON text."""
    return F.substr(text, F.lit(2), F.length(text) - 2)


def kind_fits(value: Column, kind: Column) -> Column:
    """Whether a VARIANT has a JSON-Schema type; unknown types fit everything, and 2.0 is an integer."""
    whole = F.try_variant_get(value, "$", "double")

    def told(found: Column) -> Column:
        number = found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
        return (
            F.when(kind == "string", found == "STRING").when(kind == "boolean", found == "BOOLEAN").when(kind == "null", found == "VOID").when(kind == "array", found.startswith("ARRAY"))
            .when(kind == "object", found.startswith("OBJECT")).when(kind == "number", number).when(kind == "integer", number & (whole == F.floor(whole))).otherwise(F.lit(True))
        )

    return let(F.schema_of_variant(value), told)


def fits(args: Column, props: Column) -> Column:
    """Whether arguments (name, value as JSON text) fit properties (name, type, required, options) and name no others.

    Of arguments with one name the last counts; an option is a text.
    """
    given = F.coalesce(args, F.array().cast("array<struct<name:string,value:string>>"))

    def holds(p: Column) -> Column:
        is_option = lambda value: p["options"].isNull() | ((F.schema_of_variant(value) == "STRING") & F.array_contains(p["options"], F.try_variant_get(value, "$", "string")))
        parsed = lambda text: let(F.try_parse_json(text), lambda value: F.coalesce(kind_fits(value, p["type"]) & is_option(value), F.lit(False)))
        whole = lambda text: p["type"].isin("integer", "number") & p["options"].isNull() & text.rlike(WHOLE)
        plain = lambda text: (p["type"] == "string") & text.rlike(TEXT)
        option = lambda text: p["options"].isNull() | F.coalesce(F.array_contains(p["options"], _inside(text)), F.lit(False))
        told = lambda mine: let(F.try_element_at(mine, F.lit(-1))["value"], lambda text: F.when(whole(text), True).when(plain(text), option(text)).otherwise(parsed(text)))
        return let(F.filter(given, lambda a: a["name"] == p["name"]), lambda mine: F.when(F.size(mine) == 0, ~F.coalesce(p["required"], F.lit(False))).otherwise(told(mine)))

    known = let(F.transform(props, lambda p: p["name"]), lambda names: F.forall(given, lambda a: F.array_contains(names, a["name"])))
    return known & F.forall(props, holds)


def call_fits(call: Column, tools: Column) -> Column:
    """Whether a typed call fits the tool of its name (the last of equal names)."""

    def told(mine: Column) -> Column:
        known = (F.size(mine) > 0) & (F.length(call["name"]) > 0)
        return F.coalesce(known, F.lit(False)) & F.coalesce(let(F.try_element_at(mine, F.lit(-1))["props"], lambda props: fits(call["args"], props)), F.lit(False))

    return let(F.filter(tools, lambda t: t["name"] == call["name"]), told)


def answer_fits(answer: Column, tools: Column) -> Column:
    """Whether a typed answer is a refusal, a question, or one call or more that all fit."""
    called = (F.size(answer["calls"]) > 0) & F.forall(answer["calls"], lambda c: call_fits(c, tools))
    return F.when(F.coalesce(answer["type"] == "tool_call", F.lit(False)), F.coalesce(called, F.lit(False))).otherwise(True)


def _plan(schema: Any) -> dict | None:
    """Rules and closed objects of a parameters schema; null if it says more than a plan can."""
    rules: list[dict] = []
    closed: list[dict] = []

    def number(x: Any) -> bool:
        return isinstance(x, (int, float)) and not isinstance(x, bool)

    def walk(node: Any, path: str, parent: str | None, required: bool, strict: bool) -> bool:
        if not isinstance(node, dict) or not set(node) <= PLAIN | REMARKS:
            return False
        kinds, items, extra = node.get("type"), node.get("items"), node.get("additionalProperties", not strict)
        kinds = [kinds] if isinstance(kinds, str) else kinds
        named = node.get("properties") or {}
        needed = node.get("required") or []
        bounds = [node.get(k) for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems")]
        if not isinstance(extra, bool) or not isinstance(named, dict) or not isinstance(needed, list) or (kinds is not None and not all(isinstance(k, str) for k in kinds)):
            return False
        if any(b is not None and not number(b) for b in bounds) or any(b is not None and int(b) != b for b in bounds[4:]):
            return False
        if items is not None and not (isinstance(items, dict) and set(items) <= {"type"} | REMARKS and isinstance(items.get("type", ""), str)):
            return False
        options = node.get("enum")
        if options is not None and not (isinstance(options, list) and all(isinstance(o, str) for o in options)):
            return False
        if any(not isinstance(k, str) or "'" in k or "\\" in k for k in [*named, *needed]):
            return False
        rules.append(
            {"path": path, "parent": parent, "kinds": kinds or [], "options": options, **dict(zip(("low", "high", "above", "below"), (None if b is None else float(b) for b in bounds), strict=False))}
            | {k: None if b is None else int(b) for k, b in zip(("shortest", "longest", "fewest", "most"), bounds[4:], strict=True)}
            | {"items": [items["type"]] if items and items.get("type") else None, "required": required}
        )
        if not extra:
            closed.append({"path": path, "allowed": list(named)})
        for name in needed:
            if name not in named:
                rules.append(dict.fromkeys(("options", "low", "high", "above", "below", "shortest", "longest", "fewest", "most", "items")) | {"path": f"{path}['{name}']", "parent": path, "kinds": [], "required": True})
        return all(walk(child or {}, f"{path}['{name}']", path, name in needed, False) for name, child in named.items())

    return {"rules": rules, "closed": closed} if walk(schema, "$", None, True, True) else None


def compiled(schema: str) -> Column:
    """The plan of a column of parameters schemas (JSON text), null where one has none."""

    def run(texts: pd.Series) -> pd.DataFrame:
        plans = [_plan(json.loads(s) if s else {}) for s in texts]
        return pd.DataFrame({k: [p and p[k] for p in plans] for k in ("rules", "closed")})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, PLAN)(schema)


def follows(value: Column, plan: Column) -> Column:
    """Whether arguments (VARIANT, an object) follow a plan."""
    at = lambda path: F.try_variant_get(value, path, "variant")

    def rule(r: Column) -> Column:
        x = at(r["path"])
        number = F.when(~F.schema_of_variant(x).isin("BOOLEAN", "STRING"), F.try_variant_get(x, "$", "double"))
        text = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
        length, size = F.length(text), F.size(F.try_variant_get(x, "$", "array<variant>"))
        kept = lambda bound, ok: F.coalesce(ok, bound.isNull() | F.lit(True))
        bounds = [(number, r["low"], lambda v, b: v >= b), (number, r["high"], lambda v, b: v <= b), (number, r["above"], lambda v, b: v > b), (number, r["below"], lambda v, b: v < b)]
        bounds += [(length, r["shortest"], lambda v, b: v >= b), (length, r["longest"], lambda v, b: v <= b), (F.when(size >= 0, size), r["fewest"], lambda v, b: v >= b), (F.when(size >= 0, size), r["most"], lambda v, b: v <= b)]
        good = (F.size(r["kinds"]) == 0) | F.exists(r["kinds"], lambda k: kind_fits(x, k))
        good &= r["options"].isNull() | F.coalesce(F.array_contains(r["options"], text), F.lit(False))
        for v, b, test in bounds:
            good &= kept(b, test(v, b))
        inner = F.try_variant_get(x, "$", "array<variant>")
        good &= r["items"].isNull() | inner.isNull() | F.forall(inner, lambda e: F.exists(r["items"], lambda k: kind_fits(e, k)))
        needed = r["required"] & (r["parent"].isNull() | F.coalesce(F.schema_of_variant(at(r["parent"])).startswith("OBJECT"), F.lit(False)))
        return F.when(x.isNull(), ~needed).otherwise(F.coalesce(good, F.lit(False)))

    def shut(c: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(value, c["path"], "map<string,variant>"))
        return keys.isNull() | (F.size(F.array_except(keys, c["allowed"])) == 0)

    return F.forall(plan["rules"], rule) & F.forall(plan["closed"], shut)


@F.pandas_udf(T.BooleanType())
def _function_fits(name: pd.Series, arguments: pd.Series, schema: pd.Series) -> pd.Series:
    """What columns can't decide; rows that they do decide come as nulls."""
    one = lambda n, a, s: None if n is None else not call_errors({"name": n, "arguments": a}, [{"name": n, "parameters": json.loads(s) if s else {}}])
    return pd.Series([one(*x) for x in zip(name, arguments, schema, strict=True)], dtype="boolean")


def checked_calls(calls: DataFrame) -> DataFrame:
    """``calls`` (id, tools, name, arguments; the last three as text) with ``fits``.

    A call without a name, of an unknown tool, or with arguments that are no object, doesn't fit; null arguments are
    none. Schemas are compiled once each, and their plans are joined by digest.
    """
    scratch = Scratch(calls.sparkSession)
    offered = F.try_variant_get(F.try_parse_json("tools"), "$", "array<variant>")
    mine = F.filter(offered, lambda t: F.try_variant_get(t, "$.name", "string") == F.col("name"))
    tool = F.try_element_at(mine, F.lit(-1))
    schema = F.coalesce(F.to_json(F.try_variant_get(tool, "$.parameters", "variant")), F.lit("{}"))
    told = calls.withColumn("_known", F.coalesce((F.size(mine) > 0) & (F.length("name") > 0), F.lit(False))).withColumn("_schema", F.when(F.col("_known"), schema)).withColumn("_digest", F.sha2("_schema", 256))
    told = scratch.cut(told)
    plans = told.where("_known").groupBy("_digest").agg(F.first("_schema").alias("_text")).withColumn("_plan", compiled("_text")).select("_digest", "_plan")
    met = told.join(small(scratch.cut(plans)), "_digest", "left")
    value = F.try_parse_json(F.coalesce(F.col("arguments"), F.lit("{}")))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    by_column = F.col("_known") & F.col("_plan.rules").isNotNull() & value.isNotNull()
    rest = F.when(F.col("_known") & ~by_column, F.col("name"))
    asked = met.withColumn("_slow", _function_fits(rest, "arguments", "_schema"))
    decided = F.when(~F.col("_known"), False).when(F.col("_plan.rules").isNotNull() & value.isNotNull(), is_object & follows(value, F.col("_plan"))).otherwise(F.col("_slow"))
    return asked.withColumn("fits", F.coalesce(decided, F.lit(False))).select(*calls.columns, "fits")


def _scalar(value: Column) -> Column:
    return let(F.schema_of_variant(value), lambda kind: ~(kind.startswith("ARRAY") | kind.startswith("OBJECT")))


def normal_form(json_text: Column, forgiving: bool) -> Column:
    """A text that two JSON values share if they count as equal; true counts as 1, as numbers do.

    ``forgiving``: numeric texts are numbers, other texts lose case, outer and repeated white space and a closing mark.
    """
    number = lambda x: F.concat(F.lit("n"), (x + F.lit(0.0)).cast("string"))

    def tidied(low: Column) -> Column:
        tidy = F.concat(F.lit("s"), F.regexp_replace(F.regexp_replace(low, r"\s+", " "), r"[.!?]+$", ""))
        numeric = low.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")
        return F.when(numeric, number(low.try_cast("double"))).when(low == "true", "n1.0").when(low == "false", "n0.0").otherwise(tidy)

    def said(text: Column) -> Column:
        return let(F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), tidied) if forgiving else F.concat(F.lit("s"), text)

    def plain(whole: Column) -> Column:
        return number(whole) if forgiving else F.when(F.abs(whole) < 2.0**53, number(whole)).otherwise(F.concat(F.lit("l"), json_text))

    def form(value: Column, kind: Column) -> Column:
        return (
            F.when(kind == "STRING", said(F.try_variant_get(value, "$", "string"))).when(kind == "VOID", "z").when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "n1.0").otherwise("n0.0"))
            .when(~(kind.startswith("ARRAY") | kind.startswith("OBJECT")), let(F.try_variant_get(value, "$", "double"), plain)).otherwise(F.concat(F.lit("j"), json_text))
        )

    parsed = let(F.try_parse_json(json_text), lambda value: let(F.schema_of_variant(value), lambda kind: form(value, kind)))
    return F.when(json_text.rlike(WHOLE), number(json_text.try_cast("double"))).when(json_text.rlike(TEXT), said(_inside(json_text))).otherwise(parsed)


def _call_form(name: Column, args: Column, forgiving: bool) -> Column:
    each = F.array_sort(F.transform(args, lambda a: F.struct(a["name"].alias("k"), normal_form(a["value"], forgiving).alias("v"))))
    return F.struct(name.alias("n"), each.alias("a"))


def judged(rows: DataFrame, output: str, forgiving: bool = True) -> DataFrame:
    """``rows`` of typed examples with ``v`` (parsed_ok, pred_action, correct, hallucinated_call) for the text in ``output``."""
    return judged_each(rows, {"v": output}, forgiving)


def judged_each(rows: DataFrame, outputs: dict[str, str], forgiving: bool = True) -> DataFrame:
    """``rows`` of typed examples with a verdict (parsed_ok, pred_action, correct, hallucinated_call) for each text, as {name of the verdict: text column}.

    A call is right if it fits its tool and every gold call has one of its own that equals it, all in any order. The
    first object of an output is found by a function; all else are columns, but for examples whose gold arguments are
    lists, objects or alternatives: those go to ``parsing.judged``. All functions of a row are asked in one pass.
    """
    none = F.array().cast("array<struct<name:string,value:string>>")

    def told(call: Column) -> Column:
        def read(given: Column) -> Column:
            entries = F.transform(F.map_entries(F.try_variant_get(given, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), F.to_json(e["value"]).alias("value")))
            return F.when(F.schema_of_variant(given) == "VOID", none).otherwise(entries)

        def args(raw: Column) -> Column:
            # A text that is no JSON has null arguments, and none are something else.
            inner = let(F.try_parse_json(F.try_variant_get(raw, "$", "string")), read)
            return F.when(raw.isNull(), none).when(F.schema_of_variant(raw) == "STRING", inner).otherwise(read(raw))

        return F.struct(F.try_variant_get(call, "$.name", "string").alias("name"), let(F.try_variant_get(call, "$.arguments", "variant"), args).alias("args"))

    from . import examples as ex

    gold_plain = ~F.exists(F.coalesce(F.col("answer.calls"), F.array().cast("array<struct<name:string,args:array<struct<name:string,value:string>>>>")), lambda c: F.exists(c["args"], lambda a: ~F.coalesce(a["value"].rlike(WHOLE) | a["value"].rlike(TEXT) | _scalar(F.try_parse_json(a["value"])), F.lit(False))))
    slow = parsing.verdicts if forgiving else parsing.strict_verdicts
    forms = lambda calls: F.array_sort(F.transform(calls, lambda c: _call_form(c["name"], c["args"], forgiving)))
    read = rows.withColumns({"_plain": F.coalesce(gold_plain, F.lit(False)) | (F.col("answer.type") != "tool_call"), "_gold": forms(F.col("answer.calls"))})
    hard, asked = ~F.col("_plain"), {}
    for i, output in enumerate(outputs.values()):
        asked[f"_object_{i}"] = parsing.model_output(F.col(output))
        asked[f"_slow_{i}"] = slow(F.when(hard, ex.answer_json(F.col("answer"))), F.when(hard, ex.tools_json(F.col("tools"))), F.when(hard, F.col(output)))
    read = read.withColumns(asked)
    read = read.withColumns({f"_wire_{i}": F.try_parse_json(f"_object_{i}") for i in range(len(outputs))})
    calls = lambda i: F.transform(F.coalesce(F.try_variant_get(f"_wire_{i}", "$.calls", "array<variant>"), F.array().cast("array<variant>")), told)
    read = read.withColumns({f"_calls_{i}": calls(i) for i in range(len(outputs))} | {f"_action_{i}": F.try_variant_get(f"_wire_{i}", "$.action", "string") for i in range(len(outputs))})

    def verdict(i: int) -> Column:
        made, action = F.col(f"_calls_{i}"), F.col(f"_action_{i}")
        sane = F.forall(made, lambda c: c["args"].isNotNull() & call_fits(c, F.col("tools")))
        same = F.coalesce((action == "call") & sane & (forms(made) == F.col("_gold")), F.lit(False))
        ok, wants_call = F.col(f"_object_{i}").isNotNull(), F.col("answer.type") == "tool_call"
        correct = F.when(~ok, False).when(wants_call, F.when(F.col("_plain"), same).otherwise(F.coalesce(f"_slow_{i}.correct", F.lit(False)))).otherwise(F.coalesce(action == F.col("answer.type"), F.lit(False)))
        called = ok & ~wants_call & F.coalesce(action == "call", F.lit(False))
        return F.struct(ok.alias("parsed_ok"), F.when(ok, action).alias("pred_action"), correct.alias("correct"), called.alias("hallucinated_call"))

    return read.withColumns({name: verdict(i) for i, name in enumerate(outputs)}).select(*rows.columns, *outputs)

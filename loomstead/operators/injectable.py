"""Operators around a caller's functions: model outputs, judges, synthesis, rollouts.

A function gets a pandas Series of prompts and returns a Series of texts; it runs on the
executors, one Arrow batch at a time. Failures of a judge fall back to the heuristic
score and are counted, never silent.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import parsing

Texts = Callable[[pd.Series], pd.Series]


def with_outputs(df: DataFrame, prompt: str, fn: Texts, name: str = "output") -> DataFrame:
    """``df`` with a model's output for each prompt."""
    return df.withColumn(name, F.pandas_udf(fn, T.StringType())(F.col(prompt)))


def judge_scores(df: DataFrame, prompt: str, fn: Texts, fallback: str, name: str = "score") -> DataFrame:
    """Scores 0..1 from a judge that answers 0..10; where it gives no number, the ``fallback`` column; ``judged`` tells which."""
    said = F.regexp_extract(F.pandas_udf(fn, T.StringType())(F.col(prompt)), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    rated = df.withColumn("_said", said)
    value = F.when(F.col("_said").isNotNull(), F.least(F.greatest(F.col("_said") / 10, F.lit(0.0)), F.lit(1.0)))
    return rated.withColumn("judged", F.col("_said").isNotNull()).withColumn(name, F.coalesce(value, F.col(fallback))).drop("_said")


def synthesize(seeds: DataFrame, prompt: str, write: Texts, critique: Texts | None = None) -> DataFrame:
    """Written examples (query, tools, answer as JSON text) that pass the schema, are new by normalised query, and are approved.

    The model writes one JSON object per prompt; invalid ones go, then repeats (first by
    prompt), then those whose critique does not start with ``yes``.
    """
    made = with_outputs(seeds, prompt, write, "written")
    parsed = made.withColumn("o", parsing.model_output(F.col("written"))).where("o IS NOT NULL")
    rows = parsed.select(F.col(prompt).alias("prompt"), F.get_json_object("o", "$.query").alias("query"), F.get_json_object("o", "$.tools").alias("tools"), F.get_json_object("o", "$.answer").alias("answer"))
    rows = rows.where("query IS NOT NULL AND tools IS NOT NULL AND answer IS NOT NULL").where(F.size(parsing.validation_errors("answer", "tools")) == 0)
    key = F.trim(F.regexp_replace(F.lower("query"), "[^a-z0-9]+", " "))
    first = rows.groupBy(key.alias("_k")).agg(F.min_by(F.struct("prompt", "query", "tools", "answer"), "prompt").alias("r")).select("r.*")
    if critique is None:
        return first
    return with_outputs(first, "query", critique, "verdict").where(F.startswith(F.lower("verdict"), F.lit("yes"))).drop("verdict")


def best_candidate(df: DataFrame, group: str, score: str, index: str) -> DataFrame:
    """The best of N candidates; the earliest of equals."""
    return df.groupBy(group).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(index))).alias("b")).select("b.*")


def rollouts(goals: DataFrame, policy: Callable[[str, str], dict], apply: Callable[[dict, dict], tuple[dict, bool, str]], max_steps: int = 6, retries: int = 1) -> DataFrame:
    """(id, outcome, steps, retries, state): a policy acts on each goal until it is done, refuses, asks or runs out of steps.

    ``policy(goal, observation)`` returns an action envelope; ``apply(state, call)`` the next
    state, whether it worked, and why. Goals are independent, so they run in any task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, goal in zip(batch["id"], batch["goal"], strict=True):
                state, seen, outcome, steps, again = {}, "", "max_steps", 0, 0
                while steps < max_steps:
                    action = policy(goal, seen)
                    if not isinstance(action, dict) or "action" not in action:
                        outcome = "parse_error"
                        break
                    if action["action"] != "call":
                        outcome = action["action"]
                        break
                    ok, steps = True, steps + 1
                    for call in action.get("calls") or []:
                        state, ok, seen = apply(state, call)
                        if not ok:
                            break
                    if not ok:
                        again += 1
                        if again > retries:
                            outcome = "failed"
                            break
                out.append((key, outcome, steps, again, json.dumps(state, sort_keys=True)))
            yield pd.DataFrame(out, columns=["id", "outcome", "steps", "retries", "state"])

    return goals.select("id", "goal").mapInPandas(run, f"id {goals.schema['id'].dataType.simpleString()}, outcome string, steps int, retries int, state string")


def any_order(calls: Column, fold: Callable[[Column], Column], fields: list[str], size: int) -> Column:
    """Whether every order of ``size`` calls succeeds and reaches the same state (item order aside)."""
    ends = []
    for order in itertools.permutations(range(size)):
        state = fold(F.array(*[F.element_at(calls, i + 1) for i in order]))
        ends.append(F.struct((state["applied"] == size).alias("ok"), *[(F.array_sort(state[f]) if f in ("items", "events") else state[f]).alias(f) for f in fields]))
    first = ends[0]
    same = first["ok"]
    for e in ends[1:]:
        same = same & (e == first)
    return same


def sample_value(spec: Column, seed: Column) -> Column:
    """A plausible value, as JSON, for a property (type, enum, format): the first enum value or a draw by type."""
    number = F.element_at(F.array(*map(F.lit, ("1", "3", "7", "12", "30"))), (F.pmod(seed, F.lit(5)) + 1).cast("int"))
    text = F.when(spec["format"] == "date", F.lit('"2024-01-15"')).when(spec["format"] == "date-time", F.lit('"2024-01-15T09:00:00Z"')).when(spec["format"] == "email", F.lit('"user@example.com"')).otherwise(F.lit('"sample"'))
    chosen = F.element_at(spec["enum"], (F.pmod(seed, F.size(spec["enum"])) + 1).cast("int"))
    return (
        F.when(F.size(spec["enum"]) > 0, F.concat(F.lit('"'), chosen, F.lit('"'))).when(spec["type"].isin("integer", "number"), number).when(spec["type"] == "boolean", F.lit("true"))
        .when(spec["type"] == "array", F.lit("[]")).when(spec["type"] == "object", F.lit("{}")).otherwise(text)
    )


def evaluator_calls(output: Column) -> Column:
    """Calls in the evaluator's layout, ``[{"name": {arguments}}]`` as JSON; an empty list for anything but a call."""
    calls = F.from_json(F.get_json_object(output, "$.calls"), "array<struct<name:string,arguments:string>>")
    one = F.transform(calls, lambda c: F.concat(F.lit('{"'), c["name"], F.lit('":'), F.coalesce(c["arguments"], F.lit("{}")), F.lit("}")))
    called = (F.get_json_object(output, "$.action") == "call") & calls.isNotNull()
    return F.when(called, F.concat(F.lit("["), F.array_join(one, ","), F.lit("]"))).otherwise("[]")


def probe(df: DataFrame) -> DataFrame:
    """Pass rate by kind over fixed probe cases (kind, answer, tools, output as text)."""
    v = df.withColumn("v", parsing.verdicts("answer", "tools", "output"))
    return v.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v.correct").cast("double")), 6).alias("passed"))

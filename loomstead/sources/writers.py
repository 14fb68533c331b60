"""Writers: JSON lines, BFCL prompt and answer files, chat rows, manifests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import ordered
from . import manifests


def json_lines(df: DataFrame, path: str, order: str = "ord") -> None:
    """One object a line, nulls kept, in order within each of the files (range-partitioned by ``order``)."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def question_turns(history: Column, query: Column) -> Column:
    """Messages grouped into turns: a user message opens a new one; the query is the last."""
    every = F.concat(F.coalesce(history, F.expr("cast(array() as array<struct<role:string,content:string>>)")), F.array(F.struct(F.lit("user").alias("role"), query.alias("content"))))
    none = F.expr("cast(array() as array<array<struct<role:string,content:string>>>)")

    def step(acc: Column, m: Column) -> Column:
        opened = F.concat(acc, F.array(F.array(m)))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(m))))
        return F.when((m["role"] == "user") | (F.size(acc) == 0), opened).otherwise(grown)

    return F.aggregate(every, none, step)


def ground_truth(calls: Column) -> Column:
    """Calls in the evaluator's layout as JSON text: each argument's value, of its own type, as a list of one."""
    wrapped = lambda c: F.to_json(F.transform_values(F.from_json(c["arguments"], "map<string,variant>"), lambda _, v: F.array(v)))
    name = lambda c: F.regexp_replace(F.to_json(F.array(c["name"])), r"^\[|\]$", "")
    return F.concat(F.lit("["), F.array_join(F.transform(calls, lambda c: F.concat(F.lit("{"), name(c), F.lit(":"), wrapped(c), F.lit("}"))), ","), F.lit("]"))


def bfcl(examples: DataFrame, path: str) -> None:
    """Prompt and answer files by category; ids count from 0 in input order within a category."""
    numbered = ordered(examples, ["category"], ["ord"], "_number")
    rows = numbered.withColumn("id", F.concat(F.lit("BFCL_v4_"), "category", F.lit("_"), F.col("_number").cast("string")))
    prompts = rows.select("category", "id", question_turns(F.col("history"), F.col("query")).alias("question"), F.col("tools").alias("function"))
    prompts.write.partitionBy("category").mode("overwrite").json(f"{path}/prompt")
    line = F.concat(F.lit('{"id":"'), "id", F.lit('","ground_truth":'), ground_truth(F.col("answer.calls")), F.lit("}"))
    rows.select("category", line.alias("value")).write.partitionBy("category").mode("overwrite").text(f"{path}/answer")


def data_uri(image: Column) -> Column:
    """A data URI of image bytes; the kind by magic bytes, PNG if unknown."""
    head = F.hex(F.substring(image, 1, 12))
    kind = F.when(F.startswith(head, F.lit("89504E47")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(head, F.lit("47494638")), "image/gif").when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp").otherwise("image/png")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(image))


def image_uri(image: Column) -> Column:
    """Where an image is text: data URIs and web addresses as they are, anything else as a path."""
    return F.when(F.startswith(image, F.lit("data:")) | image.rlike("^https?://"), image).otherwise(F.concat(F.lit("file://"), F.regexp_replace(image, "^file://", "")))


def image_of(path: Column, data: Column, raw: Column) -> Column:
    """The image of a row that may have a path, bytes beside a path, or bytes alone: the first that is there."""
    return F.coalesce(image_uri(F.nullif(path, F.lit(""))), data_uri(data), data_uri(raw))


def prompt_row(question: Column, answer: Column, image: Column) -> Column:
    """Prompt, completion and image of a chart question as one JSON object, for table exports."""
    return F.to_json(F.struct(question.alias("prompt"), answer.alias("completion"), image.alias("image")))


def chat_row(image: Column, question: Column, answer: Column, system: str) -> Column:
    """System, user (image and text) and assistant messages as JSON."""
    text = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("image")))
    user = F.concat(F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), image.alias("image"))), text(question))
    return F.to_json(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", text(F.lit(system))), ("user", user), ("assistant", text(answer)))]))


def manifest(folder: str, seed: int, config: dict[str, Any]) -> dict[str, Any]:
    """Digests of a folder's files, with seed, config digest, commit and versions; tasks read the files."""
    found = manifests.digests(SparkSession.builder.getOrCreate(), folder).orderBy("path").collect()  # a row a file
    return manifests.facts(seed, config) | {"files": {r["path"]: r["digest"] for r in found}}


def manifest_errors(folder: str, kept: dict[str, Any]) -> list[str]:
    """Files that changed, vanished or are new since the manifest was made."""
    spark = SparkSession.builder.getOrCreate()
    before = spark.createDataFrame(list(kept["files"].items()), "path string, digest string")
    return [f"{r['status']}: {r['path']}" for r in manifests.compared(before, manifests.digests(spark, folder)).orderBy("status", "path").collect()]

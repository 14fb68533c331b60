"""Lexical, dense and hybrid retrieval over a tool pool, fusion, the decision simulator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import exploded
from ..sources.scratch import Scratch
from . import vectors
from .similarity import small

#: Tools of one matrix, and queries that meet it at a time.
POOL_BLOCK, ASKED_AT_ONCE = 4096, 256

#: Words that carry no topic.
STOP_WORDS = ("the", "a", "an", "to", "for", "of", "in", "on", "and", "or", "with", "get", "set", "by", "from", "is", "it", "you", "me", "my")


def terms(text: Column) -> Column:
    """Lower-cased words of two characters or more without stop words, repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def lexical(queries: DataFrame, tools: DataFrame) -> DataFrame:
    """(query, tool, score): sum of tf * idf over a query's terms, repeats counted; pairs that share a term.

    ``queries`` has (query, text), ``tools`` (tool, text). idf = ln((n + 1) / (df + 0.5)) + 1.
    """
    t = exploded(tools.select("tool", terms(F.col("text")).alias("w")), "w", "term").groupBy("tool", "term").agg(F.count("*").alias("tf"))
    n = tools.count()
    idf = t.groupBy("term").agg((F.log((F.lit(n) + 1) / (F.count("*") + 0.5)) + 1).alias("idf"))
    weights = small(t.join(idf, "term").select("tool", "term", (F.col("tf") * F.col("idf")).alias("weight")))
    q = exploded(queries.select("query", terms(F.col("text")).alias("w")), "w", "term").groupBy("query", "term").agg(F.count("*").alias("times"))
    return q.join(weights, "term").groupBy("query", "tool").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best tools of each query; ties by tool."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "tool")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def scaled(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores of a query mapped to 0..1; 0 where they are all equal."""
    w = Window.partitionBy("query")
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return scores.withColumn(column, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(0.0))


def tool_text(name: Column, description: Column, parameters: Column) -> Column:
    """The words by which a tool is found: its name as it is and in words, its description, its parameters."""
    return F.concat_ws(" ", name, F.replace(name, F.lit("_"), F.lit(" ")), description, F.array_join(parameters, " "))


def dense_text(name: Column, description: Column, parameters: Column) -> Column:
    """A tool in one sentence each, for a vector."""
    return F.concat_ws(". ", name, description, F.concat(F.lit("params: "), F.array_join(parameters, ", ")))


def _fused(lexical_: np.ndarray, dense: np.ndarray, bounds: np.ndarray, weight: float) -> np.ndarray:
    """Both scaled by (least, largest) of a query's scores, then blended; equal scores scale to 0."""
    out = np.zeros_like(dense)
    for part, share, lo, hi in ((lexical_, 1 - weight, bounds[:, 0:1], bounds[:, 1:2]), (dense, weight, bounds[:, 2:3], bounds[:, 3:4])):
        span = hi - lo
        out += share * np.where(span >= 1e-12, (part - lo) / np.where(span >= 1e-12, span, 1), 0)
    return out


def hybrid(queries: DataFrame, tools: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """(query, tool, place, score): the k best tools of each query by scaled lexical and dense scores; ties by tool.

    ``queries`` has (query, text), ``tools`` (tool, text, dense). Every query is compared with the whole pool, block by block
    of ``POOL_BLOCK`` tools, whose matrices go to the tasks; with more blocks than one the scores' bounds are found by a
    pass of their own. A query without a usable vector has dense scores of 0. ``weight`` is the dense one's.
    """
    scratch = Scratch(queries.sparkSession)
    pool = scratch.cut(vectors.text_vectors(tools.select("tool", terms(F.col("text")).alias("terms"), "dense"), "dense"))
    n = pool.count()
    words = exploded(pool.select("tool", "terms"), "terms", "term").groupBy("tool", "term").agg(F.count("*").alias("tf"))
    idf = words.groupBy("term").agg((F.log((F.lit(n) + 1) / (F.count("*") + 0.5)) + 1).alias("idf"))
    weights = scratch.cut(words.join(idf, "term").select("tool", "term", (F.col("tf") * F.col("idf")).alias("weight")))
    asked = scratch.cut(vectors.text_vectors(queries.select("query", terms(F.col("text")).alias("terms"), "text")))
    blocks = max(1, -(-n // POOL_BLOCK))
    kind, tool_kind = asked.schema["query"].dataType.simpleString(), pool.schema["tool"].dataType.simpleString()
    of = lambda df, b: df if blocks == 1 else df.where(F.pmod(F.xxhash64("tool"), F.lit(blocks)) == b)

    def scorer(b: int):
        """(names, function from a batch to pieces of rows with both scores) of a block; about POOL_BLOCK tools on the driver."""
        held = of(pool, b).select("tool", "vector").orderBy("tool").toArrow()
        names, matrix = held.column("tool").combine_chunks(), vectors._units(held.column("vector"))
        place = {t: i for i, t in enumerate(names.to_pylist())}
        found: dict[str, tuple[list, list]] = {}
        for r in of(weights, b).collect():
            at, much = found.setdefault(r["term"], ([], []))
            at.append(place[r["tool"]])
            much.append(r["weight"])
        vocabulary = {t: (np.array(a), np.array(w)) for t, (a, w) in found.items()}

        def scores(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            x, told = vectors._units(batch.column("vector")), batch.column("terms").to_pylist()
            for lo in range(0, len(x), ASKED_AT_ONCE):
                mine = told[lo : lo + ASKED_AT_ONCE]
                lexical_ = np.zeros((len(mine), len(names)))
                for i, these in enumerate(mine):
                    for t in these or ():
                        if t in vocabulary:
                            lexical_[i, vocabulary[t][0]] += vocabulary[t][1]
                yield lo, lexical_, x[lo : lo + ASKED_AT_ONCE] @ matrix.T

        return names, scores

    def bounds(b: int) -> DataFrame:
        _, scores = scorer(b)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, one, two in scores(batch):
                    yield pa.RecordBatch.from_arrays([batch.column("query").slice(lo, len(one)), *(pa.array(v) for v in (one.min(1), one.max(1), two.min(1), two.max(1)))], ["query", "a", "b", "c", "d"])

        return asked.mapInArrow(run, f"query {kind}, a double, b double, c double, d double")

    def best(b: int, told: DataFrame) -> DataFrame:
        names, scores = scorer(b)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, one, two in scores(batch):
                    limits = np.array([one.min(1), one.max(1), two.min(1), two.max(1)]).T if blocks == 1 else np.array([batch.column(c).to_numpy()[lo : lo + len(one)] for c in "abcd"]).T
                    fused = np.round(_fused(one, two, limits, weight), 9)
                    top = np.argsort(-fused, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(top)), top.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column("query").slice(lo, len(top)).take(pa.array(row)), names.take(pa.array(top.ravel())), pa.array(fused[row, top.ravel()])], ["query", "tool", "score"])

        return told.mapInArrow(run, f"query {kind}, tool {tool_kind}, score double")

    if not n:
        return asked.limit(0).select("query", F.lit(None).cast(tool_kind).alias("tool"), F.lit(0).alias("place"), F.lit(0.0).alias("score"))
    told = asked
    if blocks > 1:
        every = bounds(0)
        for b in range(1, blocks):
            every = every.unionByName(bounds(b))
        told = scratch.cut(asked.join(every.groupBy("query").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d")), "query"))
    out = best(0, told)
    for b in range(1, blocks):
        out = out.unionByName(best(b, told))
    return top_k(out, k).select("query", "tool", "place", "score")


def decide(overlaps: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, action, tool): no shared word refuses, a tie at the top clarifies, a missing requirement clarifies, else call.

    ``overlaps`` has (query, tool, score, complete) of pairs with a shared word.
    """
    w = Window.partitionBy("query")
    top = overlaps.withColumn("best", F.max("score").over(w)).where("score = best").groupBy("query").agg(F.count("*").alias("n"), F.min("tool").alias("tool"), F.max(F.col("complete").cast("int")).alias("complete"))
    out = queries.select("query").join(top, "query", "left")
    action = F.when(F.col("n").isNull(), "refuse").when((F.col("n") > 1) | (F.col("complete") == 0), "clarify").otherwise("call")
    return out.select("query", action.alias("action"), F.when(action == "call", F.col("tool")).alias("tool"))

"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources share a budget of words by weight; a source gives at most ``cap`` times
its own words and what it cannot give is shared again by weight. Within a source
every document has the same expected number of copies, target over source size.
The expected copies are summed up along the documents, one random offset is added per
source, and a document is emitted once for every integer boundary its part of the sum
crosses: floor or ceiling of its expectation, never more than ``cap`` copies where ``cap``
is an integer.

Documents of a source stand by size, every second one on the way up and the others on
the way down. Every stretch of the draw then meets short and long documents alike, and
because the order ends where it begins, the offset hardly changes how many words are drawn.

Texts are read once: what the draw needs of a document is written as a narrow table.

Defined results: a null text has size 0 and may still be drawn (it adds no words);
a source whose documents are all empty has target 0; null sources form one source,
the last; equal rows are separate documents; an empty table gives an empty table;
columns of the caller with names used here stay as they are in ``sample``.
The draw depends only on doc_id, text size, source and seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranking import positions
from .staging import Masked, Stage

#: Weights in turn for sources in code-point order.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, stage: Stage, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows): by weight, none above ``cap`` times its size.

    Sources are numbered in one task, one narrow row each. Every round fixes the sources that cannot give their
    share and shares again; only sums come to the driver.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    table = stage.cut(sources.withColumn("weight", turn))
    left = budget = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    most, part, open_ = F.col("source_size") * F.lit(float(cap)), F.lit(0.0), None
    while True:
        full = part > most
        got = table.agg(F.sum(F.when(full, most).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if got["open"] == open_ or not got["open"]:
            break
        left, open_ = budget - got["taken"], got["open"]
        part = F.lit(left) * F.col("weight") / F.lit(open_)
    return table.select("source", "source_size", "rows", F.least(part, most).alias("target"))


def _narrow(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tie"))


def draw(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, tie, source_size, target, copies) of every row of ``docs``."""
    stage = Stage(docs.sparkSession, "mixing")
    narrow = stage.cut(_narrow(docs))
    per = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = stage.cut(targets(per, stage, weights, share, cap).withColumnRenamed("source", "plan_source"))
    ranked = positions(narrow, "source", ["size", "doc_id", "tie"], stage)
    # One row a source; Spark broadcasts it while it is small and splits large sources' joins otherwise.
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    half = F.floor(F.col("position") / 2)
    place = F.when(F.col("position") % 2 == 0, half).otherwise(F.col("rows") - 1 - half).cast("double")
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    offset = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    upto = lambda i: F.floor(i * each + offset)
    return joined.withColumn("copies", (upto(place + 1) - upto(place)).cast("long")).drop("position", "rows")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it was drawn, with the columns it has.

    Drawn documents are met by doc_id and a hash of the text; rows alike in both share their copies in any order.
    """
    plain = Masked(docs, ("doc_id", "text", "source"))
    key = lambda tie: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), tie.cast("string"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    drawn = draw(plain.df, **options).select(key(F.col("tie")).alias("_key"), "copies")
    per = drawn.groupBy("_key").agg(F.max("copies").alias("_most"), F.array_sort(F.collect_list("copies")).alias("_copies")).where("_most > 0")
    met = plain.df.withColumn("_key", key(F.xxhash64("text"))).join(per, "_key")
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_most"))
    counted = met.withColumn("_n", F.element_at("_copies", turn))
    return plain.back(counted.where("_n > 0").withColumn("_i", F.explode_outer(F.sequence(F.lit(1).cast("long"), F.col("_n")))))

"""Splits, samples, slices, curricula: operators whose order comes from explicit columns or counter draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import draw
from .ordering import ordered


def group_split(keys: DataFrame, key: str, ratios: tuple[float, float] = (0.8, 0.1), seed: str = "split") -> DataFrame:
    """(key, split): whole groups to train, val and test by the order of a seeded digest.

    Keys are one row a group. Counts are exact: floor(n * ratio) groups each, the rest to test.
    A group's rank is its rank in one of 256 digest ranges plus the groups of the ranges
    before, so no task ever sorts all groups.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    marked = keys.select(key).distinct().withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 2))
    sizes = marked.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = marked.join(F.broadcast(starts), "_b").withColumn("_k", F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy("_d", key)))
    cut = F.floor(F.col("_all") * ratios[0])
    return ranked.select(key, F.when(F.col("_k") <= cut, "train").when(F.col("_k") <= cut + F.floor(F.col("_all") * ratios[1]), "val").otherwise("test").alias("split"))


def route_by_names(examples: DataFrame, names: DataFrame, frac: float, seed: str = "novel") -> DataFrame:
    """(id, route) for examples (id, name rows): test_novel if all names are held out, train if none, else dropped."""
    held = group_split(names.distinct(), "name", (frac, 0.0), seed).where("split = 'train'").select("name", F.lit(1).alias("_held"))
    flags = examples.join(held, "name", "left").groupBy("id").agg(F.count("_held").alias("h"), F.count("*").alias("n"))
    return flags.select("id", F.when(F.col("h") == F.col("n"), "test_novel").when(F.col("h") == 0, "train").otherwise("dropped").alias("route"))


def slice_sizes(base: Column, ratios: dict[str, float]) -> list[tuple[str, Column]]:
    """Rows of each slice when slices and base share one denominator."""
    if sum(ratios.values()) >= 1:
        raise ValueError("slice ratios must sum to less than 1")
    total = base / (1 - sum(ratios.values()))
    return [(name, F.round(total * r)) for name, r in ratios.items()]


def difficulty(kind: Column, n_tools: Column, n_calls: Column, n_args: Column, drift: Column, trap: Column, multi_turn: Column, foreign: Column) -> Column:
    """Difficulty of an example: abstention, tools on offer, calls, arguments, and slice marks."""
    flag = lambda c, w: F.when(c, w).otherwise(0)
    calls = F.when(kind == "tool_call", F.greatest(n_calls - 1, F.lit(0)) * 2 + F.least(n_args, F.lit(3))).otherwise(0)
    return (F.lit(1) + flag(kind.isin("refuse", "clarify"), 2) + F.least(F.floor(n_tools / 2), F.lit(3)) + calls + flag(drift, 2) + flag(trap, 2) + flag(multi_turn, 1) + flag(foreign, 1)).cast("long")


def band(score: Column) -> Column:
    return F.when(score <= 3, "easy").when(score <= 6, "medium").otherwise("hard")


def quality(n_words: Column, n_values: Column, all_real: Column, grounding: Column, valid: Column) -> Column:
    """Cheap quality of an example between 0 and 1; 0 where the answer is not valid."""
    length = F.when(n_words.between(4, 60), 0.2).when(n_words >= 3, 0.1).otherwise(0.0)
    arguments = F.when((n_values > 0) & all_real, 0.25).when(n_values > 0, 0.1).otherwise(0.0)
    words = F.when(grounding >= 2, 0.2).when(grounding == 1, 0.1).otherwise(0.0)
    return F.when(valid, F.least(F.lit(0.35) + length + arguments + words, F.lit(1.0))).otherwise(0.0)


#: Texts that stand for a missing argument.
PLACEHOLDERS = ("", "string", "value", "none", "null", "n/a", "todo", "xxx", "example")


def real_value(value: Column) -> Column:
    return value.isNotNull() & ~F.lower(F.trim(value)).isin(*PLACEHOLDERS)


def top_fraction(df: DataFrame, frac: float, score: str, key: str) -> DataFrame:
    """The first max(1, floor(n * frac)) rows by descending ``score``, then ``key``; everything for frac >= 1."""
    if frac >= 1:
        return df
    placed = ordered(df.withColumn("_down", -F.col(score)), [], ["_down", key], "_place")
    return placed.where(F.col("_place") < max(1, int(df.count() * frac))).drop("_down", "_place")


def nested_subsets(df: DataFrame, key: str, fracs: tuple[float, ...], seed: str = "ablation") -> DataFrame:
    """Rows with the fractions whose subset they are in; smaller subsets are part of larger ones."""
    n = df.count()
    placed = ordered(df.select(key).withColumn("_d", draw(seed, F.col(key))), [], ["_d", key], "_place")
    inside = F.filter(F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(max(1, int(n * f))).alias("n")) for f in sorted(fracs)]), lambda x: F.col("_place") < x["n"])
    return placed.withColumn("_x", F.explode_outer(inside)).where("_x IS NOT NULL").select(key, F.col("_x.f").alias("fraction"))


def round_robin(df: DataFrame, buckets: list[str], order: list[str], n: int) -> DataFrame:
    """n rows that take turns over buckets."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(*buckets).orderBy(*order)))
    return ranked.orderBy("turn", *buckets, *order).limit(n)

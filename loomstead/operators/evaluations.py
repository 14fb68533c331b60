"""Evaluation over verdicts: shares with resampled errors, languages against their matched twins, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import statistics as stats

#: The order in which a report shows conditions; others follow by name.
SHOWN_FIRST = ("simple", "multiple", "parallel", "irrelevance", "clarify", "multi_turn", "agentic")


def display_order(condition: Column) -> list[Column]:
    """Sort keys of a report's conditions: the fixed ones in their order, then the rest by name."""
    place = F.array_position(F.array(*map(F.lit, SHOWN_FIRST)), condition)
    return [F.when(place > 0, place).otherwise(len(SHOWN_FIRST) + 1), condition]


def twins_only(rows: DataFrame) -> DataFrame:
    """Rows of the multilingual slice: of that source, with a pair and a language."""
    meta = F.col("meta")
    return rows.where((meta["source"] == "multilingual") & meta["pair_id"].isNotNull() & meta["lang"].isNotNull())


def shares(rows: DataFrame, group: str, bit: str, rounds: int, seed: str) -> DataFrame:
    """(group, n, accuracy, lo, hi, se): the share of a bit (0 or 1), with its resampled interval and error."""
    exact = rows.groupBy(group).agg(F.count(bit).alias("n"), F.avg(bit).alias("accuracy"))
    spread = stats.interval(stats.resampled(rows.where(F.col(bit).isNotNull()).select(group, bit), group, [bit], rounds, seed), group, bit, rounds)
    told = spread.select(F.col(group).alias("_g"), "lo", "hi", "se")
    return exact.join(told, F.col(group).eqNullSafe(F.col("_g"))).select(group, "n", "accuracy", "lo", "hi", "se")


def last_bits(rows: DataFrame, order: list[str]) -> DataFrame:
    """(pair_id, lang, ok): the last row of each pair and language by ``order``."""
    return rows.groupBy("pair_id", "lang").agg(F.max_by("ok", F.struct(*order)).alias("ok"))


def matched_deltas(bits: DataFrame, rounds: int, seed: str, base: str = "en") -> DataFrame:
    """(lang, pairs, delta, lo, hi, p) of (pair_id, lang, ok): each language against the base one on pairs that have both.

    The same pairs are drawn for both sides; p is the share of resampled deltas that are not above 0.
    """
    reference = bits.where(F.col("lang") == base).select("pair_id", F.col("ok").alias("base"))
    both = bits.where(F.col("lang") != base).join(reference, "pair_id").select("lang", "base", F.col("ok").alias("ft"))
    exact = both.groupBy("lang").agg(F.count("*").alias("pairs"), (F.avg("ft") - F.avg("base")).alias("delta"))
    means = stats.resampled(both, "lang", ["base", "ft"], rounds, seed).withColumn("gap", F.col("ft") - F.col("base"))
    return exact.join(stats.interval(means, "lang", "gap", rounds).select("lang", "lo", "hi", "p"), "lang")


def significance(base: Column, base_lo: Column, base_hi: Column, tuned: Column, tuned_lo: Column, tuned_hi: Column, gap: Column, lo: Column, hi: Column, p: Column, mcnemar: Column) -> Column:
    """One line of a report: both shares with their intervals, the gap, both p values, and whether the gap is significant."""
    share = lambda m, a, b: F.format_string("%.1f%% [%.1f, %.1f]", 100 * m, 100 * a, 100 * b)
    told = F.format_string("gap %+.1fpp [%+.1f, %+.1f], bootstrap p %.3f, McNemar p %.3f", 100 * gap, 100 * lo, 100 * hi, p, mcnemar)
    return F.concat(F.lit("base "), share(base, base_lo, base_hi), F.lit("; tuned "), share(tuned, tuned_lo, tuned_hi), F.lit("; "), told, F.lit("; "), F.when(p < 0.05, "significant").otherwise("not significant"))

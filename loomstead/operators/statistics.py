"""Resampling and exact tests on bits; counts are aggregated before anything is resampled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import draw

#: Terms that ``mcnemar`` sums up at most, and the variance up to which a binomial draw walks its distribution.
EXACT_TERMS, WALKED = 10_000, 100

#: What each category weighs in an overall score; ``live`` is never measured offline.
CATEGORY_WEIGHTS = {"agentic": 0.40, "multi_turn": 0.30, "simple": 0.0333, "multiple": 0.0333, "parallel": 0.0334, "irrelevance": 0.05, "clarify": 0.05, "live": 0.10}


def weighted(accuracies: DataFrame, weights: dict[str, float] = CATEGORY_WEIGHTS) -> DataFrame:
    """One row (weighted): accuracies (category, accuracy) by weight, renormalised over those present; null if none is."""
    table = accuracies.sparkSession.createDataFrame(list(weights.items()), "category string, weight double")
    both = accuracies.join(F.broadcast(table), "category")  # a fixed short table
    return both.agg((F.sum(F.col("weight") * F.col("accuracy")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("weighted"))


def _upper_tail(x: Column) -> Column:
    """erfc of x >= 0: its Taylor series below 2.5, else its continued fraction from the 60th term back."""
    square = x * x
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda acc, k: F.struct((-acc["t"] * square / k).alias("t"), (acc["s"] - acc["t"] * square / k / (2 * k + 1)).alias("s")))["s"]
    under = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / F.lit(2.0) / acc)
    root = math.sqrt(math.pi)
    return F.when(x < 2.5, 1 - series * (2 / root)).otherwise(F.exp(-square) / under / root)


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided p of b against c discordant pairs; 1 without any. No query takes it: ``exact_mcnemar`` has no switch.

    Exact up to ``EXACT_TERMS`` of the rarer kind, in one pass in which each binomial term follows from the one before,
    as a logarithm; beyond, the normal tail with continuity correction, whose error is below 1e-4 there.
    """
    b, c = b.cast("long"), c.cast("long")
    n, low = (b + c).cast("double"), F.least(b, c)
    none = -n * F.log(F.lit(2.0))
    step = lambda acc, i: F.struct((acc["t"] + F.log((n - i + 1) / i)).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1) / i))).alias("s"))
    some = F.when((low > 0) & (low <= EXACT_TERMS), F.sequence(F.lit(1).cast("long"), F.least(low, F.lit(EXACT_TERMS).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    terms = F.aggregate(some, F.struct(none.alias("t"), F.exp(none).alias("s")), step)["s"]
    normal = _upper_tail(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double") / F.sqrt(2 * n))
    return F.when(n == 0, 1.0).when(low > EXACT_TERMS, F.least(F.lit(1.0), normal)).otherwise(F.least(F.lit(1.0), 2 * terms))


def exact_mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c discordant pairs; 1 without any. One formula, whatever the counts.

    Binomial terms follow from one another, downwards from the middle, which counts as 1: p is the part up to the rarer
    kind's count in the sum of all. A term k below the middle is at most exp(-2 k^2 / (n + 1)), so those that aren't
    walked are 0 as doubles, and a walk is about 19 times the root of n.
    """
    b, c = b.cast("long"), c.cast("long")
    n, low = b + c, F.least(b, c)
    middle = F.floor(n / F.lit(2)).cast("long")
    last = F.greatest(F.lit(0).cast("long"), middle - F.ceil(F.sqrt((n + 1) * F.lit(373.0))))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("tail"))
    step = lambda acc, i: F.struct((acc["t"] * i / (n - i + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s"), (acc["tail"] + F.when(i <= low, acc["t"]).otherwise(0.0)).alias("tail"))
    summed = lambda acc: F.least(F.lit(1.0), 2 * acc["tail"] / (2 * acc["s"] - F.when(n % 2 == 0, 1.0).otherwise(0.0)))
    return F.aggregate(F.sequence(middle, last, F.lit(-1).cast("long")), zero, step, summed)


def pass_hat_k(n: Column, c: Column, k: int) -> Column:
    """Probability that k draws without replacement from n trials with c successes all succeed; null if n < k."""
    product = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(c - i, F.lit(0)) / (n - i))
    return F.when(n >= k, product)


def uniform(*parts: Column | str | int) -> Column:
    """A number between 0 and 1, never either, from a counter-like key."""
    return (draw(*parts) + F.lit(0.5)) / F.lit(2.0**32)


def binomial(n: Column, p: Column, u: Column, w: Column) -> Column:
    """A binomial draw by the inverse distribution function at ``u``; p is between 0 and 1 and neither.

    With a variance up to ``WALKED`` the distribution is summed up (to 12 deviations beyond the mean); with a larger one
    it is the normal quantile (``u`` and ``w`` by Box and Muller) with a correction for skew, within 1 of the exact one.
    """
    few = F.least(p, 1 - p)
    rare, spread = n * few, F.sqrt(n * p * (1 - p))
    at = F.when(p > 0.5, 1 - u).otherwise(u)
    last = F.least(n, F.ceil(rare + 12 * F.least(spread, F.lit(math.sqrt(WALKED))) + 30)).cast("int")
    zero = F.struct(F.exp(n * F.log(1 - few)).alias("t"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("k"))
    step = lambda acc, k: F.struct((acc["t"] * (n - k) / (k + 1) * few / (1 - few)).alias("t"), (acc["s"] + acc["t"]).alias("s"), (acc["k"] + (acc["s"] + acc["t"] < at).cast("long")).alias("k"))
    walked = F.when(n * p * (1 - p) <= WALKED, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    exact = F.least(F.aggregate(walked, zero, step)["k"], n.cast("long"))
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w)
    near = F.greatest(F.lit(0.0), F.least(n.cast("double"), F.floor(n * p + spread * z + (1 - 2 * p) * (z * z - 1) / 6 + 0.5))).cast("long")
    return F.when(n * p * (1 - p) > WALKED, near).when(p > 0.5, n.cast("long") - exact).otherwise(exact)


def resampled(bits: DataFrame, group: str, columns: list[str], rounds: int, seed: str) -> DataFrame:
    """(group, round, columns...): means over ``rounds`` resamples of each group.

    Bits take few distinct values, so a group is a handful of cells (one a distinct combination, with its size), and a
    resample is how often each cell is drawn: a multinomial, as a chain of binomials, each among what earlier cells
    left. The cost is rounds by cells, whatever the number of rows.
    """
    cells = bits.groupBy(group, *columns).agg(F.count("*").alias("size"))
    table = cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*columns, "size"))).alias("cells"), F.sum("size").alias("n"))
    return resampled_cells(table, group, columns, rounds, seed)


def resampled_cells(table: DataFrame, group: str, columns: list[str], rounds: int, seed: str) -> DataFrame:
    """``resampled`` of groups given as (group, cells: array of (columns..., size), n)."""
    each = table.withColumn("round", F.explode_outer(F.sequence(F.lit(0), F.lit(rounds - 1))))
    numbered = F.transform("cells", lambda c, i: F.struct(i.alias("i"), c["size"].alias("size"), *[c[x].cast("double").alias(x) for x in columns]))
    zero = F.struct(F.col("n").alias("draws"), F.col("n").alias("rows"), *[F.lit(0.0).alias(x) for x in columns])

    def step(acc: Column, c: Column) -> Column:
        key = (F.coalesce(F.col(group).cast("string"), F.lit("")), F.col("round"), c["i"])
        some = binomial(acc["draws"], c["size"] / acc["rows"], uniform(seed, *key), uniform(f"{seed}'", *key))
        taken = F.when(c["size"] == acc["rows"], acc["draws"]).when(acc["draws"] == 0, 0).otherwise(some)
        return F.struct((acc["draws"] - taken).alias("draws"), (acc["rows"] - c["size"]).alias("rows"), *[(acc[x] + taken * c[x]).alias(x) for x in columns])

    return each.withColumn("_s", F.aggregate(numbered, zero, step)).select(group, "round", *[(F.col(f"_s.{x}") / F.col("n")).alias(x) for x in columns])


def interval(means: DataFrame, group: str, column: str, rounds: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of resample means: sorted, at floor(alpha/2 B) and floor((1 - alpha/2) B), 0-based."""
    lo, hi = int(alpha / 2 * rounds), min(int((1 - alpha / 2) * rounds), rounds - 1)
    ordered = F.array_sort(F.collect_list(column))
    return means.groupBy(group).agg(F.element_at(ordered, lo + 1).alias("lo"), F.element_at(ordered, hi + 1).alias("hi"), F.stddev_pop(column).alias("se"), F.avg((F.col(column) <= 0).cast("double")).alias("p"))

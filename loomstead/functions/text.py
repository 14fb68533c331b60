"""Text expressions: tokens, word shingles, normal forms, sampling numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; other scripts give none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def shingles(words: Column, k: int) -> Column:
    """Distinct runs of k words; the distinct words where there are fewer than k.

    Shifted copies are zipped, so no lambda refers to ``words``: a lambda that did would compute
    it again for each element once projections are merged.
    """
    n = F.size(words)
    shifted = [F.slice(words, j + 1, F.greatest(n - (k - 1), F.lit(0))).alias(f"w{j}") for j in range(k)]
    runs = F.transform(F.arrays_zip(*shifted), lambda x: F.concat_ws(" ", *[x[f"w{j}"] for j in range(k)]))
    return F.array_distinct(F.when(n >= k, runs).otherwise(words))


def exploded(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row for each element; rows of empty arrays are gone.

    ``explode_outer`` and an explicit filter: with plain ``explode`` the optimizer infers a size
    filter and inlines the array's computation into it, element by element.
    """
    return df.withColumn(name, F.explode_outer(column)).where(F.col(name).isNotNull()).drop(column)


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition on computed columns holds.

    The condition is generated, not filtered: a filter is pushed below the projections that compute its columns,
    with all of their expressions written out in it as often as they refer to each other.
    """
    return df.withColumn("_kept", F.explode_outer(F.array(condition))).where("_kept").drop("_kept")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; inside a lambda every other mention of it would compute it again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapsed(text: Column) -> Column:
    """Lower case, trimmed, inner white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def draw(*parts: Column | str | int) -> Column:
    """A 32-bit number from a counter-like key: the same key gives the same draw everywhere."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def without_thinking(text: Column) -> Column:
    """What follows the first ``</think>`` after the first ``<think>``; null if it never closes."""
    low = F.lower(text)
    opens = F.instr(low, "<think>")
    tail = F.substr(low, opens)
    shut = F.instr(tail, "</think>")
    return F.when(opens == 0, text).when(shut == 0, F.lit(None)).otherwise(F.substr(text, opens + shut + 7))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys, numbers in one form."""
    return F.to_json(F.parse_json(json))

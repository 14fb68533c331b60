"""Distributed positions within groups: no group is ever sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .staging import Stage, fresh


def positions(df: DataFrame, group: str, order: list[str], stage: Stage) -> DataFrame:
    """Adds ``position``: 0, 1, ... within ``group`` by ``order``; nulls are a group of their own.

    Rows are dealt by ranges of (group, order) and written with the number of their range, so a group with a
    third of all rows lies in many ranges. Ranges are counted (partial aggregation, one row a group and range),
    their offsets are running sums over those counts, and only rows of one range are sorted together. Ranges
    of one group follow each other, so where they are cut doesn't change a position. ``df`` should be narrow
    and cheap to read: its bounds are sampled from it.
    """
    part, before, inside = (fresh(df.columns, name) for name in ("_range", "_before", "_inside"))
    dealt = stage.cut(df.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(group, part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col(part).alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before))
    ranked = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(group, part).orderBy(*order)))
    joined = ranked.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col(part) == F.col("_r")))
    return joined.withColumn("position", F.col(before) + F.col(inside) - 1).drop(part, before, inside, "_g", "_r")

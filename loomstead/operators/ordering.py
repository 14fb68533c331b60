"""Positions in one order, or in one for each group, without a task that sorts it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import Scratch


def ordered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 by ``order``, within ``groups`` if there are any.

    Rows are dealt by ranges of (groups, order) and written with the number of their range; ranges are counted,
    and a row's number is its place in its range plus the counts of its group's earlier ranges. A group with a
    third of all rows lies in many ranges.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in (*groups, *order)]).withColumn("_range", F.spark_partition_id())
    dealt = Scratch(df.sparkSession).cut(dealt)
    counts = dealt.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order)) - 1
    met = F.col("_range") == F.col("_r")
    for i, c in enumerate(groups):
        met = met & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    numbered = dealt.withColumn("_inside", inside).join(starts, met)
    return numbered.withColumn(name, F.col("_start") + F.col("_inside")).select(*df.columns, name)

"""Structured Streaming forms of the curation operators (an extension: the batch operators are the contract)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import collapsed


def first_of_each(stream: DataFrame, text_col: str, time_col: str, late: str = "1 hour") -> DataFrame:
    """Rows whose normalised text was not seen within the watermark; state is bounded by ``late``."""
    keyed = stream.withWatermark(time_col, late).withColumn("_key", F.sha2(collapsed(F.col(text_col)), 256))
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, time_col: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and distinct-key counts of each time window; a window closes when the watermark passes it."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def guard(stream: DataFrame, valid: Column, name: str = "guard") -> DataFrame:
    """Only valid rows; how many were dropped is observed, not collected."""
    return stream.observe(name, F.count_if(valid).alias("kept"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("dropped")).where(valid)

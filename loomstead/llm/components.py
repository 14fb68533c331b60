"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import Stage


def connected_components(edges: DataFrame, stage: Stage, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without edges are absent.

    Each round is a grouped minimum and an equi-join; the edge table never grows
    beyond its first size, and the number of rounds grows with the logarithm of
    the longest path. Rounds are cut by written tables, superseded ones deleted.
    """
    now = stage.cut(
        edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u")).where("v <> u").distinct(),
        narrow=True,
    )
    before = None
    while True:
        sides = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        # A written table, so that a hub's edges can be split over tasks in the join.
        least = stage.cut(sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), narrow=True)
        large = sides.where("v > u").join(least, "u").select(F.col("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode_outer(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        new = stage.cut(small.select("e.v", "e.u").where("v <> u").distinct(), narrow=True)
        print_of = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        stage.drop(now)
        stage.drop(least)
        now = new
        if before == tuple(print_of):
            break
        before = tuple(print_of)
    nodes = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return nodes.union(roots)

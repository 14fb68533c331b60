"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Equal texts form a group. Groups are placed from the largest down, each on the shard where
the dot product of its (bytes, tokens, rows) vector with the shard's residual capacity is
highest, among the shards whose residual bytes it fits in (among all, where it fits in
none). Capacities are equal shares of the totals, bytes with ``SLACK`` on top, so the law
``bytes`` holds: sizes are nearly equal, tokens and rows as near as that leaves room for.

Two bounded reductions let one driver place any number of groups:

* a group above ``1 / HEAVY`` of a shard in any dimension is an item of its own (there are
  at most ``3 * shards * HEAVY``); smaller groups are dealt by hash to ``BUNDLES`` bundles,
  which are placed like groups;
* a group above a whole shard in any dimension cannot stay whole and is cut by a hash of
  doc_id into pieces of at most about ``1 / PIECES`` of a shard. All other groups stay whole.

Defined results: null and empty texts have size 8 and form one group each; equal rows
each get a slot; an empty table gives an empty table; all other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .ranking import positions
from .staging import Stage

BUNDLES = 8192
HEAVY = 128
PIECES = 8
#: Of a shard's equal share of bytes: how much a shard may hold above it while others have room.
SLACK = 0.002


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: largest first, to the highest dot product with what is left.

    The first dimension is the one whose capacity binds; ties go to the lower shard.
    """
    unit = vectors / np.maximum(vectors.sum(0), 1) * shards
    free = np.ones((shards, vectors.shape[1]))
    placed = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(unit)), -unit.sum(1), -unit.max(1))):
        fits = free[:, 0] + SLACK >= unit[i, 0]
        score = free @ unit[i]
        placed[i] = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        free[placed[i]] -= unit[i]
    return placed


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document."""
    spark = docs.sparkSession
    stage = Stage(spark, "sharding")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.sha2(F.when(F.col("text").isNull(), "null").otherwise(F.concat(F.lit("="), text)), 256).alias("digest"),
    )
    narrow = stage.cut(narrow)
    total = narrow.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return narrow.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = F.greatest(*(F.col(c) * shards / max(1, total[c]) for c in ("size", "tokens", "rows")))
    groups = narrow.groupBy("digest").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    pieces = F.when(share > 1, F.ceil(share * PIECES)).otherwise(1).cast("int")
    heavy = groups.where(share * HEAVY > 1).select("digest", pieces.alias("pieces"))
    named = narrow.join(F.broadcast(heavy), "digest", "left")  # at most 3 * shards * HEAVY rows
    piece = F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1)))
    bundle = F.pmod(F.conv(F.substring("digest", 1, 12), 16, 10).cast("long"), F.lit(BUNDLES))
    named = named.withColumn("item", F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), bundle.cast("string"))).otherwise(F.concat_ws("#", "digest", piece.cast("string"))))
    items = named.groupBy("item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("item").collect()
    placed = pack(np.array([[r["size"], r["tokens"], r["rows"]] for r in items], float), shards)
    plan = spark.createDataFrame([(r["item"], int(s)) for r, s in zip(items, placed, strict=True)], "item string, shard int")
    out = named.join(F.broadcast(plan), "item").select("doc_id", "size", "text_crc32", "shard", F.xxhash64("digest").alias("tie"))
    out = positions(out, "shard", ["doc_id", "tie"], stage)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

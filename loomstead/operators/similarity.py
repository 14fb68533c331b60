"""Decontamination, near-duplicate pairs, greedy keep-first selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.hashing import hashed_shingles
from ..functions.text import exploded, shingles, tokens
from ..sources.scratch import Scratch
from .ordering import ordered

#: Tables up to this many rows may be sent to every executor.
BROADCAST_ROWS = 200_000
#: Classes of the first stretch that keep-first decides by their links.
FEW = 2000
#: Pairs in the buckets of a stretch for each row of all buckets.
CROWD = 8
#: Tables of rounds that are read side by side; then they are written as one.
GONE_TABLES = 32


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is known to be small; otherwise as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer partitions (a single small file); large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shingle_table(df: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(id, n, shingle): one row for each distinct shingle, with the size of the set."""
    cut = spread(df).select(F.col(id_col).alias("id"), shingles(tokens(F.col(text_col)), k).alias("s"))
    return exploded(cut.withColumn("n", F.size("s")), "s", "shingle")


def overlap(queries: DataFrame, probes: DataFrame, k: int = 3) -> DataFrame:
    """(id, probe, n, m, common) of all pairs that share a shingle; an equi-join on shingles."""
    left = shingle_table(queries, "id", "text", k)
    right = small(shingle_table(probes, "id", "text", k).select(F.col("id").alias("probe"), F.col("n").alias("m"), "shingle"))
    return left.join(right, "shingle").groupBy("id", "probe", "n", "m").agg(F.count("*").alias("common"))


def decontaminate(queries: DataFrame, probes: DataFrame, k: int = 3) -> DataFrame:
    """(id, probe, score): each query's best probe by Jaccard similarity; null and 0 if none shares a shingle."""
    scored = overlap(queries, probes, k).withColumn("score", F.col("common") / (F.col("n") + F.col("m") - F.col("common")))
    best = scored.groupBy("id").agg(F.max_by(F.struct("probe", "score"), F.struct("score", -F.col("probe"))).alias("b"))
    return queries.select("id").join(best, "id", "left").select("id", F.col("b.probe").alias("probe"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


#: Shingles that are signed at a time.
SIGNED_AT_ONCE = 1 << 9


def _bands(flat: np.ndarray, sizes: np.ndarray, hashes: int, rows: int) -> np.ndarray:
    """[set, band] of the MinHash bands of sets end to end, none of them empty."""
    rng = np.random.default_rng(23)
    a = rng.integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, hashes, dtype=np.uint64)
    ends = np.cumsum(sizes)
    mixed = np.array([1, 1000003, 998244353, 19260817], np.uint64)[:rows]
    out = np.zeros((len(sizes), hashes // rows), np.int64)
    room = np.empty((SIGNED_AT_ONCE, hashes), np.uint64)

    def spun(x: np.ndarray) -> np.ndarray:
        values = np.multiply(x[:, None], a, out=room[: len(x)])
        values += b
        return values

    lo = 0
    while lo < len(sizes):
        begin = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + SIGNED_AT_ONCE, "right")))
        if hi == lo + 1:  # one set, however large
            mine = flat[begin : int(ends[lo])]
            sign = np.minimum.reduce([spun(mine[p : p + SIGNED_AT_ONCE]).min(0) for p in range(0, len(mine), SIGNED_AT_ONCE)])[None, :]
        else:
            sign = np.minimum.reduceat(spun(flat[begin : int(ends[hi - 1])]), np.r_[0, ends[lo : hi - 1] - begin], axis=0)
        # The least of the upper halves is the upper half of the least.
        out[lo:hi] = ((sign >> np.uint64(32)).reshape(hi - lo, -1, rows) * mixed).sum(2, dtype=np.uint64).view(np.int64) * 64 + np.arange(hashes // rows)
        lo = hi
    return out


def _signed(sets: DataFrame, hashes: int = 128, rows: int = 4) -> DataFrame:
    """``sets`` with ``bands`` in place of ``h``: the MinHash bands of every set, none of an empty one."""
    others = [c for c in sets.columns if c != "h"]

    def run(batches):
        for batch in batches:
            held = batch.column(len(others))
            sizes = np.asarray(held.value_lengths().fill_null(0), np.int64)
            full = np.flatnonzero(sizes)
            found = _bands(held.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), sizes[full], hashes, rows)
            ends = np.cumsum(np.where(sizes > 0, hashes // rows, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), lists], [*others, "bands"])

    kept = sets.select(*others, "h")
    return kept.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1]) + "bands array<bigint>")


def _spread_bits(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers, every bit of which depends on all of the given ones."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def signatures(docs: DataFrame, k: int = 3, hashes: int = 128, rows: int = 4) -> DataFrame:
    """(id, grp, n, d1, d2, bands) of the rows of ``docs`` (id, grp, text) with words: size, digests and MinHash bands of the shingle set.

    Shingles are computed once: what is made of them is made in the function that gets them.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("id", "grp")}

    def run(batches):
        for batch in batches:
            for lo, flat, sizes in hashed_shingles(batch.column(2), k):
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                mine = sizes[full]
                found = _bands(flat, mine, hashes, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                take = pa.array(lo + full)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(mine), *_digests(flat, mine), lists], ["id", "grp", "n", "d1", "d2", "bands"])

    return spread(docs).select("id", "grp", F.lower("text").alias("text")).mapInArrow(run, f"id {kinds['id']}, grp {kinds['grp']}, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _digests(flat: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """Two digests of each of the sets end to end, none of them empty."""
    starts = np.cumsum(sizes) - sizes
    return [pa.array(np.add.reduceat(_spread_bits(flat, salt), starts).view(np.int64)) for salt in (0x51ED27, 0xC0FFEE)]


def shingle_sets(docs: DataFrame, k: int = 3) -> DataFrame:
    """(n, d1, d2, h) beside the other columns of ``docs`` (text, ...) with words: size, digests and sorted hashes of each text's shingle set."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for lo, flat, sizes in hashed_shingles(batch.column(len(others)), k):
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                mine, take = sizes[full], pa.array(lo + full)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(mine)].astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(others))), pa.array(mine), *_digests(flat, mine), lists], [*others, "n", "d1", "d2", "h"])

    kept = spread(docs).select(*others, F.lower("text").alias("text"))
    return kept.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1]) + "n bigint, d1 bigint, d2 bigint, h array<bigint>")


def band_keys(sets: DataFrame, hashes: int = 128, rows: int = 4) -> DataFrame:
    """(id, band): MinHash bands of sets (id, h)."""
    return exploded(_signed(sets.select("id", "h"), hashes, rows), "bands", "band")


def near_classes(docs: DataFrame, threshold: float, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of ``docs`` (id, grp, text), both written.

    Rows of one group with equal sets are a class, named by its least id; members are (grp, rep, id). Pairs
    (grp, i, j, jaccard) are of class names i < j with Jaccard similarity at the threshold or above. Candidates
    meet in a MinHash band of their group, so copies meet once; sets are compared exactly afterwards.
    """
    scratch = Scratch(docs.sparkSession)
    sets = scratch.cut(shingle_sets(docs.select("id", "grp", "text"), k))
    classes = scratch.cut(sets.groupBy("grp", "n", "d1", "d2").agg(F.min("id").alias("id"), F.first("h").alias("h")))
    names = classes.select("grp", "n", "d1", "d2", F.col("id").alias("rep"))
    same = F.col("s.grp").eqNullSafe(F.col("c.grp")) & (F.col("s.n") == F.col("c.n")) & (F.col("s.d1") == F.col("c.d1")) & (F.col("s.d2") == F.col("c.d2"))
    members = scratch.cut(sets.select("id", "grp", "n", "d1", "d2").alias("s").join(names.alias("c"), same).select("s.grp", "rep", "s.id"))
    keys = band_keys(classes.select(F.struct("grp", "id").alias("id"), "h")).select("id.grp", "id.id", "band")
    met = keys.alias("a").join(keys.alias("b"), (F.col("a.band") == F.col("b.band")) & F.col("a.grp").eqNullSafe(F.col("b.grp")) & (F.col("a.id") < F.col("b.id")))
    met = met.select(F.col("a.grp").alias("grp"), F.col("a.id").alias("i"), F.col("b.id").alias("j")).distinct()
    # Sizes decide before any set travels; then a set goes to its pairs, which meet the other one.
    sizes, sets = (lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"))), (lambda x: classes.select(F.col("id").alias(x), F.col("h").alias(f"h{x}")))
    able = scratch.cut(met.join(sizes("i"), "i").join(sizes("j"), "j").where(F.least("ni", "nj") >= threshold * F.greatest("ni", "nj")))
    able = able.join(sets("i"), "i").join(sets("j"), "j")
    common = F.size(F.array_intersect("hi", "hj"))
    scored = able.withColumn("jaccard", common / (F.col("ni") + F.col("nj") - common)).where(F.col("jaccard") >= threshold)
    return members, scratch.cut(scored.select("grp", "i", "j", "jaccard"))


def near_pairs(docs: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """(grp, i, j, jaccard): all pairs i < j of rows of one group at the threshold or above, copies included."""
    members, pairs = near_classes(docs, threshold, k)
    one, two = members.select(F.col("rep").alias("i"), F.col("id").alias("a")), members.select(F.col("rep").alias("j"), F.col("id").alias("b"))
    apart = pairs.join(one, "i").join(two, "j").select("grp", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "jaccard")
    m = members.select(F.col("grp"), "rep", F.col("id").alias("i"))
    equal = m.join(members.select("rep", F.col("id").alias("j")), "rep").where("i < j").select("grp", "i", "j", F.lit(1.0).alias("jaccard"))
    return apart.unionByName(equal)


def keep_first(nodes: DataFrame, edges: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """(id, kept): a node goes if an earlier node that stays is similar to it.

    Rounds over the edge table: a node whose earlier neighbours have all gone stays, one with
    an earlier neighbour that stays goes. Each round decides at least the first
    undecided node of every component; tables of a round are written out. Once no more than ``few``
    edges are undecided (a long chain of links decides two nodes a round), the driver walks them in order.
    """
    scratch, gone, rounds = Scratch(nodes.sparkSession), None, 0
    undecided = scratch.cut(edges.select("i", "j").distinct())
    while undecided.limit(few + 1).count() > few:
        later = undecided.select(F.col("j").alias("id")).distinct()
        stay = undecided.select(F.col("i").alias("id")).distinct().join(later, "id", "left_anti")
        out = undecided.join(stay.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id")).distinct()
        out = scratch.cut(out)
        gone = out if gone is None else gone.union(out)
        rounds += 1
        gone = gone if rounds % GONE_TABLES else scratch.cut(gone.coalesce(nodes.sparkSession.sparkContext.defaultParallelism))
        rest = undecided.join(stay.withColumnRenamed("id", "i"), "i", "left_anti")
        rest = rest.join(out.withColumnRenamed("id", "i"), "i", "left_anti").join(out.withColumnRenamed("id", "j"), "j", "left_anti")
        undecided = scratch.cut(rest.select("i", "j"))
    last: set = set()
    for i, j in undecided.orderBy("j").collect():  # at most ``few`` rows; an edge's first node is decided before it
        if i not in last:
            last.add(j)
    if last:
        rest = nodes.sparkSession.createDataFrame([(j,) for j in last], f"id {edges.schema['j'].dataType.simpleString()}")
        gone = rest if gone is None else gone.union(rest)
    if gone is None:
        return nodes.select("id", F.lit(True).alias("kept"))
    return nodes.select("id").join(gone.withColumn("out", F.lit(True)), "id", "left").select("id", F.col("out").isNull().alias("kept"))


def keep_first_classes(nodes: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept) as from all pairs of rows, from classes of equal rows (rep, id) and pairs (i, j) of their first rows.

    A row after the first of its class always goes: either the first stays, or the earlier row that took the first
    is near all of the class.
    """
    later = members.where("rep <> id").select("id", F.lit(True).alias("_later"))
    return keep_first(nodes, pairs).join(later, "id", "left").select("id", (F.col("kept") & F.col("_later").isNull()).alias("kept"))


def drop_partners(kept: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, partner) of every row that keep-first drops: the first row that stays and is near it, or an equal one."""
    stays = kept.where("kept").select(F.col("id").alias("i"))
    taker = pairs.join(stays, "i").groupBy(F.col("j").alias("rep")).agg(F.min("i").alias("taker"))
    gone = kept.where("NOT kept").select("id").join(members.select("id", "rep"), "id")
    return gone.join(taker, "rep", "left").select("id", F.coalesce("taker", "rep").alias("partner"))


def near_gone(docs: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """(id, partner) of the rows of ``docs`` (id, grp, text) that keep-first drops by their shingles; partners stay.

    A class of equal sets that shares a MinHash bucket has a place by its id. Stretches of places are decided one after
    the other, each as long as all before it: the links of a stretch are made and walked in order, and its classes that
    stay are compared, exactly, with what shares a bucket with them later on. A stretch is halved until its buckets hold
    no more than ``CROWD`` pairs for each row of all buckets, so of a large group of near texts few pairs are made before
    it is gone; otherwise the number of stretches grows with the logarithm of the classes, however long chains of buckets
    are. Sets are written only of classes with a place. Texts without words are near nothing.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.cut(signatures(docs.select("id", "grp", "text"), k))
    classes = scratch.cut(signed.groupBy("grp", "n", "d1", "d2").agg(F.min("id").alias("id"), F.first("bands").alias("bands")))
    keys = exploded(classes.select("id", "grp", "n", "bands"), "bands", "band").select("id", "n", F.xxhash64("grp", "band").alias("b"))
    shared = keys.groupBy("b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("b")
    met = scratch.cut(keys.join(shared, "b").select("id", "n", "b"))
    places = scratch.cut(ordered(met.select("id").distinct(), [], ["id"], "place"))
    total = places.count()
    open_ = scratch.cut(met.join(places, "id").select("place", "n", "b"))
    sets = scratch.cut(shingle_sets(docs.select("id", "text").join(small(places), "id").select("place", "text"), k).select("place", "n", "h"))
    one, two = (sets.select(F.col("place").alias(x), F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}")) for x in "ij")

    def near(first: DataFrame, then: DataFrame, earlier: bool = False) -> DataFrame:
        # Sizes decide before any set travels, and the sets that pairs ask for are picked before they do.
        pairs = first.select(F.col("place").alias("i"), F.col("n").alias("m"), "b").join(then.withColumnRenamed("place", "j"), "b")
        told = scratch.cut((pairs.where("i < j") if earlier else pairs).where(F.least("n", "m") >= threshold * F.greatest("n", "m")).select("i", "j").distinct())
        both = two.join(small(told), "j").join(one.join(small(told.select("i").distinct()), "i"), "i")
        common = F.size(F.array_intersect("hi", "hj"))
        return scratch.cut(both.where(common / (F.col("ni") + F.col("nj") - common) >= threshold).select("i", "j"))

    def crowd(block: DataFrame) -> int:
        return block.groupBy("b").agg(F.count("*").alias("c")).agg(F.sum(F.expr("c * (c - 1) div 2"))).first()[0] or 0

    gone, lo, room = None, 0, CROWD * open_.count()
    while lo < total:
        hi = min(total, lo + max(FEW, lo, 1))
        while hi - lo > 1 and crowd(open_.where(F.col("place") < hi)) > room:
            hi -= (hi - lo) // 2
        block, later = open_.where(F.col("place") < hi), open_.where(F.col("place") >= hi)
        links = near(block, block, earlier=True)
        walked = keep_first(block.select(F.col("place").alias("id")).distinct(), links)
        stays = scratch.cut(walked.where("kept").select(F.col("id").alias("i")))
        out = links.join(stays, "i")
        if hi < total:
            out = out.unionByName(near(block.join(stays.withColumnRenamed("i", "place"), "place"), later))
        out = scratch.cut(out.groupBy("j").agg(F.min("i").alias("i")))
        gone = out if gone is None else gone.unionByName(out)
        open_, lo = scratch.cut(later.join(out.select(F.col("j").alias("place")), "place", "left_anti")), hi
    if gone is None:
        gone = open_.select(F.col("place").alias("i"), F.col("place").alias("j"))
    named = (lambda x, name: places.select(F.col("place").alias(x), F.col("id").alias(name)))
    gone = scratch.cut(gone.join(named("i", "partner"), "i").join(named("j", "id"), "j").select("id", "partner"))
    named = classes.select(F.col("grp").alias("_g"), F.col("n").alias("_n"), F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.col("id").alias("rep"))
    same = F.col("grp").eqNullSafe(F.col("_g")) & (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))
    members = signed.select("id", "grp", "n", "d1", "d2").join(named, same).select("id", "rep")
    told = members.join(gone.withColumnRenamed("id", "rep"), "rep", "left")
    return told.where("partner IS NOT NULL OR rep <> id").select("id", F.coalesce("partner", "rep").alias("partner"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

"""MinHash near-duplicates with circulant signatures, banding and exact verification.

A text's set holds its distinct word shingles. Signature coordinate k is the minimum
over the set of ``pi(sigma(x) + k * step)``: two permutations of the 64-bit integers,
the second applied to the first's values circularly shifted, give all coordinates.
Texts with equal sets form a class, and only the class's smallest id goes on.

Bands of ``ROWS`` coordinates are buckets. What is wanted are components, so a bucket
of m members need not be expanded into m * m pairs:

1. every member is verified against its bucket's smallest id (a star);
2. buckets of three or more that still hold several components are joined to clusters by
   the members they share; a cluster's full sets come together once, and every member
   outside its largest component is compared with all members of other components
   whose signatures agree in ``MATCH`` coordinates.

Every pair of a bucket with such signatures is therefore verified or already
connected; no bucket is capped. Verification compares full sets. A pair at similarity
0.8 is missed with a probability of about 3e-6, by the bands. Large clusters are cut into blocks by rows
and by shingles, so a task's memory is bounded for long texts too, and pairs of blocks are
separate groups; groups return spanning links, not pairs. A band key or a set that a large
share of the documents has is joined where the rows are.

Defined results: null, empty and white-space texts have an empty set and link with
nothing; texts with fewer words than a shingle are one shingle; rows sharing a doc_id
count as one document that has the links of each of its texts; a null doc_id links with
nothing (component null, kept); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import connected_components
from .staging import Stage, fresh, spread_join
from .textbytes import Texts, lowered, mix, ragged, runs, shingle_hashes, span_hashes, text_chunks, words

ROWS, BANDS = 4, 24
COORDINATES = ROWS * BANDS
#: Least number of equal coordinates of a pair that is verified (0.8 gives 76.8 on average).
MATCH = 57
#: Rows and shingles of one block of a cluster, about.
BLOCK, BLOCK_ITEMS = 4096, 1 << 21
#: Clusters of one block share groups of about so many shingles.
GROUP_ITEMS = 1 << 20
_STEP = np.uint64(0xA0761D6478BD642F)


def sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, and the row of each; rows ascending."""
    data = lowered(texts.data)
    starts, ends, rows = words(texts, data)
    found, at = shingle_hashes(span_hashes(data, starts, ends), rows, width, len(texts))
    if not len(found):
        return found, at
    order = np.lexsort((found, at))
    found, at = found[order], at[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (at[1:] != at[:-1])]
    return found[new], at[new]


def signatures(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of coordinates for every row that has a set, in order."""
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = np.empty((len(begin), COORDINATES), np.uint64)
    sigma = mix(found ^ np.uint64(0x2545F4914F6CDD1D))
    shifted = np.empty_like(sigma)
    for k in range(COORDINATES):
        np.add(sigma, np.uint64((k * int(_STEP)) & (2**64 - 1)), out=shifted)
        out[:, k] = np.minimum.reduceat(mix(shifted), begin)
    return out


def describe(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, d1, d2, bands, sketch) for every row: set size, set digest, band keys, low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_chunks(batch.column(1)):
                found, at = sets(t, width)
                n = np.bincount(at, minlength=len(t)).astype(np.int64)
                d1, d2 = np.zeros(len(t), np.uint64), np.zeros(len(t), np.uint64)
                bands: list = [None] * len(t)
                sketch: list = [None] * len(t)
                if len(found):
                    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    have = at[begin]
                    d1[have] = np.add.reduceat(mix(found + np.uint64(1)), begin)
                    d2[have] = np.bitwise_xor.reduceat(mix(found + np.uint64(2)), begin)
                    full = signatures(found, at)
                    keys = np.zeros((len(have), BANDS), np.uint64)
                    for b in range(BANDS):
                        acc = np.full(len(have), b + 1, np.uint64)
                        for r in range(ROWS):
                            acc = mix(acc + full[:, b * ROWS + r])
                        keys[:, b] = acc
                    low = full.astype(np.uint8)
                    for j, i in enumerate(have):
                        bands[i], sketch[i] = keys[j].view(np.int64), low[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.lo, len(t)), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["id", "n", "d1", "d2", "bands", "sketch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary")


def _set_table(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, items) of the wanted classes (rep, d1, d2), from their documents' whole texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted.withColumnRenamed("rep", "id"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_chunks(batch.column(1)):
                found, at = sets(t, width)
                bounds = np.searchsorted(at, np.arange(len(t) + 1)).astype(np.int32)
                d1 = np.array([mix(found[a:b] + np.uint64(1)).sum(dtype=np.uint64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
                right = pa.array(d1.view(np.int64) == batch.column(2).slice(t.lo, len(t)).to_numpy(zero_copy_only=False))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, len(t)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.view(np.int64)))], ["id", "items"])
                yield out.filter(right)

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("id", "text", "d1").mapInArrow(run, f"id {kind}, items array<bigint>").dropDuplicates(["id", "items"])


def _verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = items.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    two = items.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    # Sizes are compared before sets, so hopeless pairs never carry a set.
    na, nb = items.select(F.col("id").alias("a"), F.size("items").alias("na")), items.select(F.col("id").alias("b"), F.size("items").alias("nb"))
    able = pairs.join(na, "a").join(nb, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()
    both = able.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("ia", "ib"))
    return both.where(100 * common >= percent * (F.size("ia") + F.size("ib") - common)).select("a", "b").distinct()


def _connect(percent: int, kind: pa.DataType):
    """Spanning links (a, b) between components within clusters, from full sets."""

    def links(rep, comp, side, sketch, items, sizes) -> tuple[np.ndarray, np.ndarray]:
        names, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
        label = inverse.copy()
        bounds = np.r_[0, np.cumsum(sizes)]
        crossing = side.max() > 0
        a, b = [], []
        for i in np.flatnonzero(inverse != np.argmax(counts)):
            near = (sketch == sketch[i]).sum(1) >= MATCH
            near &= (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            if crossing:
                near &= side != side[i]
            near = np.flatnonzero(near)
            for lo in range(0, len(near), 256):
                part = near[lo : lo + 256]
                part = part[label[part] != label[i]]
                if not len(part):
                    continue
                own = items[bounds[i] : bounds[i + 1]]
                other = items[ragged(bounds[part], sizes[part])]
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                hit = np.add.reduceat((own[at] == other).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
                for j in part[100 * hit >= percent * (sizes[part] + sizes[i] - hit)]:
                    if label[j] != label[i]:
                        a.append(rep[i])
                        b.append(rep[j])
                        label[label == label[j]] = label[i]
        return a, b

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")]).combine_chunks()
        cols = {c: table.column(c).to_numpy() for c in ("cluster", "i", "j", "rep", "comp", "side")}
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        lists = table.column("items").combine_chunks() if isinstance(table.column("items"), pa.ChunkedArray) else table.column("items")
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.r_[0, np.cumsum(sizes)]
        _, place = np.unique(np.stack([cols["cluster"], cols["i"], cols["j"]]), axis=1, return_inverse=True)
        a, b = [], []
        for lo, hi in runs(place.ravel()):
            u, v = links(cols["rep"][lo:hi], cols["comp"][lo:hi], cols["side"][lo:hi], sketch[lo:hi], flat[bounds[lo] : bounds[hi]], sizes[lo:hi])
            a += u
            b += v
        return pa.table({"a": pa.array(a, pa.int64()).cast(kind), "b": pa.array(b, pa.int64()).cast(kind)})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    stage = Stage(docs.sparkSession, "minhash")
    kind = docs.schema[id_col].dataType.simpleString()
    sigs = stage.cut(describe(docs, width, id_col, text_col))
    classes = stage.cut(sigs.where("n > 0 AND id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    entries = classes.select("rep", F.explode_outer("bands").alias("key"))
    leaders = stage.cut(entries.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("m")).where("m > 1").select("key", "leader", "m", F.col("m").alias("times")), narrow=True)
    met = leaders.agg(F.sum("m")).first()[0] or 0
    members = stage.cut(spread_join(entries, leaders, ["key"], "times", met).distinct(), narrow=True)
    wanted = classes.select("rep", "d1", "d2").join(members.select("rep").distinct(), "rep", "left_semi")
    items = stage.cut(_set_table(docs, wanted, width, id_col, text_col))
    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = stage.cut(_verified(star, items, percent), narrow=True)
    comps = connected_components(links, stage)
    at = members.where("m > 2").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "leader", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = at.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    live = stage.cut(at.join(mixed, "key", "left_semi").select("leader", "rep", "comp").distinct(), narrow=True)
    if not live.isEmpty():
        near = connected_components(live.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")), stage)
        placed = near.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(live.select("rep", "comp").distinct(), "rep")
        placed = stage.cut(placed.join(classes.select("rep", "n"), "rep"), narrow=True)
        blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int")
        sizes = placed.groupBy("cluster").agg(blocks.alias("blocks"))
        split = placed.join(sizes, "cluster").withColumn("k", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.withColumn("i", F.least("k", "other")).withColumn("j", F.greatest("k", "other")).withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("k") == F.col("i"), 1).otherwise(2))
        groups = max(1, placed.agg(F.sum("n")).first()[0] // GROUP_ITEMS)
        split = split.withColumn("g", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(F.xxhash64("cluster", "i", "j")))
        fed = split.select("g", "cluster", "i", "j", "side", "rep", "comp").join(classes.select("rep", "sketch"), "rep").join(items.withColumnRenamed("id", "rep"), "rep")
        found = stage.cut(fed.groupBy("g").applyInArrow(_connect(percent, to_arrow_type(docs.schema[id_col].dataType)), f"a {kind}, b {kind}"))
        stage.release()
        comps = connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found), stage)
    of_class = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", "copies", F.coalesce("component", "rep").alias("c"))
    live = F.expr("n > 0 AND id IS NOT NULL")
    narrow = sigs.select("id", "n", "d1", "d2")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    joined = spread_join(narrow.where(live), stage.cut(of_class, narrow=True), ["n", "d1", "d2"], "copies", total)
    out = joined.select("id", "n", "c").unionByName(narrow.where(~live).select("id", "n", F.col("id").alias("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; rows with an empty set or a null id all stay."""
    kept = near_duplicates(docs, width, percent, id_col, text_col).where("kept AND n_shingles > 0").select(id_col).distinct()
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = docs.where(has_words).join(kept, id_col, "left_semi")
    turn = fresh(docs.columns, "turn")
    first = first.withColumn(turn, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))).where(F.col(turn) == 1).drop(turn)
    return first.unionByName(docs.where(~has_words | F.col(id_col).isNull()))

"""SimHash document fingerprints and search within a Hamming radius.

The terms of a text are its runs of two words (A-Z lower-cased; the whole text where
it has one word). Each distinct term votes with weight ``16 (1 + ln tf)``, rounded, for
or against each of 64 bits by its hash; the sign of the sum is the bit. The search
permutes the fingerprint's blocks: a table for every choice of ``blocks - radius``
blocks is keyed by those blocks, so two fingerprints within ``radius`` bits share a
key in at least one table. The number of blocks follows the number of fingerprints, so
that keys tell them apart. Fingerprints are searched once each, whatever the number of
documents that have them.

Defined results: null and empty texts, and texts of white space, have fingerprint
0; equal texts have equal fingerprints; ties of a vote give bit 0; null ids come last; rows that share a
doc_id are ordered by a hash of their text; extra columns are ignored; an empty
table gives an empty table; the next document of a single row is that row itself.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import Stage, spread_join
from .textbytes import CHUNK_BYTES, Texts, lowered, mix, runs, shingle_hashes, span_hashes, text_chunks, words

BITS = 64
#: Rows of one ordered run when documents are put in order.
RUN_ROWS = 2000
FAN = 256
#: Entries of tables that are searched together, about.
DEAL_ROWS = 1 << 19


def fingerprints(texts: Texts) -> np.ndarray:
    """One 64-bit fingerprint for each text."""
    out = np.zeros(len(texts), np.uint64)
    data = lowered(texts.data)
    starts, ends, rows = words(texts, data)
    terms, at = shingle_hashes(span_hashes(data, starts, ends), rows, 2, len(texts))
    if not len(terms):
        return out
    order = np.lexsort((terms, at))
    terms, at = terms[order], at[order]
    new = np.r_[True, (terms[1:] != terms[:-1]) | (at[1:] != at[:-1])]
    first = np.flatnonzero(new)
    tf = np.diff(np.r_[first, len(terms)])
    terms, at = terms[first], at[first]
    weight = np.rint(16 * (1 + np.log(tf))).astype(np.int32)
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    total = np.add.reduceat(weight, begin)
    bits = np.unpackbits(terms.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits * weight[:, None], begin, axis=0, dtype=np.int32)
    signs = np.packbits(2 * votes > total[:, None], axis=1, bitorder="little")
    out[at[begin]] = np.ascontiguousarray(signs).view(np.uint64)[:, 0]
    return out


def add_fingerprint(df: DataFrame, text_col: str, name: str, drop_text: bool = False) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` as a long; optionally without the text."""
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text_col)]
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(t) for t in text_chunks(batch.column(place))]
            value = pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
            columns = [c for i, c in enumerate(batch.columns) if not (drop_text and i == place)]
            yield pa.RecordBatch.from_arrays([*columns, value], [*(f.name for f in kept), name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` bigint"])
    return df.mapInArrow(run, schema)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _run_of(id_col: str, cuts: list[int]) -> Column:
    """Which run an id falls in, by two searches over at most ``FAN`` cuts each."""
    if not cuts:
        return F.lit(0)
    step = max(1, -(-len(cuts) // FAN))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    top = F.array(*[F.lit(p[0]).cast("long") for p in parts[1:]]) if len(parts) > 1 else F.array().cast("array<bigint>")
    value = F.col(id_col).cast("long")
    which = F.size(F.filter(top, lambda c: c <= F.coalesce(value, F.lit(2**63 - 1))))
    inner = F.array(*[F.array(*[F.lit(c).cast("long") for c in p]) for p in parts])
    return F.coalesce(which * step + F.size(F.filter(F.element_at(inner, which + 1), lambda c: c <= F.coalesce(value, F.lit(2**63 - 1)))), F.lit(0)).cast("int")


def with_next(docs: DataFrame, ids: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with ``next``: a struct of the columns of the next document by id, after the last the first.

    Ids are cut into runs at approximate quantiles; a run is ordered by itself, and
    each run gets the first document of the run after it, one extra row a run.
    ``ids`` holds the same ids; the order is planned on it alone, so nothing
    ``docs`` computes is computed for that. ``of`` gives the rows of ``docs`` with the ids
    (``_head``) of a small table, where that costs less than looking through all of them.
    """
    count = ids.count()
    n_cuts = min(FAN * FAN, count // RUN_ROWS)
    cuts: list[int] = []
    if n_cuts:
        shares = [(i + 1) / (n_cuts + 1) for i in range(n_cuts)]
        got = ids.select(F.percentile_approx(F.col(id_col).cast("long"), shares, max(10_000, 20 * n_cuts)).alias("c")).first()["c"] or []
        cuts = sorted(set(got))
    runs = docs.withColumn("_run", _run_of(id_col, cuts)).withColumn("_extra", F.lit(0))
    heads = sorted(((r["_run"], r["id"]) for r in ids.groupBy(_run_of(id_col, cuts).alias("_run")).agg(F.min(id_col).alias("id")).collect()), key=lambda x: x[0])
    if not heads:
        return runs.withColumn("next", F.struct(*columns)).drop("_run", "_extra")
    before = {heads[(i + 1) % len(heads)][1]: heads[i][0] for i in range(len(heads))}
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, r) for i, r in before.items()], f"_head {docs.schema[id_col].dataType.simpleString()}, _to int")
    extra = (of(table) if of else docs).join(F.broadcast(table), F.col(id_col).eqNullSafe(F.col("_head"))).drop("_head").withColumnRenamed("_to", "_run").withColumn("_extra", F.lit(1))
    every = runs.unionByName(extra)
    order = Window.partitionBy("_run").orderBy("_extra", F.col(id_col).asc_nulls_last(), F.xxhash64(text_col))
    return every.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("_extra = 0").drop("_run", "_extra")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    Texts travel once, compressed one by one, to where their neighbours are.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_chunks(batch.column(1)):
                raw = t.data.tobytes()
                packed = [pa.compress(raw[x:y], "zstd", asbytes=True) for x, y in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, len(t)), pa.array(packed, pa.binary()), pa.array(np.diff(t.offsets)), pa.array(fingerprints(t).view(np.int64))], [id_col, "packed", "size", "fp"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = lambda packed, size: pa.decompress(packed, size, "zstd", asbytes=True).decode() if size else ""
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            lo = held = 0
            edited, n_chars = [], []
            for k, (packed, size, _, next_packed, next_size, _) in enumerate(zip(*columns, strict=True)):
                text, after = open_(packed, size), open_(next_packed, next_size)
                cut = len(text) // 4
                n_chars.append(len(text))
                edited.append((text[: len(text) - cut] + after[:cut]).encode())
                held += len(edited[-1])
                if held < CHUNK_BYTES and k + 1 < batch.num_rows:
                    continue
                found = [fingerprints(t) for t in text_chunks(pa.array(edited, pa.binary()))]
                part = batch.slice(lo, len(edited))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_chars, pa.int64()), part.column(3), part.column(6), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(np.concatenate(found).view(np.int64))],
                    [id_col, "n_chars", "fp", "next_fp", "edited_sha256", "edited_fp"],
                )
                lo, held, edited, n_chars = k + 1, 0, [], []

    marked = lambda rows: rows.select(id_col, text_col).mapInArrow(first, f"`{id_col}` {kind}, packed binary, size bigint, fp bigint")
    heads = lambda table: marked(docs.join(F.broadcast(table), F.col(id_col).eqNullSafe(F.col("_head")), "left_semi"))
    paired = with_next(marked(docs), docs.select(id_col), ["packed", "size", "fp"], id_col, "packed", heads)
    flat = paired.select(id_col, "packed", "size", "fp", "next.packed", "next.size", F.col("next.fp").alias("next_fp")).toDF(id_col, "packed", "size", "fp", "np", "ns", "next_fp")
    return flat.mapInArrow(second, f"`{id_col}` {kind}, n_chars bigint, fp bigint, next_fp bigint, edited_sha256 string, edited_fp bigint")


def key_blocks(n: int, radius: int) -> int:
    """Blocks so that a table's key tells about as many values apart as there are fingerprints."""
    blocks = radius + 1
    while BITS * (blocks - radius) / blocks < math.log2(max(n, 2)) - 2 and blocks < 4 * radius + 4:
        blocks += 1
    return blocks


def block_masks(radius: int, blocks: int) -> list[int]:
    """For every choice of ``blocks - radius`` blocks the bits they cover."""
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]


def _dealt(masks: np.ndarray, deals: int):
    """Packed rows (deal, i, j, side, fps, copies): every fingerprint once a table, dealt by its key; hot keys are cut later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            copies = batch.column(1).to_numpy()
            for t, mask in enumerate(masks):
                key = mix((fp & mask) ^ mix(np.full(len(fp), t + 1, np.uint64)))
                deal = (key % np.uint64(deals)).astype(np.int64)
                order = np.argsort(deal, kind="stable")
                spans = runs(deal[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(deal[order[x]]) for x, _ in spans], pa.int64()), pa.array([t] * len(spans), pa.int32()), pa.array([fp[order[x:y]].tobytes() for x, y in spans], pa.binary()), pa.array([copies[order[x:y]].tobytes() for x, y in spans], pa.binary())],
                    ["deal", "t", "fps", "copies"],
                )

    return run


def _near(masks: np.ndarray, radius: int):
    """(fp, near): copies of others within the radius, of the pairs that meet first in the table at hand."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fps, copies = ([np.frombuffer(x, k) for x in table.column(c).to_pylist()] for c, k in (("fps", np.uint64), ("copies", np.int64)))
        t = np.repeat(table.column("t").to_numpy(), [len(x) for x in fps])
        fp, copies = np.concatenate(fps), np.concatenate(copies)
        found_fp, found_n = [], []
        for table_no in np.unique(t):
            here = np.flatnonzero(t == table_no)
            x, c, mask = fp[here], copies[here], masks[table_no]
            order = np.lexsort((x, x & mask))
            x, c, key = x[order], c[order], (x & mask)[order]
            near = np.zeros(len(x), np.int64)
            left = np.arange(len(x) - 1)  # those whose neighbour at the distance at hand still has their key
            step = 1
            while len(left):
                left = left[key[left] == key[np.minimum(left + step, len(x) - 1)]]
                left = left[left + step < len(x)]
                diff = x[left] ^ x[left + step]
                hit = np.bitwise_count(diff) <= radius
                for earlier in masks[:table_no]:
                    hit &= (diff & earlier) != 0
                a = left[hit]
                near[a] += c[a + step]
                near[a + step] += c[a]
                step += 1
            some = np.flatnonzero(near)
            found_fp.append(x[some])
            found_n.append(near[some])
        return pa.table({"fp": pa.array(np.concatenate(found_fp).view(np.int64)), "near": pa.array(np.concatenate(found_n))})

    return run


def within_radius(fps: DataFrame, radius: int = 3, col: str = "fp", count: str = "copies") -> DataFrame:
    """(fp, near) of distinct fingerprints with others at most ``radius`` bits apart: how many copies those have.

    ``fps`` has each fingerprint once, with its number of copies, as a written table. A table is a choice of
    blocks; fingerprints that agree in all blocks of a choice meet there. A pair counts in the first table it
    meets in, so pairs are never written. Null fingerprints are left out; an empty table gives an empty table.
    """
    n = fps.count()
    masks = np.array(block_masks(radius, key_blocks(n, radius)), np.uint64)
    deals = max(1, n * len(masks) // DEAL_ROWS)
    sent = fps.where(F.col(col).isNotNull()).select(col, F.col(count).cast("long")).mapInArrow(_dealt(masks, deals), "deal bigint, t int, fps binary, copies binary")
    found = sent.groupBy("deal").applyInArrow(_near(masks, radius), "fp bigint, near bigint")
    return found.groupBy("fp").agg(F.sum("near").alias("near"))


def near_fingerprints(found: DataFrame, radius: int = 3) -> DataFrame:
    """``found`` with ``n_near``: other rows whose fingerprint ``fp`` is at most ``radius`` bits away.

    ``found`` is written once and read again.
    """
    stage = Stage(found.sparkSession, "simhash")
    found = stage.cut(found)
    each = stage.cut(found.groupBy("fp").agg(F.count("*").alias("copies")), narrow=True)
    near = within_radius(each, radius)
    known = stage.cut(each.join(near, "fp", "left").select("fp", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_near")), narrow=True)
    total = each.agg(F.sum("copies")).first()[0] or 0
    return spread_join(found, known, ["fp"], "copies", total)

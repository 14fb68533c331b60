"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Unit vectors are projected on ``LINES`` random lines. Two vectors collide on a line when
one lies in the window of half-width ``REACH / STEP`` centred at the other. The difference
of a pair at cosine c is normal with variance ``2 - 2c``, so its collision count is binomial,
and pairs with at least ``least_count`` collisions - calibrated to miss a pair at the
threshold with probability ``MISS`` - are verified by their cosine in double precision.

One line tells little: a window that holds most pairs at the threshold holds a third of all
vectors. So windows are opened within cells. A table draws ``lines`` further lines a digit,
and a digit is the line on which a vector stands furthest out, with its side. Cells hold
about ``CELL`` vectors at any n; how often a pair at the threshold shares a cell is
computed, and so many tables are used that all are missed with probability ``MISS``. The
vectors of a cell are sorted by their first projection; a query's window in that order is
so wide that a pair at the threshold lies in it but for ``MISS``, and collisions on all
lines are counted for the pairs of the window. A pair counts in the first table it shares. Cells above ``BLOCK`` vectors (clusters) are cut into
blocks, and every pair of blocks is a group of its own: no cell is capped.

What travels is a vector as 16-bit integers with a bound of its rounding error. Cosines
further from the threshold than that bound are decided on it, the few others are fetched
and computed from the vectors as given. Equal vectors are one class and never expanded
into pairs. Groups return link counts and spanning links, one row a vector, not pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different length do not link; equal rows are vectors of
their own that link with each other; rows with a null id link with nothing; labels and
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import connected_components
from .staging import Stage, spread_join
from .textbytes import mix

LINES = 64
#: Projections are integers of 1 / STEP, clipped at FAR; a window reaches REACH of them either way.
STEP, REACH, FAR = 24, 12, 115
MISS = 2e-3
CELL = 4096
BLOCK = 8192
#: Lines of one digit at most.
MOST_LINES = 128
#: Rows that cell sizes are estimated from, about; and the most cells that are cut into blocks.
SAMPLE_ROWS = 2_000_000
MOST_CUT = 65_536
QUERIES = 256
SEED = 11


def least_count(cosine: float) -> int:
    """The largest count that a pair at ``cosine`` falls below with probability MISS at most."""
    # A difference under (REACH - 1) / STEP collides however both ends are rounded.
    p = math.erf((REACH - 1) / STEP / math.sqrt(2 - 2 * cosine) / math.sqrt(2)) if cosine < 1 else 1.0
    below, count = 0.0, 0
    while count < LINES:
        below += math.comb(LINES, count) * p**count * (1 - p) ** (LINES - count)
        if below > MISS:
            break
        count += 1
    return count


def first_reach(cosine: float) -> int:
    """Half-width of the window on the sorted line: a pair at ``cosine`` is further apart with probability MISS at most."""
    reach = REACH
    while cosine < 1 and math.erf((reach - 1) / STEP / math.sqrt(2 - 2 * cosine) / math.sqrt(2)) < 1 - MISS and reach < 2 * FAR:
        reach += 1
    return reach


@functools.cache
def meeting(lines: int, cosine: float, draws: int = 20_000) -> float:
    """How often both of a pair at ``cosine`` stand furthest out on the same side of one of ``lines`` lines."""
    if cosine >= 1:
        return 1.0
    rng = np.random.default_rng([SEED, lines])
    a = rng.standard_normal((draws, lines))
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * rng.standard_normal((draws, lines))
    i, j, every = np.abs(a).argmax(1), np.abs(b).argmax(1), np.arange(draws)
    return float(((i == j) & (a[every, i] * b[every, j] > 0)).mean())


def plan(n: int, cosine: float) -> tuple[int, int, int]:
    """(tables, digits of a cell, lines of a digit) for n vectors."""
    cells = n / CELL
    if cells <= 1:
        return 1, 0, 0
    best = None
    fewest = math.ceil(math.log(cells) / math.log(2 * MOST_LINES))
    for digits in range(max(1, fewest), max(1, fewest) + 3):
        lines = max(1, math.ceil(cells ** (1 / digits) / 2))
        met = min(meeting(lines, cosine) ** digits, 1 - 1e-9)
        tables = max(1, math.ceil(math.log(MISS) / math.log(1 - met))) if met > 0 else 1 << 30
        best = min(best or (tables, digits, lines), (tables, digits, lines))
    return best


def _lines(dim: int, count: int, *salt: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, *salt]).standard_normal((dim, count)).astype(np.float32)


def _cells(unit: np.ndarray, tables: int, digits: int, lines: int) -> np.ndarray:
    """[vector, table]: the number of its cell."""
    out = np.zeros((len(unit), tables), np.int64)
    if digits:
        every = np.arange(len(unit))
        for t in range(tables):
            far = (unit @ _lines(unit.shape[1], digits * lines, 1, t)).reshape(len(unit), digits, lines)
            top = np.abs(far).argmax(2)
            for k in range(digits):
                out[:, t] = out[:, t] * (2 * lines) + 2 * top[:, k] + (far[every, k, top[:, k]] > 0)
    return out


def _digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Whether each row is usable, two digests of it, and (rows, vectors) for every length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    usable, one, two = np.zeros(len(sizes), bool), np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    found = []
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        rows, x = rows[good], np.ascontiguousarray(x[good])
        usable[rows] = True
        place = mix(np.arange(dim, dtype=np.uint64) + np.uint64(int(dim) << 32))
        for out, salt in ((one, 1), (two, 2)):
            out[rows] = mix(x.view(np.uint64) * np.uint64(2 * salt + 1) + place + np.uint64(salt)).sum(1, dtype=np.uint64)
        found.append((rows, x))
    return usable, one, two, found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _ids(rows: DataFrame) -> DataFrame:
    """(id, usable, d1, d2) of every row."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, one, two, _ = _digests(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(usable), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["id", "usable", "d1", "d2"])

    return rows.mapInArrow(run, f"id {kind}, usable boolean, d1 bigint, d2 bigint")


def _codes(rows: DataFrame) -> DataFrame:
    """(id, d1, d2, scale, error, code) of usable rows: 16-bit integers and the length of what rounding took."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, one, two, found = _digests(batch.column(1))
            for at, x in found:
                if not len(at):
                    continue
                unit = _unit(x)
                scale = np.abs(unit).max(1) / 32767
                code = np.rint(unit / scale[:, None]).astype(np.int16)
                error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(1)) + 1e-12
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(scale), pa.array(error), pa.array([c.tobytes() for c in code], pa.binary())],
                    ["id", "d1", "d2", "scale", "error", "code"],
                )

    return rows.mapInArrow(run, f"id {kind}, d1 bigint, d2 bigint, scale double, error double, code binary")


def _unpack(code: pa.Array, scale: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors) of packed vectors."""
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    sizes = np.asarray(pc.binary_length(code)) // 2
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        raw = b"".join(code.take(pa.array(rows)).to_pylist())
        out.append((int(dim), rows, np.frombuffer(raw, np.int16).reshape(len(rows), dim) * scale[rows, None]))
    return out


def _cell_numbers(shape: tuple[int, int, int]):
    """(cell) of every sampled class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _unpack(batch.column(1), batch.column(0).to_numpy()):
                cells = _cells(x.astype(np.float32), *shape)
                keys = [mix(cells[:, t].astype(np.uint64) * np.uint64(shape[0]) + np.uint64(t) + (np.uint64(dim) << np.uint64(44))).view(np.int64) for t in range(shape[0])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], ["cell"])

    return run


_SENT = ["cell", "i", "j", "side", "t", "rep", "copies", "scale", "error", "keys", "code"]


def _deal(shape: tuple[int, int, int], cut: dict[int, int]):
    """One row for each class and table (for each pair of blocks, where its cell is cut)."""
    tables = shape[0]
    large = np.array(sorted(cut), np.int64)
    pieces = np.array([cut[k] for k in large.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, copies, scale, error, code = batch.columns
            hashes = mix(np.asarray(pc.cast(rep, pa.int64())).astype(np.uint64) + np.uint64(99))
            for dim, rows, x in _unpack(code, scale.to_numpy()):
                cells = _cells(x.astype(np.float32), *shape)
                packed = [k.tobytes() for k in np.ascontiguousarray(cells)]
                for t in range(tables):
                    key = mix(cells[:, t].astype(np.uint64) * np.uint64(tables) + np.uint64(t) + (np.uint64(dim) << np.uint64(44))).view(np.int64)
                    blocks = np.ones(len(rows), np.int64)
                    if len(large):
                        spot = np.minimum(np.searchsorted(large, key), len(large) - 1)
                        blocks = np.where(large[spot] == key, pieces[spot], 1)
                    own = (hashes[rows] % blocks.astype(np.uint64)).astype(np.int64)
                    for other in range(int(blocks.max())):
                        w = np.flatnonzero(blocks > other)
                        i, j = np.minimum(own[w], other), np.maximum(own[w], other)
                        side = np.where(i == j, 0, np.where(own[w] == i, 1, 2))
                        take = pa.array(rows[w])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[w]), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(side.astype(np.int32)), pa.array(np.full(len(w), t, np.int32)), *(c.take(take) for c in (rep, copies, scale, error)), pa.array([packed[v] for v in w], pa.binary()), code.take(take)],
                            _SENT,
                        )

    return run


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the components of a[k] and b[k]; ``label`` has the least member of each."""
    a, b = label[a], label[b]
    apart = a != b
    if not apart.any():
        return
    joined = np.unique(np.minimum(a, b)[apart] * len(label) + np.maximum(a, b)[apart])
    a, b = joined // len(label), joined % len(label)
    root = np.arange(len(label))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    label[:] = root[label]


def windows(lines: np.ndarray, side: np.ndarray, least: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs with at least ``least`` collisions, for blocks of queries in the order of the first line.

    ``lines``: integer projections, sorted by the first, on which a window has the half-width ``reach``. Within one
    set (``side`` 0) a query's window runs to the right of it; between two, over the other.
    """
    crossing = bool(side.max(initial=0))
    asking, asked = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if crossing else (np.arange(len(side)),) * 2
    moved = lines.astype(np.uint8)
    shown, sought = (moved[asking] + np.uint8(REACH)).T.copy(), moved[asked].T.copy()
    first, other = lines[asking, 0], lines[asked, 0]
    for lo in range(0, len(asking), QUERIES):
        hi = min(lo + QUERIES, len(asking))
        begin = int(np.searchsorted(other, first[lo] - reach, "left")) if crossing else lo
        end = int(np.searchsorted(other, first[hi - 1] + reach, "right"))
        if end <= begin:
            continue
        hits = np.zeros((hi - lo, end - begin), np.uint8)
        for k in range(LINES):  # modulo 256 a difference within REACH is at most 2 * REACH, and none else is
            hits += shown[k, lo:hi, None] - sought[k, None, begin:end] <= 2 * REACH
        a, b = np.nonzero(hits >= least)
        a, b = asking[a + lo], asked[b + begin]
        if not crossing:
            a, b = a[a < b], b[a < b]
        yield a, b


def _count(cosine: float, kind: pa.DataType):
    least, reach = least_count(cosine), first_reach(cosine)
    names = ("id", "links", "other", "open")

    def cell(rep, copies, scale, error, keys, code, side, t) -> tuple[np.ndarray, np.ndarray, list, list]:
        """Of one cell (or pair of blocks): links of each vector, least linked vector, and pairs that stay open."""
        (dim, _, x), = _unpack(code, scale)
        lines = np.clip(np.rint(x.astype(np.float32) @ _lines(dim, LINES, 2) * STEP), -FAR, FAR).astype(np.int64)
        order = np.argsort(lines[:, 0], kind="stable")
        x, lines = x[order], lines[order]
        rep, copies, error, keys, side = rep[order], copies[order], error[order], keys[order], side[order]
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        open_a, open_b = [], []
        for a, b in windows(lines, side, least, reach):
            for p in range(0, len(a), 1 << 16):
                u, v = a[p : p + (1 << 16)], b[p : p + (1 << 16)]
                if t:
                    new = ~(keys[u, :t] == keys[v, :t]).any(1)
                    u, v = u[new], v[new]
                found = np.einsum("ij,ij->i", x[u], x[v])
                slack = 1.0001 * (error[u] + error[v]) + 1e-9
                sure, near = found >= cosine + slack, np.abs(found - cosine) < slack
                open_a.append(rep[u[near]])
                open_b.append(rep[v[near]])
                u, v = u[sure], v[sure]
                links += np.bincount(u, copies[v], len(x)).astype(np.int64) + np.bincount(v, copies[u], len(x)).astype(np.int64)
                _join_labels(label, u, v)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return links[back], rep[label][back], open_a, open_b

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, copies, scale, error, side = (table.column(c).to_numpy() for c in ("rep", "copies", "scale", "error", "side"))
        raw = table.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), -1)
        links, other, open_a, open_b = cell(rep, copies, scale, error, keys, table.column("code"), side, int(table.column("t")[0].as_py()))
        linked = np.flatnonzero(links)
        a, b = (np.concatenate([rep[:0], *v]) for v in (open_a, open_b))
        columns = (np.r_[rep[linked], a], np.r_[links[linked], np.zeros(len(a), np.int64)], np.r_[other[linked], b], np.r_[np.zeros(len(linked), bool), np.ones(len(a), bool)])
        return pa.table([pa.array(c).cast(k) for c, k in zip(columns, (kind, pa.int64(), kind, pa.bool_()), strict=True)], names)

    return run


def _exact(pairs: DataFrame, rows: DataFrame, cosine: float) -> DataFrame:
    """(id, links, other) both ways of the pairs (a, b) whose vectors, as given, have the cosine."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = []
            for c in (2, 3):
                size = np.asarray(batch.column(c).value_lengths())
                sides.append((size, np.cumsum(size) - size, batch.column(c).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)))
            for k in range(batch.num_rows):
                x, y = (_unit(flat[start[k] : start[k] + size[k]][None, :])[0] for size, start, flat in sides)
                keep[k] = x @ y >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    vector = rows.schema["vector"].dataType.simpleString()
    one, two = rows.select(F.col("id").alias("a"), F.col("vector").alias("va")), rows.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.col("va").cast(vector), F.col("vb").cast(vector))
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def link_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    stage = Stage(vectors.sparkSession, "vectors")
    kind = vectors.schema[id_col].dataType
    name = kind.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    same = _codes(rows.where("id IS NOT NULL")).groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first(F.struct("scale", "error", "code")).alias("v"))
    classes = stage.cut(same.select("d1", "d2", "rep", "copies", "v.scale", "v.error", "v.code"))
    counted = classes.agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).first()
    n = counted["n"]
    shape = plan(n, cosine)
    step = max(1, n // SAMPLE_ROWS)
    sizes = classes.where(F.pmod(F.xxhash64("rep"), F.lit(step)) == 0).select("scale", "code").mapInArrow(_cell_numbers(shape), "cell bigint").groupBy("cell").agg((F.count("*") * step).alias("m"))
    least = max(BLOCK, n * shape[0] // MOST_CUT)  # so at most MOST_CUT cells come back
    cut = {r["cell"]: -(-r["m"] // BLOCK) for r in sizes.where(F.col("m") > least).collect()}
    sent = classes.select("rep", "copies", "scale", "error", "code").mapInArrow(_deal(shape, cut), f"cell bigint, i int, j int, side int, t int, rep {name}, copies bigint, scale double, error double, keys binary, code binary")
    found = stage.cut(sent.groupBy("cell", "i", "j").applyInArrow(_count(cosine, to_arrow_type(kind)), f"id {name}, links bigint, other {name}, open boolean"), narrow=True)
    links, edges = found.where("NOT open").select("id", "links"), found.where("NOT open AND id <> other").select("id", "other")
    undecided = found.where("open").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    if not undecided.isEmpty():
        sure = stage.cut(_exact(undecided, rows.where("id IS NOT NULL"), cosine), narrow=True)
        weight = classes.select("rep", "copies")
        for one, two in (("a", "b"), ("b", "a")):
            links = links.union(sure.join(weight.withColumnRenamed("rep", two), two).select(one, "copies"))
        edges = edges.union(sure)
    comps = connected_components(edges, stage, "id", "other").withColumnRenamed("node", "rep")
    far = links.groupBy("id").agg(F.sum("links").alias("far")).withColumnRenamed("id", "rep")
    known = classes.select("d1", "d2", "rep", "copies").join(far, "rep", "left").join(comps, "rep", "left")
    known = stage.cut(known.select("d1", "d2", "copies", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c")), narrow=True)
    every = _ids(rows)
    live = F.col("usable") & F.col("id").isNotNull()
    joined = spread_join(every.where(live), known, ["d1", "d2"], "copies", counted["rows"] or 0)
    alone = every.where(~live).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    out = joined.select("id", "n", "c").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))

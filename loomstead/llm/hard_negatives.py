"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors become integers (``floor(scale * x)``), and a score is their inner product. With one more coordinate, the root
of what their squared length lacks of the largest one, a row at score s of a query lies at the squared distance
``M^2 + |q|^2 - 2 s``: a window of scores is an annulus, and higher scores are nearer. A tree over a bounded sample
parts the space into cells by distances to vantage points; every row is dealt to its cell, cells of more than ``BLOCK``
rows are cut by a hash of the id, and each block gets a tree of its own. A search visits the nearest cell that its
annulus meets first, then the others that may still hold something nearer than its k-th row; within a block it takes
leaves nearest first, and stops at the outer rim or where no leaf can be nearer than the k-th row. Scores are compared as
integers, distances only prune (with some slack), so the result is exact whatever the trees look like.

Searches are dealt too: ``CHUNK`` of them meet a copy of a block, so no group grows with the number of queries. A
search is one of rows of the query's label (positives) or of other labels within a window of scores (negatives).

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do
vectors whose squared integer length passes ``MOST`` (scores might not fit); of rows that share an id that of the least
label, then vector, takes part; vectors of different length have no score; an anchor without positives, or a positive
without negatives in its window, gives no rows; empty vectors score 0 with each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .staging import Stage

#: Squared length of an integer vector at most, so that 100 times a score is a long.
MOST = 1 << 55
EXACT = 1 << 52
BLOCK, LEAF, CHUNK = 8192, 256, 4096
#: Sampled rows for the tree of cells at most, and how many a cell needs.
SAMPLE, A_CELL = 32_768, 64
SLACK = 1e-6
NONE = -(1 << 62)
SEED = 41

ROW = "id bigint, label bigint, q binary, n2 bigint"
UNIT = ("a", "p", "label", "same", "lo", "hi", "least", "q")
UNIT_DDL = "a bigint, p bigint, label bigint, same boolean, lo bigint, hi bigint, least bigint, q binary"


def _unpacked(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, integer vectors) of packed vectors."""
    raw = column.to_pylist()
    sizes = np.array([len(r) for r in raw], np.int64) // 4
    return [(int(d), at := np.flatnonzero(sizes == d), np.frombuffer(b"".join(raw[i] for i in at), np.int32).reshape(len(at), d).astype(np.int64)) for d in np.unique(sizes)]


def as_integers(rows: DataFrame, scale: float) -> DataFrame:
    """(id, label, q, n2) of the rows that take part: packed integer vectors and their squared lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(2)
            sizes = np.asarray(vector.value_lengths().fill_null(0), np.int64)
            flat = vector.flatten().cast(pa.float64())
            x = np.floor(scale * flat.fill_null(float("nan")).to_numpy(zero_copy_only=False))
            rows_of = np.repeat(np.arange(len(sizes)), sizes)
            bad = ~np.isfinite(x) | (np.abs(x) >= 2.0**31)
            n2 = np.bincount(rows_of, np.where(bad, 0, x * x), len(sizes))
            fine = (np.bincount(rows_of, bad, len(sizes)) == 0) & (n2 <= MOST) & np.asarray(vector.is_valid())
            ints, end = np.where(bad, 0, x).astype(np.int32), np.cumsum(sizes)
            for d in np.unique(sizes[fine]):
                at = np.flatnonzero(fine & (sizes == d))
                q = ints[(end[at] - d)[:, None] + np.arange(d)]
                wide = q.astype(np.int64)
                keep = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array([v.tobytes() for v in q], pa.binary()), pa.array((wide * wide).sum(1))], ["id", "label", "q", "n2"])

    return rows.mapInArrow(run, ROW)


def _distances(x: np.ndarray, x2: np.ndarray, up: np.ndarray, points: np.ndarray, points2: np.ndarray, points_up: np.ndarray) -> np.ndarray:
    """Distances in the augmented space; ``up`` is the coordinate that was added."""
    square = x2[:, None] + (up * up)[:, None] + points2 + points_up * points_up - 2 * (x @ points.T + up[:, None] * points_up)
    return np.sqrt(np.maximum(square, 0))


def _lift(n2: np.ndarray, most: int) -> np.ndarray:
    return np.sqrt(np.maximum(most - n2.astype(float), 0))


@dataclass
class Tree:
    """Vantage points, and for every leaf the rings around them that hold its rows (dmin, dmax; 0 and inf where none)."""

    points: np.ndarray
    n2: np.ndarray
    up: np.ndarray
    #: [leaf, point]
    inner: np.ndarray
    outer: np.ndarray
    #: (point, radius, nearer child, further child) of inner nodes, leaves as ~leaf.
    nodes: list[tuple[int, float, int, int]]
    members: list[np.ndarray]

    @property
    def leaves(self) -> int:
        return len(self.inner)

    def reach(self, x: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, leaf]: least and largest distance that rows of the leaf can have; queries have no added coordinate."""
        near, far = np.zeros((len(x), self.leaves)), np.full((len(x), self.leaves), np.inf)
        if len(self.points):
            d = _distances(x, x2, np.zeros(len(x)), self.points, self.n2, self.up)
            for leaf in range(self.leaves):
                at = np.flatnonzero((self.inner[leaf] > 0) | np.isfinite(self.outer[leaf]))
                if len(at):
                    near[:, leaf] = np.maximum(d[:, at] - self.outer[leaf, at], self.inner[leaf, at] - d[:, at]).max(1)
                    far[:, leaf] = (d[:, at] + self.outer[leaf, at]).min(1)
        return np.maximum(near, 0), far

    def leaf_of(self, x: np.ndarray, x2: np.ndarray, up: np.ndarray) -> np.ndarray:
        """The leaf a row belongs to by the radii."""
        at = np.zeros(len(x), np.int64) if self.nodes else np.full(len(x), -1)
        if self.nodes:
            d = _distances(x, x2, up, self.points, self.n2, self.up)
            point, radius, one, two = (np.array(v) for v in zip(*self.nodes, strict=True))
            while (at >= 0).any():
                live = np.flatnonzero(at >= 0)
                node = at[live]
                at[live] = np.where(d[live, point[node]] <= radius[node], one[node], two[node])
        return ~at


def grow(x: np.ndarray, n2: np.ndarray, up: np.ndarray, leaf: int, leaves: int, seed: int, by_radius: bool) -> Tree:
    """A tree of halves by distance to a vantage point.

    ``by_radius``: halves are told by the radius, so that other rows can be dealt; else by order, so that equal
    distances don't matter, with the rings that the rows really have.
    """
    rng = np.random.default_rng([seed, len(x)])
    points, nodes, done = [], [], []
    open_ = [(np.arange(len(x)), None, [])]
    count = 1
    while open_:
        rows, parent, path = open_.pop(0)
        split = None
        if len(rows) > leaf and count < leaves:
            v = rows[rng.integers(len(rows))]
            d = _distances(x[rows], n2[rows], up[rows], x[v : v + 1], n2[v : v + 1], up[v : v + 1])[:, 0]
            order = np.argsort(d, kind="stable")
            middle = len(rows) // 2
            radius = float(d[order[middle - 1]])
            if by_radius:
                middle = int((d <= radius).sum())
            if 0 < middle < len(rows):
                split = (rows[order[:middle]], rows[order[middle:]], v, radius, d[order])
        here = len(nodes) if split else ~len(done)
        if parent is not None:
            node, side = parent
            nodes[node][side] = here
        if split is None:
            done.append((rows, path))
            continue
        near, far, v, radius, d = split
        nodes.append([len(points), radius, 0, 0])
        ring = [(0.0, radius), (radius, np.inf)] if by_radius else [(d[0], d[len(near) - 1]), (d[len(near)], d[-1])]
        open_ += [(near, (len(nodes) - 1, 2), [*path, (len(points), *ring[0])]), (far, (len(nodes) - 1, 3), [*path, (len(points), *ring[1])])]
        points.append(v)
        count += 1
    inner, outer = np.zeros((len(done), len(points))), np.full((len(done), len(points)), np.inf)
    for i, (_, path) in enumerate(done):
        for p, least, most in path:
            inner[i, p], outer[i, p] = least, most
    return Tree(x[points], n2[points], up[points], inner, outer, [tuple(n) for n in nodes], [rows for rows, _ in done])


@dataclass
class Cells:
    """A tree of cells for each dimension that the sample has; other dimensions are one cell."""

    trees: dict[int, Tree]
    most: int

    def of_rows(self, dim: int, x: np.ndarray, n2: np.ndarray) -> np.ndarray:
        tree = self.trees.get(dim)
        leaf = tree.leaf_of(x.astype(float), n2.astype(float), _lift(n2, self.most)) if tree else np.zeros(len(x), np.int64)
        return (dim << 32) + leaf

    def of_units(self, dim: int, x: np.ndarray, n2: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(unit, cell): the nearest cell that the annulus meets, or all others it has to visit."""
        tree = self.trees.get(dim)
        if tree is None:
            return (np.arange(len(x)) if first else np.zeros(0, np.int64)), np.full(len(x) if first else 0, dim << 32)
        slack = SLACK * (self.most**0.5 + 1)
        near, far = tree.reach(x.astype(float), n2.astype(float))
        begin, end = (np.sqrt(np.maximum(self.most + n2 - 2.0 * s, 0)) for s in (hi, lo))
        meets = (near <= end[:, None] + slack) & (far >= begin[:, None] - slack)
        chosen = np.where(meets, near, np.inf).argmin(1)
        some = meets.any(1)
        if first:
            return np.flatnonzero(some), (dim << 32) + chosen[some]
        bound = np.sqrt(np.maximum(self.most + n2 - 2.0 * least, 0))
        meets &= near <= bound[:, None] + slack
        meets[np.arange(len(x)), chosen] = False
        unit, leaf = np.nonzero(meets)
        return unit, (dim << 32) + leaf


def search_block(tree: Tree, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: int, units: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, id, score) of the first k rows of each unit, by leaves nearest first."""
    x = units["x"]
    x2 = (x * x).sum(1)
    exact = float if most <= EXACT and (x2 <= EXACT).all() else np.int64
    slack = SLACK * (most**0.5 + 1)
    near, far = tree.reach(x.astype(float), x2.astype(float))
    order = np.argsort(near, axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    begin, end = (np.sqrt(np.maximum(most + x2 - 2.0 * units[s], 0)) for s in ("hi", "lo"))
    score, found = np.full((len(x), k), NONE, np.int64), np.zeros((len(x), k), np.int64)
    rows, asks = q.astype(exact), x.astype(exact)
    open_ = np.arange(len(x))
    for step in range(tree.leaves):
        worst = np.maximum(score[open_, k - 1], units["least"][open_])
        limit = np.minimum(np.sqrt(np.maximum(most + x2[open_] - 2.0 * worst, 0)), end[open_])
        open_ = open_[near[open_, step] <= limit + slack]
        if not len(open_):
            break
        leaf = order[open_, step]
        meets = far[open_, leaf] >= begin[open_] - slack
        asking, leaf = open_[meets], leaf[meets]
        got = []
        by_leaf = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(leaf[by_leaf]) != 0, True]) if len(leaf) else []
        for i in range(len(edges) - 1):
            who, members = asking[by_leaf[edges[i] : edges[i + 1]]], tree.members[leaf[by_leaf[edges[i]]]]
            s = (asks[who] @ rows[members].T).astype(np.int64)
            fits = (labels[members] == units["label"][who][:, None]) == units["same"][who][:, None]
            fits &= (s >= units["lo"][who][:, None]) & (s <= units["hi"][who][:, None]) & (ids[members] != units["a"][who][:, None])
            fits &= s >= np.maximum(score[who, k - 1], units["least"][who])[:, None]
            u, m = np.nonzero(fits)
            got.append((who[u], s[u, m], ids[members[m]]))
        if not got:
            continue
        u, s, i = (np.concatenate(v) for v in zip(*got, strict=True))
        touched = np.unique(u)
        held = score[touched] > NONE
        u, s, i = np.r_[u, np.repeat(touched, held.sum(1))], np.r_[s, score[touched][held]], np.r_[i, found[touched][held]]
        best = np.lexsort((i, -s, u))
        u, s, i = u[best], s[best], i[best]
        head = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        rank = np.arange(len(u)) - np.repeat(head, np.diff(np.r_[head, len(u)]))
        keep = rank < k
        score[u[keep], rank[keep]], found[u[keep], rank[keep]] = s[keep], i[keep]
    unit, rank = np.nonzero(score > NONE)
    return unit, found[unit, rank], score[unit, rank]


class Index:
    """All rows, dealt to cells; ``search`` answers units of UNIT."""

    def __init__(self, rows: DataFrame, stage: Stage):
        self.rows, self.stage = rows, stage
        counted = rows.agg(F.count("*").alias("n"), F.max("n2").alias("most")).first()
        self.n, most = counted["n"], counted["most"] or 0
        wanted = max(1, min(SAMPLE // A_CELL, -(-self.n // BLOCK)))
        trees: dict[int, Tree] = {}
        if wanted > 1:
            steps = 1 << 30
            share = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(steps)) < int(steps * min(1.0, wanted * A_CELL * 4 / self.n))
            got = sorted((r["id"], bytes(r["q"])) for r in rows.where(share).select("id", "q").limit(SAMPLE).collect())  # bounded by SAMPLE
            for dim, _, x in _unpacked(pa.array([q for _, q in got], pa.binary())):
                x2 = (x * x).sum(1)
                trees[dim] = grow(x.astype(float), x2.astype(float), _lift(x2, most), A_CELL // 2, wanted, SEED, True)
        self.cells = Cells(trees, most)
        cells = self.cells

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at, x in _unpacked(batch.column(2)):
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.of_rows(dim, x, part.column(3).to_numpy())), *part.columns], ["cell", *part.schema.names])

        self.dealt = stage.cut(rows.mapInArrow(deal, "cell bigint, " + ROW))
        self.sizes = self.dealt.groupBy("cell").agg(F.count("*").alias("size"))

    def _requests(self, units: DataFrame, first: bool) -> DataFrame:
        cells = self.cells

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at, x in _unpacked(batch.column("q")):
                    lo, hi, least = (batch.column(c).to_numpy()[at] for c in ("lo", "hi", "least"))
                    unit, cell = cells.of_units(dim, x, (x * x).sum(1), lo, hi, least, first)
                    for b in range(0, len(unit), 1 << 14):
                        part = batch.take(pa.array(at[unit[b : b + (1 << 14)]]))
                        yield pa.RecordBatch.from_arrays([pa.array(cell[b : b + (1 << 14)]), *part.columns], ["cell", *part.schema.names])

        return self.stage.cut(units.select(*UNIT).mapInArrow(route, "cell bigint, " + UNIT_DDL))

    def _answers(self, requests: DataFrame, k: int) -> DataFrame:
        most = self.cells.most
        asked = requests.groupBy("cell").agg(F.count("*").alias("asked"))
        # One row a cell. Requests repeat a vector for every cell, so their files are small and would be broadcast by size.
        info = F.broadcast(self.sizes.join(asked.hint("merge"), "cell").select("cell", F.ceil(F.col("size") / BLOCK).alias("pieces"), F.ceil(F.col("asked") / CHUNK).alias("chunks")))
        here = self.dealt.join(info, "cell").select(
            "cell", F.pmod(F.xxhash64("id", F.lit(1)), "pieces").alias("piece"), F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "label", "q", "n2",
        )
        there = requests.join(info, "cell").select("cell", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("a", "p", F.lit(2)), "chunks").alias("chunk"), *UNIT)

        def answer(block: pa.Table, asking: pa.Table) -> pa.Table:
            none = np.zeros(0, np.int64)
            out = [none] * 4
            if block.num_rows and asking.num_rows:
                ((_, _, q),) = _unpacked(block.column("q").combine_chunks())
                ((_, _, x),) = _unpacked(asking.column("q").combine_chunks())
                n2 = block.column("n2").to_numpy()
                tree = grow(q.astype(float), n2.astype(float), _lift(n2, most), LEAF, len(q), SEED, False)
                units = {c: asking.column(c).to_numpy() for c in ("a", "p", "label", "same", "lo", "hi", "least")} | {"x": x}
                unit, ids, scores = search_block(tree, q, block.column("id").to_numpy(), block.column("label").to_numpy(), most, units, k)
                out = [units["a"][unit], units["p"][unit], ids, scores]
            return pa.table([pa.array(v, pa.int64()) for v in out], ["a", "p", "id", "score"])

        keys = ("cell", "piece", "chunk")
        return here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(answer, "a bigint, p bigint, id bigint, score bigint")

    def search(self, units: DataFrame, k: int) -> DataFrame:
        """(a, p, id, score, rank) of the first k rows of each unit, rank from 1."""
        found = self.stage.cut(self._answers(self._requests(units, True), k), narrow=True)
        if any(t.leaves > 1 for t in self.cells.trees.values()):
            enough = found.groupBy("a", "p").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).select("a", "p", "kth")
            bounded = units.join(enough.hint("merge"), ["a", "p"], "left").withColumn("least", F.coalesce("kth", "least")).drop("kth")
            found = found.union(self._answers(self._requests(bounded, False), k))
        rank = F.row_number().over(_first_of())
        return self.stage.cut(found.withColumn("rank", rank).where(F.col("rank") <= k), narrow=True)


def _first_of():
    from pyspark.sql import Window

    return Window.partitionBy("a", "p").orderBy(F.desc("score"), "id")


def mine(
    vectors: DataFrame, anchors: Callable = lambda i: i % 50 == 0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For every row that ``anchors`` chooses by its id and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    stage = Stage(vectors.sparkSession, "negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    kept = as_integers(rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"), scale)
    one = kept.groupBy("id").agg(F.min(F.struct("label", "q", "n2")).alias("r"))
    index = Index(stage.cut(one.select("id", "r.label", "r.q", "r.n2")), stage)
    asking = index.rows.where(anchors(F.col("id"))).select(F.col("id").alias("a"), "label", "q")
    wide = [F.lit(NONE).alias("lo"), F.lit(-NONE).alias("hi"), F.lit(NONE).alias("least")]
    same = index.search(asking.select("a", F.col("a").alias("p"), "label", F.lit(True).alias("same"), *wide, "q"), positives)
    pairs = same.select("a", F.col("id").alias("p"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    # Below 0 the window has its ends crossed and holds nothing.
    window = [F.expr(f"({low} * positive_score + 99) DIV 100").alias("lo"), F.expr(f"({high} * positive_score) DIV 100").alias("hi"), F.lit(NONE).alias("least")]
    units = stage.cut(pairs.join(asking.hint("merge"), "a").select("a", "p", "label", F.lit(False).alias("same"), *window, "q").where("lo <= hi"))
    other = index.search(units, negatives)
    return other.join(pairs.hint("merge"), ["a", "p"]).select(
        F.col("a").alias("anchor_id"), F.col("p").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )

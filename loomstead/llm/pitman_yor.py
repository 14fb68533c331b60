"""Language-model scores from a hierarchical Pitman-Yor bigram model.

Every word is a context with its own restaurant; all share one parent restaurant, whose
base is uniform over the vocabulary and one unknown word. Table counts are sampled by
Gibbs: a customer of (context, word) leaves - alone at its table with probability
``S(c-1, t-1) / S(c, t)``, S the generalised Stirling numbers - and is seated anew at an old table
with weight ``c - 1 - d t`` or a new one with ``(theta + d t_context) P_parent(word)``. After
burn-in the table counts of ``SAMPLES`` sweeps are averaged, and so is the predictive
probability that is linear in them.

Distribution. Texts are packed into blocks (once, where they are read). A block sends
its distinct (context, word) pairs with their training counts to parts, dealt by context.
A part seats its restaurants with a copy of the parent that its own contexts feed (the
approximate distributed scheme known from topic models), then sends each block the
counts it asked for and sends table counts per word on to parts dealt by word, where the
copies merge into the one parent. Blocks then score their texts. Counts are exact;
everything that travels is proportional to distinct pairs of blocks, never a whole
corpus in one place. A context with more than ``1 / HOT`` of all tokens is dealt by
(context, word) instead, as restaurants of their own whose table counts are added up.

Words in counts are 64-bit hashes; the words of a context are told apart by 40 bits.

Defined results: null and empty texts are one end token; a null doc_id is held out;
with nothing to learn from, N and V are 0, the base is log10(0.1 / 0.1) = 0 for each token
and so is the model's score; equal rows each get their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .staging import Stage
from .textbytes import CHUNK_BYTES, Texts, lowered, mix, runs, span_hashes, text_chunks, words

#: Discount and concentration of the parent and of the contexts; fixed hyper-parameters.
PARENT_D, PARENT_THETA = 0.7, 10.0
D, THETA = 0.85, 1.0
BURN_IN, SAMPLES = 3, 3
FOLDS = 10
BLOCK_BYTES = 8 << 20
HOT = 256
_EXACT = 128
_END, _START = np.uint64(0xE7D5C3B1A9978563), np.uint64(0x1F2E3D4C5B6A7988)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    values = np.ascontiguousarray(values)
    if not len(values):
        return b""
    return pa.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), "zstd", asbytes=True)


def loosen(raw: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def alone_table(d: float, top: int = _EXACT) -> np.ndarray:
    """[c, t]: probability that a random customer of c at t tables sits alone."""
    log = np.full((top + 1, top + 2), -np.inf)
    log[0, 0] = log[1, 1] = 0.0
    for c in range(2, top + 1):
        t = np.arange(1, c + 1)
        log[c, 1 : c + 1] = np.logaddexp(log[c - 1, 0:c], log[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - d * t, 1e-300)))
    out = np.zeros((top + 1, top + 2))
    less, now = log[:-1, 0:top], log[1:, 1 : top + 1]
    real = np.isfinite(less) & np.isfinite(now)
    out[1:, 1:-1][real] = np.exp(np.minimum(less[real] - now[real], 0))
    return out


class Seating:
    """Table counts of many (restaurant, dish) pairs, moved by Gibbs sweeps."""

    def __init__(self, customers: np.ndarray, d: float, theta: float, rng: np.random.Generator):
        self.c, self.d, self.theta, self.rng = customers.astype(np.int64), d, theta, rng
        self.t = np.minimum(self.c, 1)
        self.alone = alone_table(d)

    def spread(self, room: np.ndarray, parent: np.ndarray) -> None:
        """Start from the tables that seating one by one would give on average."""
        weight = room * parent
        self.t = np.clip(np.rint(1 + weight * np.log((weight + self.c) / (weight + 1))), 1, self.c).astype(np.int64)

    def sweep(self, tables_here: np.ndarray, parent: np.ndarray) -> None:
        """Move as many customers of each pair as it has; ``tables_here``: of the pair's restaurant.

        Most moves leave the table count as it was. How many pass until one doesn't is geometric
        while the count stands still, so only moves that change it are drawn.
        """
        at = np.flatnonzero(self.c > 1)
        c, t, left = self.c[at], self.t[at], self.c[at].astype(float)
        other, above = (tables_here - self.t)[at], parent[at]
        while len(at):
            lone = np.where(c <= _EXACT, self.alone[np.minimum(c, _EXACT), np.minimum(t, _EXACT)], self.d * (t - 1) / c)
            lone = np.where(t < c, lone, 1.0)
            up = (1 - lone) * self._fresh(c, t, other + t, above)
            down = lone * (1 - self._fresh(c, t - 1, other + t - 1, above))
            change = np.minimum(up + down, 1.0)
            with np.errstate(divide="ignore"):
                left -= 1 + np.floor(np.log1p(-self.rng.random(len(at))) / np.log1p(-np.maximum(change, 1e-300)))
            t = np.where(left < 0, t, np.where(self.rng.random(len(at)) * change < up, t + 1, t - 1))
            done = left < 1
            if done.any():
                self.t[at[done]] = t[done]
                at, c, t, left, other, above = (x[~done] for x in (at, c, t, left, other, above))

    def _fresh(self, c: np.ndarray, t: np.ndarray, tables_here: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Chance that the one customer who is up opens a table, where the others sit at ``t``."""
        fresh = (self.theta + self.d * tables_here) * parent
        return fresh / (fresh + np.maximum(c - 1 - self.d * t, 0))


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end for each row, the token before each, and rows."""
    data = lowered(texts.data)
    starts, ends, at = words(texts, data)
    n = len(texts)
    counts = np.bincount(at, minlength=n)
    out = np.empty(len(starts) + n, np.uint64)
    out[np.arange(len(starts)) + at] = span_hashes(data, starts, ends)
    last = np.cumsum(counts + 1) - 1
    out[last] = _END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[last - counts] = _START
    return out, before, np.repeat(np.arange(n), counts + 1)


class Block:
    """A packed block: tokens of its texts and its distinct words and pairs, sorted."""

    def __init__(self, row: dict, hot: dict[int, int]):
        sizes = np.frombuffer(row["sizes"], np.int64)
        raw = pa.decompress(row["texts"], int(sizes.sum()), "zstd", asbytes=True) if sizes.sum() else b""
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.held = np.frombuffer(row["held"], bool)
        found = []
        lo = 0
        for t in text_chunks(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(raw)])):
            token, before, at = tokens(t)
            found.append((token, before, at + lo))
            lo += len(t)
        self.token, self.before, self.row = (np.concatenate(x) for x in zip(*found, strict=True))
        self.train = ~self.held[self.row]
        self.hot = hot

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        names, self.word = np.unique(self.token, return_inverse=True)
        return names, np.bincount(self.word, self.train, minlength=len(names)).astype(np.int64)

    def distinct_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, words (40 bits) and training counts; ``self.pair`` has each token's."""
        context, word = self.before, self.token >> np.uint64(24)
        for name, pieces in self.hot.items():
            here = context == np.uint64(name)
            if here.any():
                context = context.copy() if context is self.before else context
                context[here] = piece_of(np.uint64(name), word[here] % np.uint64(pieces))
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = np.r_[True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])]
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = which
        return context[first], word[first], np.bincount(which, self.train[order], minlength=len(first)).astype(np.int64)


def piece_of(name: np.uint64, piece: np.ndarray) -> np.ndarray:
    return mix(np.asarray(piece, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + name)


def part_of(hashes: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Parts are ranges of the hash, so sorted hashes are dealt in runs."""
    return ((hashes >> np.uint64(bits - 24)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


_PACKED = "block bigint, n int, ids binary, known binary, held binary, sizes binary, texts binary, n_train bigint, train_docs bigint, frequent array<bigint>, times array<bigint>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for t in text_chunks(batch.column(1), BLOCK_BYTES):
            part = batch.slice(t.lo, len(t))
            held = np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)
            names, times, n_train = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
            for s in text_chunks(part.column(1), CHUNK_BYTES):
                token, _, at = tokens(s)
                token = token[~held[s.lo + at]]
                n_train += len(token)
                names, counted = np.unique(np.r_[names, token], return_inverse=True)
                weights = np.r_[times, np.ones(len(token), np.int64)]
                times = np.bincount(counted, weights, minlength=len(names)).astype(np.int64)
            often = times * 4 * HOT >= max(n_train, 1)
            ids = part.column(0)
            row = {
                "block": number, "n": len(t), "ids": ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), "known": np.asarray(ids.is_valid()).tobytes(), "held": held.tobytes(),
                "sizes": np.diff(t.offsets).astype(np.int64).tobytes(), "texts": pa.compress(t.data.tobytes(), "zstd", asbytes=True) if len(t.data) else b"", "n_train": n_train,
                "train_docs": int((~held).sum()), "frequent": names[often].view(np.int64).tolist(), "times": times[often].tolist(),
            }
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))
            number += 1


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(schema)], [n for n, _ in schema])


_PAIRS = [("part", pa.int64()), ("block", pa.int64()), ("n_contexts", pa.int32()), ("n_pairs", pa.int32()), ("contexts", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())]
_WORDS = [("part", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]
_REPLY = [("kind", pa.int32()), ("to", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n2", pa.int32()), ("c", pa.binary())]
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}


def _ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"`{n}` {_SQL[k]}" for n, k in schema)


def _send_pairs(parts: int, hot: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                context, word, count = Block(row, hot).distinct_pairs()
                out = []
                for a, b in runs(part_of(context, parts)):
                    edges = runs(context[a:b])
                    names = context[a:b][[x for x, _ in edges]]
                    out.append((int(part_of(context[a : a + 1], parts)[0]), row["block"], len(names), b - a, squeeze(names), squeeze(np.array([y - x for x, y in edges], np.uint32)), squeeze(word[a:b]), squeeze(count[a:b].astype(np.uint32))))
                if out:
                    yield _rows(_PAIRS, out)

    return run


def _send_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, count = Block(row, {}).distinct_words()
                out = [(int(part_of(names[a : a + 1], parts)[0]), row["block"], b - a, squeeze(names[a:b]), squeeze(count[a:b].astype(np.uint32))) for a, b in runs(part_of(names, parts))]
                if out:
                    yield _rows(_WORDS, out)

    return run


def _seat(parts: int, hot: dict[int, int]):
    """One part of the contexts: counts and table counts back to blocks (kind 0), on to words (1), of hot contexts (2)."""
    pieces = {int(piece_of(np.uint64(name), np.array([k]))[0]): name for name, n in hot.items() for k in range(n)}

    def run(table: pa.Table) -> pa.Table:
        sent = table.sort_by("block").to_pylist()
        part = sent[0]["part"]
        names = [loosen(r["contexts"], np.uint64, r["n_contexts"]) for r in sent]
        sizes = [loosen(r["sizes"], np.uint32, r["n_contexts"]).astype(np.int64) for r in sent]
        word = np.concatenate([loosen(r["words"], np.uint64, r["n_pairs"]) for r in sent])
        count = np.concatenate([loosen(r["counts"], np.uint32, r["n_pairs"]) for r in sent]).astype(np.int64)
        every, which = np.unique(np.concatenate(names), return_inverse=True)
        context = np.repeat(which, np.concatenate(sizes))
        order = np.lexsort((word, context))
        new = np.r_[True, (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])]
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        lead = order[new]
        c = np.bincount(pair, count).astype(np.int64)
        seen = np.flatnonzero(c)
        sums = np.zeros(len(c), np.int64)
        at, dish = context[lead][seen], word[lead][seen]
        dishes, dish = np.unique(dish, return_inverse=True)
        if len(seen):
            rng = np.random.default_rng([5, int(part)])
            seats, above = Seating(c[seen], D, THETA, rng), None
            for sweep in range(BURN_IN + SAMPLES):
                here = np.bincount(at, seats.t, minlength=len(every))
                up = np.bincount(dish, seats.t, minlength=len(dishes))
                if above is None:
                    above = Seating(up, PARENT_D, PARENT_THETA, rng)
                above.c = up.astype(np.int64)
                above.t = np.clip(above.t, 1, above.c)
                above.sweep(np.full(len(dishes), above.t.sum()), np.full(len(dishes), 1 / (len(dishes) + 1)))
                whole = PARENT_THETA + above.c.sum()
                parent = (above.c - PARENT_D * above.t) / whole + (PARENT_THETA + PARENT_D * above.t.sum()) / whole / (len(dishes) + 1)
                if not sweep:
                    seats.spread(THETA + D * here[at], parent[dish])
                seats.sweep(np.bincount(at, seats.t, minlength=len(every))[at], parent[dish])
                if sweep >= BURN_IN:
                    sums[seen] += seats.t
        of_context = np.bincount(context[lead], sums, minlength=len(every)).astype(np.int64)
        out, done, begun = [], 0, 0
        for r in sent:
            a, b = done, done + r["n_pairs"]
            out.append((0, r["block"], part, r["n_pairs"], squeeze(c[pair[a:b]].astype(np.uint32)), squeeze(sums[pair[a:b]].astype(np.uint32)), r["n_contexts"], squeeze(of_context[which[begun : begun + r["n_contexts"]]])))
            done, begun = b, begun + r["n_contexts"]
        if len(seen):
            tables = np.bincount(dish, sums[seen]).astype(np.int64)
            for a, b in runs(part_of(dishes, parts, 40)):
                out.append((1, int(part_of(dishes[a : a + 1], parts, 40)[0]), part, b - a, squeeze(dishes[a:b]), squeeze(tables[a:b]), 0, b""))
        for k in [i for i, name in enumerate(every.tolist()) if name in pieces]:
            out.append((2, int(np.int64(np.uint64(pieces[int(every[k])]).view(np.int64))), part, int(k), b"", b"", int(min(of_context[k], 2**31 - 1)), b""))
        return pa.Table.from_batches([_rows(_REPLY, out)])

    return run


def _parent(parts: int):
    """One part of the words: counts, tables and parent tables to blocks (kind 3), totals (4)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, fed = left.sort_by("block").to_pylist(), right.sort_by("part").to_pylist()
        if not asked:
            return pa.Table.from_batches([_rows(_REPLY, [])])
        part = asked[0]["part"]
        names = np.concatenate([loosen(r["words"], np.uint64, r["n"]) for r in asked])
        count = np.concatenate([loosen(r["counts"], np.uint32, r["n"]) for r in asked]).astype(np.int64)
        every, which = np.unique(names, return_inverse=True)
        c = np.bincount(which, count).astype(np.int64)
        tables = np.zeros(len(every), np.int64)
        for r in fed:
            w, t = loosen(r["a"], np.uint64, r["n"]), loosen(r["b"], np.int64, r["n"])
            spot = np.minimum(np.searchsorted(every >> np.uint64(24), w), len(every) - 1)
            good = (every >> np.uint64(24))[spot] == w
            np.add.at(tables, spot[good], t[good])
        mean = np.maximum(np.rint(tables / SAMPLES).astype(np.int64), (c > 0).astype(np.int64))
        known = np.flatnonzero(mean)
        up = np.zeros(len(every), np.int64)
        if len(known):
            seats = Seating(mean[known], PARENT_D, PARENT_THETA, np.random.default_rng([6, int(part)]))
            n_words = max(1, len(known) * parts)
            for sweep in range(BURN_IN + SAMPLES):
                seats.sweep(np.full(len(known), seats.t.sum() * parts), np.full(len(known), 1 / (n_words + 1)))
                if sweep >= BURN_IN:
                    up[known] += seats.t
        out, done = [], 0
        for r in asked:
            here = which[done : done + r["n"]]
            out.append((3, r["block"], part, r["n"], squeeze(c[here].astype(np.uint64)), squeeze(mean[here].astype(np.uint64)), r["n"], squeeze(up[here].astype(np.uint64))))
            done += r["n"]
        totals = np.array([(c > 0).sum(), c.sum(), mean.sum(), up.sum()], np.int64)
        out.append((4, 0, part, 4, totals.tobytes(), b"", 0, b""))
        return pa.Table.from_batches([_rows(_REPLY, out)])

    return run


def _score(hot: dict[int, int], hot_tables: dict[int, float], n_words: int, n_tokens: int, n_tables: int, n_parent: float, train_docs: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        got = right.sort_by("part").to_pylist()
        for row in left.to_pylist():
            block = Block(row, hot)
            block.distinct_words()
            names = [r for r in got if r["kind"] == 3]
            word = [np.concatenate([loosen(r[k], np.uint64, r["n"]) for r in names]).astype(float) for k in ("a", "b", "c")]
            context, _, _ = block.distinct_pairs()
            pairs = [r for r in got if r["kind"] == 0]
            c, t = (np.concatenate([loosen(r[k], np.uint32, r["n"]) for r in pairs]).astype(float)[block.pair] for k in ("a", "b"))
            here = np.concatenate([loosen(r["c"], np.int64, r["n2"]) for r in pairs]) / SAMPLES
            change = np.r_[True, context[1:] != context[:-1]]
            here = here[np.cumsum(change) - 1][block.pair]
            for name, value in hot_tables.items():
                here[block.before == np.uint64(name & (2**64 - 1))] = value
            own = word[0][block.word]
            above = np.empty(len(own))
            above[1:] = own[:-1]
            above[block.before == _START] = train_docs
            whole = PARENT_THETA + n_tables
            parent = ((word[1] - PARENT_D * word[2] / SAMPLES) / whole + (PARENT_THETA + PARENT_D * n_parent) / whole / (n_words + 1))[block.word]
            p = (np.maximum(c - D * t / SAMPLES, 0) + (THETA + D * here) * parent) / (THETA + above)
            n = len(block.ids)
            add = lambda v: np.bincount(block.row, v, minlength=n)  # noqa: E731, B023
            out["doc_id"] += [int(i) if k else None for i, k in zip(block.ids, block.known, strict=True)]
            out["held_out"] += block.held.tolist()
            out["n_tokens"] += np.bincount(block.row, minlength=n).tolist()
            out["n_known"] += add(own > 0).astype(np.int64).tolist()
            out["base_score"] += add(np.log10((own + 0.1) / (n_tokens + 0.1 * (n_words + 1)))).tolist()
            out["score"] += add(np.log10(p)).tolist()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row."""
    spark = docs.sparkSession
    stage = Stage(spark, "pitman-yor")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))
    packed = stage.cut(docs.select(F.col(id_col).cast("long"), text_col, held.alias("held")).mapInArrow(_pack, _PACKED))
    head = packed.agg(F.count("*").alias("blocks"), F.sum("n_train").alias("tokens"), F.sum("train_docs").alias("docs")).first()
    parts, n_all = max(16, head["blocks"]), head["tokens"] or 0
    pairs_of = packed.select(F.explode_outer(F.arrays_zip("frequent", "times")).alias("e")).where("e IS NOT NULL")
    often = pairs_of.groupBy("e.frequent").agg(F.sum("e.times").alias("n")).where(F.col("n") * HOT > n_all).collect()  # at most HOT rows
    hot = {r["frequent"] & (2**64 - 1): max(2, -(-4 * parts * r["n"] // max(n_all, 1))) for r in often if n_all > HOT}
    asked = packed.mapInArrow(_send_pairs(parts, hot), _ddl(_PAIRS))
    seated = stage.cut(asked.groupBy("part").applyInArrow(_seat(parts, hot), _ddl(_REPLY)))
    stage.release()
    wanted = packed.mapInArrow(_send_words(parts), _ddl(_WORDS))
    tables = seated.where("kind = 1").withColumnRenamed("part", "from").withColumnRenamed("to", "part")
    parents = stage.cut(wanted.groupBy("part").cogroup(tables.withColumn("block", F.col("from")).groupBy("part")).applyInArrow(_parent(parts), _ddl(_REPLY)))
    stage.release()
    totals = np.zeros(4, np.int64)
    for r in parents.where("kind = 4").select("a").collect():  # one short row a part
        totals += np.frombuffer(bytes(r["a"]), np.int64)
    hot_tables = {r["to"]: r["t"] / SAMPLES for r in seated.where("kind = 2").groupBy("to").agg(F.sum("n2").alias("t")).collect()}
    replies = seated.where("kind = 0").unionByName(parents.where("kind = 3"))
    args = (hot, hot_tables, int(totals[0]), int(totals[1]), int(totals[2]), float(totals[3]) / SAMPLES, int(head["docs"] or 0))
    out = packed.groupBy("block").cogroup(replies.groupBy("to")).applyInArrow(_score(*args), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    out = out.withColumn("train_tokens", F.lit(int(totals[1])).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")

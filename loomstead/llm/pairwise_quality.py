"""Quality scores from pairwise preferences: a Bradley-Terry model over text features.

A document's strength is linear in features of its whole text. Labels give
preference pairs (a row marked 1 beats a row marked 0), the weights minimise the
logistic loss on feature differences (Newton steps, L2), and a quantile of the
training strengths is the threshold: the share of rows marked 0. Strengths become
scores by a logistic curve that is ``CUT`` at the threshold.

Fitting uses at most ``MAX_LABELLED`` labelled rows, chosen by a hash of doc_id, and
``PAIRS_EACH`` opponents of the other mark for each of them, on the driver; scoring runs
over all rows on the executors. Only the text enters a score.

Defined results: null and empty texts have the same features and get a score like any
other; a null doc_id is held out; of rows that share a labelled doc_id one, chosen by a hash of
its text, is learned from; labels that are null or of unknown documents are ignored; with labels of one
kind only, or none, all scores are 0.5; equal texts have equal scores, equal rows each
their row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textbytes import Texts, lowered, mix, span_hashes, text_chunks, words

MAX_LABELLED = 20_000
PAIRS_EACH = 10
#: Pairs whose differences are in memory at a time.
PAIR_CHUNK = 1 << 15
CUT = 0.3
FOLDS = 5

_CLASSES = ("lower", "upper", "high", "digit", "space", "newline", "comma", "stop", "pipe", "mark", "bracket", "symbol", "control")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"))
    table[:32] = table[127] = _CLASSES.index("control")
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1] = _CLASSES.index("lower"), _CLASSES.index("upper")
    table[128:], table[ord("0") : ord("9") + 1] = _CLASSES.index("high"), _CLASSES.index("digit")
    for name, chars in (("space", " \t"), ("newline", "\n\r"), ("comma", ",;:'\"-"), ("stop", "."), ("pipe", "|"), ("mark", "!?"), ("bracket", "()[]{}<>")):
        table[[ord(c) for c in chars]] = _CLASSES.index(name)
    return table


def features(texts: Texts) -> np.ndarray:
    """One row of bounded features for each text."""
    n, data, table = len(texts), texts.data, _class_table()
    size = np.diff(texts.offsets)
    row = np.repeat(np.arange(n), size)
    kinds = table[data]
    if len(data) > 1:  # capital letters of the Latin-1 block are two bytes
        kinds[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] = _CLASSES.index("upper")
    counts = np.bincount(row * len(_CLASSES) + kinds, minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    part = dict(zip(_CLASSES, counts.T / np.maximum(size, 1), strict=True))
    starts, ends, at = words(texts)
    n_words = np.bincount(at, minlength=n).astype(float)
    per_word = lambda flags: np.bincount(at, flags, minlength=n) / np.maximum(n_words, 1)
    hashes = span_hashes(lowered(data), starts, ends)
    shares = list(part.values())
    letters = np.maximum(part["lower"] + part["upper"] + part["high"], 1e-9)
    shares.append(np.minimum(part["upper"] / letters, 1))
    if len(starts):
        last, first, length = table[data[ends - 1]], table[data[starts]], (ends - starts).astype(float)
        odd = np.isin(last, [_CLASSES.index(c) for c in ("symbol", "mark", "pipe")])
        same = np.zeros(len(at), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])

        def distinct(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
            _, kept = np.unique(values ^ mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True)
            return np.bincount(rows[kept], minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)

        pairs = mix(hashes[:-1] + np.uint64(7)) + hashes[1:]
        inside = at[1:] == at[:-1]
        shares += [
            per_word(odd), per_word(same), 1 - distinct(hashes, at), 1 - distinct(pairs[inside], at[:-1][inside]), per_word(length == 1), per_word(length > 20),
            per_word(first == _CLASSES.index("upper")), per_word(np.isin(last, [_CLASSES.index("stop"), _CLASSES.index("comma")])), np.minimum(per_word(length) / 30, 1),
        ]
    else:
        shares += [np.zeros(n)] * 9
    shares = np.clip(np.array(shares).T, 0, 1)
    long_ = np.log1p(n_words)[:, None] / 10
    return np.hstack([shares, np.sqrt(shares), long_, long_**2, (n_words == 0)[:, None]])


@dataclass
class Model:
    """Weights on standardised features and the strength at which a score is CUT."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        shift = np.log(CUT / (1 - CUT)) if self.spread else 0.0
        z = (strength - self.threshold) / (self.spread or 1.0) + shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, l2: float = 1e-3) -> Model:
    """Newton steps on mean log(1 + exp(-w (x_winner - x_loser))) + l2 / 2 |w|^2."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = x.shape[1]
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    losers = np.r_[np.repeat(bad, PAIRS_EACH), rng.choice(bad, len(good) * PAIRS_EACH)]
    winners = np.r_[rng.choice(good, len(bad) * PAIRS_EACH), np.repeat(good, PAIRS_EACH)]
    chunks = [slice(lo, lo + PAIR_CHUNK) for lo in range(0, len(winners), PAIR_CHUNK)]
    w = np.zeros(d)

    def loss(v: np.ndarray) -> float:
        s = z @ v
        return float(np.logaddexp(0, s[losers] - s[winners]).mean() + l2 / 2 * v @ v)

    for _ in range(30):
        gradient, hessian = l2 * w, l2 * np.eye(d)
        for chunk in chunks:
            diff = z[winners[chunk]] - z[losers[chunk]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))
            gradient = gradient - diff.T @ p / len(winners)
            hessian += (diff.T * (p * (1 - p))) @ diff / len(winners)
        step, t = np.linalg.solve(hessian, gradient), 1.0
        while loss(w - t * step) > loss(w) and t > 1e-4:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    strength = z @ w
    share = len(bad) / (len(bad) + len(good))
    return Model(mean, scale, w, float(np.quantile(strength, share)), float(max(strength.std() / 4, 1e-9)))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, "quality")
    sample = usable.orderBy(F.xxhash64(id_col), id_col, "quality").limit(MAX_LABELLED)
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)  # bounded by MAX_LABELLED
    place = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_chunks(batch.column(place)):
                x = features(t)
                key = pa.array(span_hashes(t.data, t.offsets[:-1], t.offsets[1:]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, len(t)), batch.column(2).slice(t.lo, len(t)), key, pa.array(list(x), pa.list_(pa.float64()))], [id_col, "quality", "k", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"`{id_col}` {kind}, quality {labels.schema['quality'].dataType.simpleString()}, k bigint, x array<double>")
    got = found.groupBy(id_col, "quality").agg(F.min_by("x", "k").alias("x")).collect()  # bounded by MAX_LABELLED
    got.sort(key=lambda r: (r[id_col], r["quality"]))
    x = np.array([r["x"] for r in got]) if got else np.zeros((0, 1))
    return fit(x, np.array([r["quality"] for r in got]))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", drop_text: bool = False) -> DataFrame:
    """``docs`` with a score between 0 and 1; optionally without the text."""
    place = docs.columns.index(text_col)
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(features(t)) if len(model.mean) > 1 else np.full(len(t), 0.5) for t in text_chunks(batch.column(place))]
            columns = [c for i, c in enumerate(batch.columns) if not (drop_text and i == place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found) if found else np.zeros(0))], [*(f.name for f in kept), name])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` double"]))

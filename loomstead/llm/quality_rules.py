"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

Every whole text is reduced to counts by one pass over its bytes: words, code points in words, symbols, lines that
repeat an earlier one, words in 8-word windows that are found twice. Two base rules reject at once. For the rest the
counts become shares, and an isolation forest says how anomalous a document is: in trees of random splits, built on
small samples of good rows, rows that stand apart have short paths. Splits are drawn from the box that good and bad
rows span, so bad rows that stand together are still apart from the good ones. The forest is fitted on at most
``MAX_FIT`` labelled rows; the threshold is the one that parts the labelled rows best (share of bad rows above it minus share of good rows
above it) among those that lose at most ``MOST_LOST`` of the good rows. All labelled rows count there, as a
histogram of ``BINS`` scores.

Defined results: null and empty texts have no words and fail the base rules; texts of any length are read whole; rows
that share an id, and rows with a null id, are rows of their own; without labelled rows of both kinds, or where no
threshold parts them, only the base rules reject; labels other than 0 and 1 are left out; other columns are ignored;
an empty table gives an empty table. Words, lines and windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .staging import Stage
from .textbytes import Texts, mix, span_hashes, text_chunks, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
#: Of 100 words, so many may stand in repeated windows.
MOST_REPEATED = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest looks at beside the counts; none grows with the length of a text.
EXTRA = ("n_lines", "n_upper", "n_letters", "n_odd_ends", "n_same")

#: Labelled rows that the forest is fitted on, at most.
MAX_FIT = 20_000
TREES, SAMPLE = 128, 1024
#: Share of the good labelled rows that a threshold may reject, at most.
MOST_LOST = 0.01
BINS = 2048
SEED = 29

_INK = np.ones(256, bool)
_INK[[32, *range(9, 14)]] = False
_IS = {name: np.isin(np.arange(256), list(values)) for name, values in {"symbol": SYMBOLS, "upper": range(65, 91), "letter": [*range(65, 91), *range(97, 123), *range(192, 256)]}.items()}
_SENTENCE = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b".,;:?)\"'"])


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _later(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (row, hash) have been there before."""
    _, first = np.unique(mix(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))), return_index=True)
    out = np.ones(len(rows), bool)
    out[first] = False
    return out


def counts(texts: Texts) -> np.ndarray:
    """[row, statistic] of COUNTS and EXTRA."""
    n, data, offsets = len(texts), texts.data, texts.offsets
    starts, ends, at = words(texts)
    sums = lambda table: _per_row(table[data], offsets)
    n_words = np.bincount(at, minlength=n)
    chars = _per_row(_INK[data] & ((data & 0xC0) != 0x80), offsets)

    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], breaks + 1])
    begins = begins[begins < len(data)]
    row = np.searchsorted(offsets[1:], begins, "right")
    stops = np.minimum(np.r_[begins[1:], len(data)], offsets[row + 1]) if len(begins) else begins
    stops = stops - ((stops > begins) & (data[stops - 1] == 10)) if len(begins) else stops
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_INK[data], out=inked[1:])
    full = inked[stops] > inked[begins]
    begins, stops, row = begins[full], stops[full], row[full]
    dup_lines = np.bincount(row[_later(row, span_hashes(data, begins, stops))], minlength=n)

    hashes = span_hashes(data, starts, ends)
    repeated = np.zeros(len(at) + 1, np.int64)
    if len(at) >= WINDOW:
        last = len(at) - WINDOW + 1
        key = mix(at[:last].astype(np.uint64) + np.uint64(1))
        for j in range(WINDOW):
            key = mix(key + np.uint64(j)) + hashes[j : last + j]
        whole = np.flatnonzero(at[:last] == at[WINDOW - 1 :])
        _, group, size = np.unique(key[whole], return_inverse=True, return_counts=True)
        twice = whole[size[group] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    in_window = np.cumsum(repeated[:-1]) > 0

    ends_odd = ~_SENTENCE[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    each = [
        n_words, chars, sums(_IS["symbol"]), dup_lines, np.bincount(at[in_window], minlength=n),
        np.bincount(row, minlength=n), sums(_IS["upper"]), sums(_IS["letter"]), np.bincount(at[ends_odd], minlength=n), np.bincount(at[1:][(hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])], minlength=n),
    ]
    return np.array(each, np.int64).T


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS..., EXTRA...) of every row, by one pass over the texts."""
    names = [*COUNTS, *EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_chunks(batch.column(1)):
                found = counts(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, len(t)), *(pa.array(found[:, i]) for i in range(len(names)))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{name} bigint" for name in names))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def shares(found: np.ndarray) -> np.ndarray:
    """[row, feature] of the forest from [row, statistic]."""
    n_words, chars, symbols, dups, repeats, lines, upper, letters, odd, same = found.T.astype(float)
    per_word = 1 / np.maximum(n_words, 1)
    return np.array([
        np.minimum(symbols * per_word, 4), np.minimum(dups / np.maximum(lines, 1), 1), repeats * per_word,
        upper / np.maximum(letters, 1), odd * per_word, same * per_word, np.minimum(np.maximum(chars * per_word - 12, 0) / 8, 2),
    ]).T


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    many = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays [tree, node]; a leaf leads to itself and carries its path length."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    normal: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few splits isolate."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, path in zip(self.feature, self.split, self.child, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = child[node, (x[rows, feature[node]] >= split[node]).astype(np.int64)]
            total += path[node]
        return 2.0 ** -(total / len(self.feature) / self.normal)


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest | None:
    """Trees on samples of ``sample`` usual rows; splits are uniform in what is left of the box ``low`` to ``high``.

    The box spans unusual rows too, so these fall into parts that hold few usual rows or none, after few splits.
    """
    spans = np.flatnonzero(high > low)
    if not len(x) or not len(spans):
        return None
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(2, math.ceil(math.log2(sample)))
    size = 2 ** (depth + 1)
    feature, child = np.zeros((trees, size), np.int64), np.tile(np.arange(size)[None, :, None], (trees, 1, 2))
    split, path = np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        open_, used = [(0, rng.choice(len(x), sample, replace=False), 0, low, high)], 1
        while open_:
            node, rows, level, least, most = open_.pop()
            if level == depth or len(rows) < 2:
                path[t, node] = level + expected_path(len(rows))
                continue
            f = rng.choice(spans)
            cut = least[f] + (most[f] - least[f]) * (1 - rng.random())
            right = x[rows, f] >= cut
            feature[t, node], split[t, node], child[t, node] = f, cut, (used, used + 1)
            upper, lower = most.copy(), least.copy()
            upper[f] = lower[f] = cut
            open_ += [(used, rows[~right], level + 1, least, upper), (used + 1, rows[right], level + 1, lower, most)]
            used += 2
    return Forest(feature, split, child, path, depth, float(max(expected_path(sample), 1.0)))


@dataclass
class Model:
    """A forest, and the score from which a document is rejected; None and 2 reject nothing."""

    forest: Forest | None
    threshold: float


def calibrate(bins: dict[int, tuple[int, int]], most_lost: float = MOST_LOST) -> float:
    """The threshold, from bin number to (good rows, bad rows); 2 where none parts them."""
    good, bad = (sum(v[i] for v in bins.values()) for i in (0, 1))
    best, gain, lost, caught = 2.0, 0.0, 0, 0
    for b in sorted(bins, reverse=True) if good and bad else ():
        lost, caught = lost + bins[b][0], caught + bins[b][1]
        if lost > most_lost * good:
            break
        if caught / bad - lost / good > gain:
            best, gain = b / BINS, caught / bad - lost / good
    return best


def _scored(stats: DataFrame, forest: Forest | None, name: str) -> DataFrame:
    """``stats`` with the anomaly score of every row."""
    at = [stats.columns.index(c) for c in (*COUNTS, *EXTRA)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([batch.column(i).to_numpy() for i in at]).T
            score = forest.scores(shares(found)) if forest and len(found) else np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return stats.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields), f"`{name}` double"]))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", most_fit: int = MAX_FIT) -> Model:
    """A forest and its threshold from the labelled rows that pass the base rules; ``labels`` has (id, quality)."""
    usable = labels.where(F.col("quality").isin(0, 1)).select(id_col, F.col("quality").alias("_label")).distinct()
    known = stats.where(~base_failed()).join(usable, id_col)
    order = [F.xxhash64(id_col), id_col, *COUNTS, *EXTRA, "_label"]
    # A share of the digests that holds about a quarter more than most_fit rows: top rows of every task would add up.
    steps = 1 << 20
    least = F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(steps)) < math.ceil(steps * 1.25 * most_fit / max(known.count(), 1))
    got = known.where(least).orderBy(*order).limit(most_fit).select("_label", *COUNTS, *EXTRA).collect()  # bounded by most_fit
    forest = None
    if got:
        x = shares(np.array([tuple(r)[1:] for r in got], np.int64))
        forest = grow(x[np.array([r["_label"] == 1 for r in got])], x.min(0), x.max(0))
    if forest is None:
        return Model(None, 2.0)
    binned = _scored(known, forest, "_score").groupBy(F.floor(F.col("_score") * BINS).alias("b"), "_label").count()
    bins: dict[int, tuple[int, int]] = {}
    for r in binned.collect():  # at most 2 * BINS rows
        good, bad = bins.get(r["b"], (0, 0))
        bins[r["b"]] = (good + r["count"], bad) if r["_label"] else (good, bad + r["count"])
    return Model(forest, calibrate(bins))


def judge(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``base_failed``, ``kept`` and ``anomaly``."""
    scored = _scored(stats, model.forest, "anomaly")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < model.threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS..., EXTRA..., anomaly, base_failed, kept) of every row of ``docs``."""
    stage = Stage(docs.sparkSession, "rules")
    stats = stage.cut(rule_statistics(docs, id_col, text_col))
    return judge(stats, train(stats, labels, id_col))

"""Vectorised work on the bytes of many texts at once (numpy, no per-row Python)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes that are hashed or compared at a time.
HASH_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass
class Texts:
    """Rows ``lo`` to ``hi`` of a batch: their bytes end to end, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    column = column.cast(pa.large_binary()) if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Consecutive rows of about ``limit`` bytes (one row at least), so memory stays bounded."""
    data, offsets = column_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def words(texts: Texts, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than 0x20 and 0x09 to 0x0D."""
    data = texts.data if data is None else data
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    edges = texts.offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] |= ink[edges]
    starts = np.flatnonzero(begins)
    ends_here = ink.copy()
    ends_here[:-1] &= ~ink[1:]
    before = edges[edges > 0] - 1
    ends_here[before] |= ink[before]
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(texts.offsets[1:], starts, "right")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand; ``starts`` ascend.

    Works on stretches of about ``HASH_BYTES`` (one span at least), so its memory doesn't grow with the data.
    """
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + HASH_BYTES, "right")))
        base = int(starts[lo])
        stretch = data[base : int(ends[lo:hi].max())]
        begin, end = starts[lo:hi] - base, ends[lo:hi] - base
        up, down = powers(len(stretch) + 1)
        sums = np.zeros(len(stretch) + 1, np.uint64)
        np.add(stretch, np.uint64(1), out=sums[1:], dtype=np.uint64)
        sums[1:] *= up[: len(stretch)]
        np.cumsum(sums, out=sums)
        out[lo:hi] = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        lo = hi
    return out


def equal_spans(data: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans at ``one`` and ``two`` have the same bytes; sizes are above 0."""
    out = np.zeros(len(one), bool)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(one):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HASH_BYTES, "right")))
        n = sizes[lo:hi]
        differ = data[ragged(one[lo:hi], n)] != data[ragged(two[lo:hi], n)]
        out[lo:hi] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        lo = hi
    return out


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words; of all words where a row has fewer."""
    n = len(hashes)
    counts = np.bincount(rows, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= width:
        acc = hashes[: n - width + 1].copy()
        for j in range(1, width):
            acc = mix(acc + np.uint64(j)) + hashes[j : n - width + 1 + j]
        whole = rows[: n - width + 1] == rows[width - 1 :]
        acc, at = mix(acc[whole]), rows[: n - width + 1][whole]
    else:
        acc, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = np.full(len(short), 0x51ED270B, np.uint64)
        for j in range(width - 1):
            live = counts[short] > j
            extra[live] = mix(extra[live] + np.uint64(j)) + hashes[first[short[live]] + j]
        acc, at = np.concatenate([acc, mix(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        acc, at = acc[order], at[order]
    return acc, at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every run of equal neighbours."""
    if not len(keys):
        return []
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True))

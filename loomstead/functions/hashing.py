"""Shingle sets of many texts at once, as sorted 64-bit hashes: numpy on the bytes of a batch, no per-row strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at a time (one text at least), and that are hashed at a time.
CHUNK_BYTES, HASH_BYTES = 1 << 20, 1 << 17
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, HASH_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that follow each other, equal for equal bytes wherever they stand."""
    out, lo = np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASH_BYTES, "right")))
        base = int(starts[lo])
        begin, end = starts[lo:hi] - base, ends[lo:hi] - base
        n = int(end[-1])
        sums = np.zeros(n + 1, np.uint64)
        np.multiply(data[base : base + n], _power(_BASE, n), out=sums[1:], dtype=np.uint64)
        np.cumsum(sums, out=sums)
        out[lo:hi] = _mix((sums[end] - sums[begin]) * _power(pow(_BASE, -1, 1 << 64), n + 1)[begin] + (end - begin).astype(np.uint64))
        lo = hi
    return out


_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123)]] = True


def _chunk(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes) of lower-cased texts end to end: distinct runs of k tokens, or the tokens where there are fewer."""
    rows = len(offsets) - 1
    ink = np.zeros(len(data) + 1, bool)
    ink[:-1] = _TOKEN[data]
    first, last = ink.copy(), ink[:-1].copy()
    first[1:] &= ~ink[:-1]
    last &= ~ink[1:]
    edges = offsets[1:-1]
    first[edges] = ink[edges]  # a text begins anew
    cut = edges[edges > 0] - 1
    last[cut] = ink[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    tokens = _spans(data, starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets))
    runs = np.where(counts >= k, counts - (k - 1), counts)
    at, to = np.cumsum(counts) - counts, np.cumsum(runs) - runs
    joined = tokens[: max(len(tokens) - (k - 1), 0)]
    for j in range(1, k):
        joined = _mix(joined + np.uint64(j)) + tokens[j : j + len(joined)]
    joined = _mix(joined)
    flat, sizes = np.empty(int(runs.sum()), np.uint64), np.zeros(rows, np.int64)
    for r in np.flatnonzero(runs):
        source, n = (joined if counts[r] >= k else tokens), runs[r]
        flat[to[r] : to[r] + n] = np.sort(source[at[r] : at[r] + n])
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    full = np.flatnonzero(runs)
    new[to[full]] = True
    if len(full):
        sizes[full] = np.add.reduceat(new.astype(np.int64), to[full])
    return flat[new], sizes


def hashed_shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(lo, hashes, sizes) of stretches of rows from ``lo`` on: each text's shingle set, sorted, sets end to end.

    Texts are lower-cased; tokens and shingles are those of ``functions.text``, known by 64-bit hashes. A null has none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, *_chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
        lo = hi

"""Removal of long byte strings that an earlier document already has, by collection BWTs.

A byte is removed when a ``LENGTH``-byte string covering it also starts in a document
with a smaller doc_id. The collection is cut so that equal strings meet and every
cut is small:

1. Each window of ``LENGTH`` bytes has an anchor, its ``ANCHOR``-gram of smallest hash
   (leftmost of equals). The anchor depends on the window's bytes only, so equal windows
   have equal anchors. Consecutive windows with one anchor form a segment of at most
   ``2 * LENGTH - ANCHOR`` bytes.
2. Anchors that only one row of the corpus has are left out (nothing can match there).
3. Segments are dealt by anchor. Each part is a collection of distinct segments whose
   Burrows-Wheeler transform is built column by column: a round inserts one symbol of
   every segment, from the last to the first, and updates the common prefixes of
   neighbours; transform and prefixes are external files, read once in sequence and
   written once in sequence in a round. A walk over the finished transform places every suffix.
   Segments whose anchor has neither its left nor its right half-surroundings in common with
   another segment share no window and stay out of the transform.
4. Runs of neighbours with ``LENGTH`` bytes in common are the equal strings of the part; a window is
   removed if its run has a segment of a smaller doc_id. Removed ranges return to the
   texts and overlap is resolved there.

Segments equal within a block of documents are sent once with all their places, those
of later documents are decided on the spot, and an anchor that many documents share is
one distinct segment per part, so frequent passages stay small.

Defined results: null counts as empty; texts shorter than ``LENGTH`` stay whole; rows
with one doc_id never remove each other's bytes; a null doc_id counts as larger than all;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .staging import Masked
from .textbytes import column_bytes, equal_spans, mix, ragged, runs, span_hashes

LENGTH = 50
ANCHOR = 20
#: Text in one block; a task needs about 40 bytes of memory for each.
BLOCK_BYTES = 4 << 20
LEAST_BLOCKS = 64
#: Blocks in a bundle at most. A task sends each part one row for a bundle, so rows are few where blocks are many.
BUNDLE = 4
LEAST_BUNDLES = 64
#: Blocks' worth of text in one part.
PART_BLOCKS = 2
PIECE = 1 << 19
#: Spans whose bytes are gathered at a time.
SPANS = 1 << 12
#: Bits of an anchor's hash that choose its part.
PART_BITS = 24
_POS = np.uint64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max


class Block:
    """The texts of one block in (doc_id, text hash) order, the same in every pass."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        ids = table.column("doc_id").combine_chunks() if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id")
        text = table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text")
        data, offsets = column_bytes(text)
        self.null_ids = np.asarray(ids.is_null()) if len(ids) else np.zeros(0, bool)
        plain = np.asarray(ids.fill_null(_LAST)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        order = np.argsort(plain, kind="stable")
        raw = memoryview(data)
        for a, b in runs(plain[order]):
            if b - a > 1:  # rows that share an id stand by their bytes
                order[a:b] = sorted(order[a:b], key=lambda k: hashlib.sha256(raw[offsets[k] : offsets[k + 1]]).digest())
        self.order = order
        self.ids, self.null_ids = plain[order], self.null_ids[order]
        self.sizes = np.diff(offsets)[order]
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        self.data = np.frombuffer(b"".join([raw[offsets[k] : offsets[k + 1]] for k in order]), np.uint8)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of windows, row, anchor hash and place of the anchor of every segment."""
        starts, counts, rows, anchors, spots = [], [], [], [], []
        lo, n = 0, len(self.ids)
        span = LENGTH - ANCHOR + 1
        pieces: list[tuple[int, int]] = []
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + PIECE, "right")) - 1)
            a, b = int(self.offsets[lo]), int(self.offsets[hi])
            if hi == lo + 1 and b - a > 4 * PIECE:
                pieces += [(p, min(p + PIECE + LENGTH - 1, b)) for p in range(a, max(a + 1, b - LENGTH + 1), PIECE)]
            else:
                pieces.append((a, b))
            lo = hi
        for a, b in pieces:
            if b - a < LENGTH:
                continue
            d = self.data[a:b]
            raw = np.zeros(len(d) + 8, np.uint8)
            raw[: len(d)] = d
            eight = np.ndarray((len(d),), np.uint64, raw.data, 0, (1,))
            m = len(d) - ANCHOR + 1
            h = eight[:m] * np.uint64(0x9FB21C651E98DF25)
            h ^= (eight[8 : m + 8] + np.uint64(0x7F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= (eight[12 : m + 12] >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
            h = mix(h)
            key = (h & ~_POS) | np.arange(m, dtype=np.uint64)
            low, reach = key, 1
            while reach * 2 <= span:
                low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
            if reach < span:
                low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
            at = np.arange(len(d) - LENGTH + 1)
            row = np.searchsorted(self.offsets, at + a, "right") - 1
            whole = at + a + LENGTH <= self.offsets[row + 1]
            at, row, low = at[whole], row[whole], low[: len(d) - LENGTH + 1][whole]
            if not len(at):
                continue
            first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
            starts.append(at[first] + a)
            counts.append(np.diff(np.r_[first, len(at)]))
            rows.append(row[first])
            anchor = (low[first] & _POS).astype(np.int64)
            anchors.append(h[anchor])
            spots.append(anchor - at[first])
        if not starts:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64), none
        return tuple(np.concatenate(x) for x in (starts, counts, rows, anchors, spots))


def layout(total: int) -> tuple[int, int, int]:
    """Blocks, blocks in a bundle, and parts for ``total`` bytes of text."""
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    return blocks, max(1, min(BUNDLE, blocks // LEAST_BUNDLES)), min(max(LEAST_BLOCKS, blocks // PART_BLOCKS), 1 << PART_BITS)


def blocks_of(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """The blocks of a bundle in ascending order, each with the number of rows in those before it."""
    table = table.combine_chunks()
    number = table.column("block").to_numpy()
    order = np.argsort(number, kind="stable")
    for a, b in runs(number[order]) or [(0, 0)]:
        yield a, table.take(pa.array(order[a:b]))


def part_of(anchors: np.ndarray, parts: int) -> np.ndarray:
    """Parts by the low bits of an anchor's hash; its key within a part is the high 40 bits."""
    return ((anchors & np.uint64((1 << PART_BITS) - 1)) * np.uint64(parts) >> np.uint64(PART_BITS)).astype(np.int64)


def key_bytes(anchors: np.ndarray) -> bytes:
    """Ascending 40-bit keys as compressed byte planes."""
    keys = anchors >> np.uint64(24)
    planes = keys.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
    return len(keys).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def keys_of(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], n * 5, "zstd", asbytes=True), np.uint8).reshape(5, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = planes.T
    return wide.view(np.uint64)[:, 0]


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans end to end, with indices for a few thousand spans at a time."""
    return np.concatenate([data[:0], *(data[ragged(starts[k : k + SPANS], sizes[k : k + SPANS])] for k in range(0, len(starts), SPANS))])


def alike(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each span, equal where all bytes are equal: hashes, each confirmed against the first span that has it."""
    same = span_hashes(data, starts, starts + sizes)
    order = np.argsort(same, kind="stable")
    lead = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]]) if len(order) else order
    first = order[np.repeat(lead, np.diff(np.r_[lead, len(order)]))]
    other = np.flatnonzero(first != order)
    one, two = first[other], order[other]
    right = sizes[one] == sizes[two]
    right[right] = equal_spans(data, starts[one[right]], starts[two[right]], sizes[one[right]])
    if not right.all():  # two strings with one hash: number the strings themselves
        return np.unique(np.array([data[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)], object), return_inverse=True)[1].astype(np.uint64)
    return same


def _row_anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending anchors of one block, and whether two of its rows have them."""
    _, _, rows, anchors, _ = Block(table).segments()
    order = np.lexsort((rows, anchors))
    rows, anchors = rows[order], anchors[order]
    first = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1])]) if len(anchors) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(anchors)] - 1
    return anchors[first], rows[first] != rows[last] if len(first) else np.zeros(0, bool)


def _find_anchors(parts: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("bundle")[0].as_py()
        each = [_row_anchors(block) for _, block in blocks_of(table)]
        # Once for each anchor; one of two rows of the bundle is known to be shared.
        anchors, twice = (np.concatenate(x) for x in zip(*each, strict=True))
        order = np.argsort(anchors, kind="stable")
        anchors, twice = anchors[order], twice[order]
        first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else order
        times = np.diff(np.r_[first, len(anchors)])
        twice = (times > 1) | twice[first]
        anchors = anchors[first]
        part = part_of(anchors, parts)
        out: dict[str, list] = {"part": [], "bundle": [], "hashes": [], "twice": []}
        order = np.argsort(part, kind="stable")
        part, anchors, twice = part[order], anchors[order], twice[order]
        for a, b in runs(part):
            out["part"].append(int(part[a]))
            out["bundle"].append(number)
            out["hashes"].append(key_bytes(anchors[a:b]))
            out["twice"].append(np.packbits(twice[a:b]).tobytes())
        return pa.table({"part": pa.array(out["part"], pa.int32()), "bundle": pa.array(out["bundle"], pa.int32()), "hashes": pa.array(out["hashes"], pa.binary()), "twice": pa.array(out["twice"], pa.binary())})

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For one part of the anchors: to each bundle those of its anchors that another row also has."""
    bundles = table.column("bundle").to_pylist()
    each = [keys_of(x) for x in table.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(h)].astype(bool) for x, h in zip(table.column("twice").to_pylist(), each, strict=True)]
    every = np.sort(np.concatenate(each))
    several = every[:-1][every[1:] == every[:-1]]
    several = np.unique(np.concatenate([several, *(h[t] for h, t in zip(each, twice, strict=True))]))
    found = []
    for h in each:
        at = np.minimum(np.searchsorted(several, h), max(len(several) - 1, 0))
        found.append(h[several[at] == h].view(np.uint64).tobytes() if len(several) else b"")
    keep = [i for i, f in enumerate(found) if f]
    return pa.table({"bundle": pa.array([bundles[i] for i in keep], pa.int32()), "hashes": pa.array([found[i] for i in keep], pa.binary())})


_SENT = "part int, bundle int, bytes binary, sizes binary, spots binary, ids binary, rows binary, n_places binary, places binary"


def _block_segments(table: pa.Table, before: int, shared: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What one block sends (bytes, then sizes, spots, ids, rows, number of places, anchors of its segments, then
    the places), and the (row, start, size) that an earlier document of the block decides. Rows count from ``before``.
    """
    block = Block(table)
    starts, counts, rows, anchors, spots = block.segments()
    # Keys of different parts can be equal; keeping a few segments too many changes nothing.
    key = anchors >> np.uint64(24)
    at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
    good = shared[at] == key
    starts, counts, rows, anchors, spots = starts[good], counts[good], rows[good], anchors[good], spots[good]
    sizes = counts + LENGTH - 1
    same = alike(block.data, starts, sizes)
    order = np.lexsort((starts, same))  # rows ascend with starts, and ids with rows
    starts, sizes, rows, anchors, spots, same = starts[order], sizes[order], rows[order], anchors[order], spots[order], same[order]
    first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]]) if len(same) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(same)]))
    ids = block.ids[rows]
    later = ids > ids[first][group] if len(first) else np.zeros(0, bool)
    inside = starts - block.offsets[rows]
    # An earlier document of this block has the same segment.
    done = np.stack([rows[later] + before, inside[later], sizes[later]]).T.astype(np.int32)
    # The earliest document's places, one segment each row of it.
    own = np.flatnonzero(~later)
    lead = np.flatnonzero(np.r_[True, (group[own][1:] != group[own][:-1]) | (rows[own][1:] != rows[own][:-1])]) if len(own) else own
    seg = own[lead]
    sent = [
        gathered(block.data, starts[seg], sizes[seg]), sizes[seg].astype(np.uint8), spots[seg].astype(np.uint8), ids[seg].astype(np.int64), (rows[seg] + before).astype(np.int32),
        np.diff(np.r_[lead, len(own)]).astype(np.int32), anchors[seg], inside[own].astype(np.int32),
    ]
    return sent, done


def _cut_segments(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["part", "bundle", "bytes", "sizes", "spots", "ids", "rows", "n_places", "places"]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        out: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            number = left.column("bundle")[0].as_py()
            shared = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in right.column("hashes").to_pylist()]))
            each = [_block_segments(block, before, shared) for before, block in blocks_of(left)]
            done = np.concatenate([d for _, d in each])
            if len(done):
                for k, v in enumerate([-1 - number, number, b"", b"", b"", b"", b"", b"", done.tobytes()]):
                    out[k].append(v)
            data, sizes, spots, ids, rows, n_places, anchors, places = (np.concatenate(x) for x in zip(*(s for s, _ in each), strict=True))
            del each
            lengths, times = sizes.astype(np.int64), n_places.astype(np.int64)
            starts, lead = np.cumsum(lengths) - lengths, np.cumsum(times) - times
            part = part_of(anchors, parts)
            deal = np.argsort(part, kind="stable")
            for a, b in runs(part[deal]):
                s = deal[a:b]
                row = [int(part[s[0]]), number, data[ragged(starts[s], lengths[s])].tobytes(), *(x[s].tobytes() for x in (sizes, spots, ids, rows, n_places)), places[ragged(lead[s], times[s])].tobytes()]
                for k, v in enumerate(row):
                    out[k].append(v)
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, out, kinds, strict=True)})

    return run


class LeastOf:
    """Minima of runs of an array of bytes, from those of power-of-two widths."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first] to values[last], both included."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), np.uint8)
        for k in np.unique(level).tolist():
            while len(self.levels) <= k:
                wide = 1 << (len(self.levels) - 1)
                self.levels.append(np.minimum(self.levels[-1][:-wide], self.levels[-1][wide:]))
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] + 1 - (1 << k)])
        return out


class ColumnwiseTransform:
    """The collection's transform and common prefixes in external files, one symbol of each segment a round.

    Symbols are codes below ``width``; 0 ends a segment. Entry k of the second file is the length that suffix k
    has in common with the one before it. A round reads both files once in sequence for ranks and common prefixes,
    and writes both once in sequence. It writes over the files of two rounds before, which are shorter: emptying a
    file costs the file system more than the round's work.
    """

    CHUNK = 1 << 18
    NONE = 255

    def __init__(self, folder: str, n: int, width: int):
        self.folder, self.n, self.width, self.round = folder, n, width, 0
        self.paths = self._names()

    def _names(self) -> tuple[str, str]:
        return tuple(os.path.join(self.folder, f"{kind}-{self.round % 2}") for kind in ("bwt", "lcp"))

    def start(self, symbols: np.ndarray) -> np.ndarray:
        """The last symbols, in the order of the segments; returns their places."""
        symbols.tofile(self.paths[0])
        np.zeros(self.n, np.uint8).tofile(self.paths[1])
        return np.arange(self.n)

    def _chunks(self, paths: tuple[str, str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        with open(paths[0], "rb") as symbols, open(paths[1], "rb") as common:
            at = 0
            while len(chunk := np.fromfile(symbols, np.uint8, self.CHUNK)):
                yield at, chunk, np.fromfile(common, np.uint8, self.CHUNK)
                at += len(chunk)

    def extend(self, places: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For symbol + suffix, suffixes at ascending ``places``: its place once all are inserted, what it has in
        common with the suffix before it, and with the one after it (-1 where that begins otherwise).

        Suffixes that begin with a symbol stand in the order of that symbol's occurrences in the transform, and two
        neighbours have one more in common than the least of the common prefixes between their occurrences.
        """
        width, end = self.width, self.NONE
        before, known, since = np.zeros(width, np.int64), np.zeros(width, bool), np.full(width, end, np.uint8)
        rank, own, after = np.empty(len(places), np.int64), np.zeros(len(places), np.int64), np.full(len(places), -1, np.int64)
        waiting: dict[int, tuple[int, int]] = {}  # symbol: a suffix whose follower lies in a later chunk, and the least so far
        for at, chunk, common in self._chunks(self.paths):
            order = np.argsort(chunk, kind="stable")
            counts = np.bincount(chunk, minlength=width)
            first = np.cumsum(counts) - counts
            inverse = np.empty(len(chunk), np.int64)
            inverse[order] = np.arange(len(chunk))
            least, upto = LeastOf(common), np.minimum.accumulate(common)
            from_here = np.r_[np.minimum.accumulate(common[::-1])[::-1], np.uint8(end)]
            for c, (i, low) in list(waiting.items()):
                if counts[c]:
                    after[i] = 1 + min(low, int(upto[order[first[c]]]))
                    del waiting[c]
                else:
                    waiting[c] = (i, min(low, int(upto[-1])))
            a, b = np.searchsorted(places, [at, at + len(chunk)])
            if b > a:
                here, c = places[a:b] - at, symbols[a:b]
                k = inverse[here]
                rank[a:b] = before[c] + k - first[c]
                inside = np.flatnonzero(k > first[c])
                own[a + inside] = 1 + least(order[k[inside] - 1] + 1, here[inside]).astype(np.int64)
                earlier = np.flatnonzero((k == first[c]) & known[c])
                own[a + earlier] = 1 + np.minimum(since[c[earlier]], upto[here[earlier]]).astype(np.int64)
                last = k + 1 == first[c] + counts[c]
                inside = np.flatnonzero(~last)
                after[a + inside] = 1 + least(here[inside] + 1, order[k[inside] + 1]).astype(np.int64)
                waiting |= {int(c[i]): (a + int(i), int(from_here[here[i] + 1])) for i in np.flatnonzero(last)}
            some = counts > 0
            since = np.minimum(since, upto[-1])
            since[some] = from_here[order[first[some] + counts[some] - 1] + 1]
            known |= some
            before += counts
        below = np.cumsum(before) - before
        return self.n + below[symbols] - before[0] + rank, own, after

    def insert(self, places: np.ndarray, symbols: np.ndarray, own: np.ndarray, after: np.ndarray) -> None:
        """Write the next files: ``symbols`` and common prefixes at the ascending ``places`` of the new order."""
        self.round += 1
        done, gone, older, next_ = 0, 0, places - np.arange(len(places)), -1
        paths, self.paths, nothing = self.paths, self._names(), np.zeros(0, np.uint8)
        mode = "r+b" if self.round > 1 else "wb"
        with open(self.paths[0], mode) as to, open(self.paths[1], mode) as common_to:
            for _, chunk, common in itertools.chain(self._chunks(paths), [(0, nothing, nothing)]):
                # New symbols that stand before or among the old ones of this chunk; all that are left after the last.
                upto = done + int(np.searchsorted(older[done:], gone + len(chunk), "left")) if len(chunk) else len(places)
                merged, prefix = np.empty(len(chunk) + upto - done, np.uint8), np.empty(len(chunk) + upto - done, np.uint8)
                old = np.ones(len(merged), bool)
                spots = places[done:upto] - (gone + done)
                old[spots] = False
                merged[old], prefix[old] = chunk, common
                merged[spots], prefix[spots] = symbols[done:upto], own[done:upto]
                if next_ >= 0 and len(prefix):
                    prefix[0], next_ = next_, -1
                follows = np.flatnonzero((after[done:upto] >= 0) & (spots + 1 < len(prefix)))
                prefix[spots[follows] + 1] = after[done:upto][follows]
                if upto > done and spots[-1] + 1 == len(prefix):
                    next_ = int(after[upto - 1])
                merged.tofile(to)
                prefix.tofile(common_to)
                gone, done = gone + len(chunk), upto


def transformed(data: np.ndarray, sizes: np.ndarray, folder: str) -> ColumnwiseTransform:
    """The transform of segments laid end to end; symbols are the bytes that occur, numbered from 1."""
    offsets = np.cumsum(sizes) - sizes
    present = np.bincount(data, minlength=256) > 0
    code = (np.cumsum(present) * present).astype(np.uint8)[data]
    bwt = ColumnwiseTransform(folder, len(sizes), int(present.sum()) + 1)
    seg, symbols, depth = np.arange(len(sizes)), code[offsets + sizes - 1], 0
    places = bwt.start(symbols)
    while len(seg):
        depth += 1
        places, own, after = bwt.extend(places, symbols)
        order = np.argsort(places, kind="stable")
        seg, places, own, after = seg[order], places[order], own[order], after[order]
        left = sizes[seg] - depth
        symbols = np.where(left > 0, code[np.maximum(offsets[seg] + left - 1, 0)], 0).astype(np.uint8)
        bwt.insert(places, symbols, own, after)
        alive = left > 0
        seg, places, symbols = seg[alive], places[alive], symbols[alive]
    return bwt


def equal_windows(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window, class): windows of one class are equal, for distinct segments laid end to end."""
    n = len(sizes)
    with tempfile.TemporaryDirectory() as folder:
        bwt = transformed(data, sizes, folder)
        # Walk the finished transform once more to learn every suffix's place.
        final, common = (np.fromfile(path, np.uint8) for path in bwt.paths)
    order = np.argsort(final, kind="stable").astype(np.int32 if len(final) < 2**31 else np.int64)
    jump = np.empty(len(final), order.dtype)
    ends = int((final == 0).sum())
    jump[order] = np.arange(len(final)) - ends + n
    place_seg, place_win = [], []
    where, seg = np.arange(n, dtype=order.dtype), np.arange(n, dtype=np.int32)
    spots = []
    for d in range(1, int(sizes.max()) + 1 if n else 0):
        where = jump[where]
        window = (sizes[seg] - d).astype(np.int32)
        if d >= LENGTH:
            spots.append(where)
            place_seg.append(seg)
            place_win.append(window)
        alive = window > 0
        where, seg = where[alive], seg[alive]
    if not spots:
        none = np.zeros(0, np.int64)
        return none, none, none
    spots, place_seg, place_win = (np.concatenate(x) for x in (spots, place_seg, place_win))
    order = np.argsort(spots)
    spots, place_seg, place_win = spots[order], place_seg[order], place_win[order]
    # Between windows that don't follow each other stands a shorter suffix, so they differ.
    agree = np.r_[False, spots[1:] == spots[:-1] + 1] & (common[spots] >= LENGTH)
    return place_seg, place_win, np.cumsum(~agree) - 1


def _may_match(data: np.ndarray, sizes: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Segments that can share a window with another distinct one.

    A window is its anchor and LENGTH - ANCHOR bytes around it, half of them at least on one side,
    so a shared window means an equal anchor with an equal half on the left or on the right.
    """
    half = (LENGTH - ANCHOR) // 2
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(sizes), bool)
    for a, b in ((spots - half, spots + ANCHOR), (spots, spots + ANCHOR + half)):
        whole = np.flatnonzero((a >= 0) & (b <= sizes))
        _, which, times = np.unique(span_hashes(data, (starts + a)[whole], (starts + b)[whole]), return_inverse=True, return_counts=True)
        out[whole[times[which] > 1]] = True
    return out


def _judge(table: pa.Table) -> pa.Table:
    """One part: removed ranges (row, start, size) for each bundle."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    ready = [(b, p) for b, s, p in zip(cols["bundle"], cols["sizes"], cols["places"], strict=True) if not s]
    use = [i for i, s in enumerate(cols["sizes"]) if s]
    out: list[tuple[int, bytes]] = list(ready)
    if use:
        join = lambda c, t: np.concatenate([np.frombuffer(cols[c][i], t) for i in use])
        data, sizes, ids = join("bytes", np.uint8), join("sizes", np.uint8).astype(np.int64), join("ids", np.int64)
        rows, n_places, places = join("rows", np.int32), join("n_places", np.int32).astype(np.int64), join("places", np.int32)
        bundle = np.repeat([cols["bundle"][i] for i in use], [len(cols["sizes"][i]) for i in use])
        offsets = np.cumsum(sizes) - sizes
        _, first, which = np.unique(alike(data, offsets, sizes), return_index=True, return_inverse=True)
        least = np.full(len(first), _LAST)
        np.minimum.at(least, which, ids)
        d_sizes = sizes[first]
        d_data = gathered(data, offsets[first], d_sizes)
        counts = d_sizes - LENGTH + 1
        base = np.cumsum(counts) - counts
        earliest = np.repeat(least, counts)  # equal segments are one; the rest is found among distinct ones
        some = np.flatnonzero(_may_match(d_data, d_sizes, join("spots", np.uint8).astype(np.int64)[first]))
        if len(some):
            ends = np.cumsum(d_sizes)
            seg, win, klass = equal_windows(gathered(d_data, ends[some] - d_sizes[some], d_sizes[some]), d_sizes[some])
            seg = some[seg]
            best = np.full(int(klass.max()) + 1, _LAST)
            np.minimum.at(best, klass, least[seg])
            earliest[base[seg] + win] = best[klass]
        # Every sent segment against its own doc_id, windows end to end, then runs of removed ones.
        n_win = counts[which]
        owner = np.repeat(np.arange(len(which)), n_win)
        gone = earliest[ragged(base[which], n_win)] < ids[owner]
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        opens = np.flatnonzero(gone & ~np.r_[False, gone[:-1] & (owner[1:] == owner[:-1])])
        shuts = np.flatnonzero(gone & ~np.r_[gone[1:] & (owner[1:] == owner[:-1]), False])
        run_owner, run_start, run_size = owner[opens], inside[opens], inside[shuts] - inside[opens] + LENGTH
        # A run holds at every place of its segment.
        times = n_places[run_owner]
        spot = places[ragged((np.cumsum(n_places) - n_places)[run_owner], times)]
        result = np.stack([np.repeat(rows[run_owner], times), spot + np.repeat(run_start, times), np.repeat(run_size, times)]).T.astype(np.int32)
        to = np.repeat(bundle[run_owner], times)
        order = np.argsort(to, kind="stable")
        result, to = result[order], to[order]
        out += [(int(to[a]), np.ascontiguousarray(result[a:b]).tobytes()) for a, b in runs(to)]
    return pa.table({"bundle": pa.array([b for b, _ in out], pa.int32()), "ranges": pa.array([r for _, r in out], pa.binary())})


def _assemble(kind: pa.DataType, with_text: bool, carry: tuple[str, ...] = ()):
    def one(left: pa.Table, r: np.ndarray) -> pa.Table:
        block = Block(left)
        change = np.zeros(len(block.data) + 1, np.int32)
        at = block.offsets[r[:, 0]] + r[:, 1]
        np.add.at(change, at, 1)
        np.add.at(change, at + r[:, 2], -1)
        gone = np.cumsum(change[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = block.offsets[:-1][block.sizes > 0]
        opens[edge] = gone[edge]
        total, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(opens)]
        a, b = block.offsets[:-1], block.offsets[1:]
        kept = block.data[~gone].tobytes()
        ends = b - total[b]
        begins = a - total[a]
        texts = [kept[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
        columns = {
            "doc_id": pa.array(block.ids, mask=block.null_ids).cast(kind), "n_bytes": pa.array(block.sizes), "n_removed": pa.array(total[b] - total[a]), "n_spans": pa.array(spans[b] - spans[a]),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if with_text:
            columns["kept"] = pa.array(texts, pa.binary())
        for name in carry:
            columns[name] = left.column(name).take(pa.array(block.order))
        return pa.table(columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(right.column("ranges").to_pylist()), np.int32).reshape(-1, 3)
        r = r[np.argsort(r[:, 0], kind="stable")].astype(np.int64)
        done = []
        for before, block in blocks_of(left):
            a, b = np.searchsorted(r[:, 0], [before, before + block.num_rows])
            done.append(one(block, r[a:b] - [before, 0, 0]))
        return pa.concat_tables(done)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary], carried columns) for every row."""
    total = docs.select(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    blocks, bundle, parts = layout(total)
    kind = docs.schema["doc_id"].dataType
    # The length spreads rows that share an id, or have none.
    dealt = docs.select("doc_id", "text", *carry, F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.withColumn("bundle", F.expr(f"cast(block div {bundle} as int)"))
    anchors = dealt.groupBy("bundle").applyInArrow(_find_anchors(parts), "part int, bundle int, hashes binary, twice binary")
    shared = anchors.groupBy("part").applyInArrow(_shared_anchors, "bundle int, hashes binary")
    sent = dealt.groupBy("bundle").cogroup(shared.groupBy("bundle")).applyInArrow(_cut_segments(parts), _SENT)
    ranges = sent.groupBy("part").applyInArrow(_judge, "bundle int, ranges binary")
    fields = ["doc_id " + kind.simpleString(), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"]
    fields += ["kept binary"] * with_text + [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return dealt.groupBy("bundle").cogroup(ranges.groupBy("bundle")).applyInArrow(_assemble(to_arrow_type(kind), with_text, carry), ", ".join(fields))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed bytes cut out of ``text`` (and ``n_chars``, if present, brought up to date).

    A character of which only some bytes are removed goes as a whole.
    """
    plain = Masked(docs, ("doc_id", "text", "n_chars"))
    carry = tuple(c for c in plain.df.columns if c not in ("doc_id", "text"))
    cut = remove_repeats(plain.df, True, carry).withColumn("text", F.expr("try_validate_utf8(cast(kept as string))"))
    broken = F.regexp_replace(F.expr("make_valid_utf8(cast(kept as string))"), "\ufffd", "")
    cut = cut.withColumn("text", F.coalesce("text", broken))
    if "n_chars" in carry:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return plain.back(cut)

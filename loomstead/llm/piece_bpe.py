"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into words (a run of spaces and what follows it; no piece has a
space after a letter, which is checked, so no merge crosses a word). The symbols of
all words new to a worker lie in flat numpy arrays. A round looks up the rank of
every adjacent pair, takes each word's smallest rank by a segmented minimum,
merges its leftmost non-overlapping occurrences at once and compacts the arrays,
until no pair remains. A merge whose piece can at once join a neighbour at an equal
or better rank could overtake its own later occurrences, so of such pieces only the
leftmost occurrence is merged in a round; that keeps the result equal to the
library's queue. Encoded words are cached per worker up to ``CACHE_WORDS``.

Supported models: BPE, identity normalisation, dummy prefix, spaces kept, no
user-defined pieces; others raise ValueError.

Defined results: null counts as empty; empty texts have no ids; U+2581 in a text
is a space, as in the library; characters outside the vocabulary become byte pieces
(or unk where the model has none). Equal rows each get their row; texts of any
length are processed whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import ragged

CACHE_WORDS = 300_000
CHUNK_CHARS = 1 << 20
#: A word still not merged after so many rounds is finished by a queue.
MAX_ROUNDS = 3000
_NONE = np.int32(2**31 - 1)
_WORD = re.compile(r" *[^ ]+| +")
SPACE = "▁"


class PieceModel:
    """Tables of a model: symbols, pair ranks, byte pieces. Bounded by the vocabulary; picklable."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and all spaces kept")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece has a space after a letter")
        scores = sorted({-proto.pieces[i].score for i in normal.values()})
        rank_of = {s: k for k, s in enumerate(scores)}
        self.n_pieces = len(proto.pieces)
        self.char_ids: dict[str, int] = {}
        for piece in normal:
            for c in piece:
                self.char_ids.setdefault(c, normal[c] if c in normal else self.n_pieces + len(self.char_ids))
        self.odd_chars = {i: c for c, i in self.char_ids.items() if i >= self.n_pieces}
        symbol = lambda s: normal.get(s, self.char_ids[s] if len(s) == 1 else None)
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank_of[-proto.pieces[i].score], i)
        self.width = self.n_pieces + len(self.char_ids) + 1
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int32)[order]
        self.merged = np.array([m for _, m in pairs.values()], np.int32)[order]
        own = np.full(self.width, _NONE, np.int32)
        own[self.merged] = self.ranks
        eager = np.zeros(self.width, bool)
        for side in (self.keys // self.width, self.keys % self.width):
            best = np.full(self.width, _NONE, np.int32)
            np.minimum.at(best, side, self.ranks)
            eager |= (best <= own) & (own < _NONE)
        self.eager = eager[self.merged]  # by pair: the merged piece may overtake
        self.bytes_at = np.full(256, -1, np.int32)
        decoded = []
        self.is_byte = np.zeros(self.n_pieces, bool)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.bytes_at[int(p.piece[3:5], 16)] = i
                self.is_byte[i] = True
                decoded.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.NORMAL:
                decoded.append(p.piece.replace(SPACE, " ").encode())
            else:
                decoded.append(proto.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else b"")
        self.piece_length = np.array([len(d) for d in decoded], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(decoded), np.uint8)

    def fallback(self, char: str) -> list[int]:
        if (self.bytes_at < 0).any():
            return [self.unk]
        return [int(self.bytes_at[b]) for b in char.encode()]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into the pair tables, -1 where the pair makes no piece."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has."""
        text = "".join(new).replace(" ", SPACE)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(code, return_inverse=True)
        odd = {}
        ids = np.empty(len(distinct), np.int32)
        for k, c in enumerate(map(chr, distinct.tolist())):
            ids[k] = self.char_ids.get(c, -1 - k)
            if ids[k] < 0 or ids[k] >= self.n_pieces:
                odd[int(ids[k])] = c
        sym = ids[inverse].astype(np.int32)
        word = np.repeat(np.arange(len(new), dtype=np.int32), [len(w) for w in new])
        done_sym, done_word = [], []
        pair = np.full(len(sym), -1, np.int64)
        pair[:-1] = np.where(word[:-1] == word[1:], self.lookup(sym[:-1], sym[1:]), -1)
        for _ in range(MAX_ROUNDS):
            if not len(sym):
                break
            rank = np.where(pair >= 0, self.ranks[pair], _NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            least = np.minimum.reduceat(rank, first)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, count)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                sym, word, pair, rank = sym[~gone], word[~gone], pair[~gone], rank[~gone]
                if not len(sym):
                    break
                count, least = count[~over], least[~over]
            chosen = rank == np.repeat(least, count)
            at = np.flatnonzero(chosen)
            opens = np.r_[True, at[1:] != at[:-1] + 1]
            at = at[(np.arange(len(at)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]) % 2 == 0]
            lead = np.r_[True, word[at][1:] != word[at][:-1]]
            at = at[lead | ~self.eager[pair[at]]]
            if len(at) > 1:  # of equal ranks an eager piece may stand first
                lead = np.r_[True, word[at][1:] != word[at][:-1]]
                blocked = np.repeat(self.eager[pair[at[lead]]], np.diff(np.r_[np.flatnonzero(lead), len(at)]))
                at = at[lead | ~blocked]
            sym[at] = self.merged[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, pair = sym[keep], word[keep], pair[keep]
            fresh = moved[at]
            fresh = np.unique(np.r_[fresh, fresh[fresh > 0] - 1])
            after = np.minimum(fresh + 1, len(sym) - 1)
            pair[fresh] = np.where((fresh < len(sym) - 1) & (word[fresh] == word[after]), self.lookup(sym[fresh], sym[after]), -1)
        if len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(sym)], strict=True):
                rest = self._queue(sym[a:b].tolist())
                done_sym.append(np.array(rest, np.int32))
                done_word.append(np.full(len(rest), word[a], np.int32))
        sym, word = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (done_sym, done_word))
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        strange = np.flatnonzero((sym < 0) | (sym >= self.n_pieces))
        if len(strange):
            sizes = np.ones(len(sym), np.int64)
            spelled = {int(s): self.fallback(odd[int(s)]) for s in np.unique(sym[strange])}
            sizes[strange] = [len(spelled[int(s)]) for s in sym[strange]]
            out = np.repeat(sym, sizes)
            place = np.cumsum(sizes) - sizes
            spots = ragged(place[strange], sizes[strange])
            out[spots] = [i for s in sym[strange] for i in spelled[int(s)]]
            sym, word = out, np.repeat(word, sizes)
        return sym, np.bincount(word, minlength=len(new)) if len(new) else np.zeros(0, np.int64)

    def _queue(self, sym: list[int]) -> list[int]:
        """The same merges one by one, for words with very many rounds."""
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (k := int(self.lookup(np.array([sym[i]]), np.array([sym[j]]))[0])) >= 0:
                heapq.heappush(heap, (int(self.ranks[k]), i, sym[i], sym[j], int(self.merged[k])))

        for i in range(n - 1):
            push(i)
        gone = [False] * n
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j] = m, True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each row of ids; one leading space of a row's first piece goes."""
        lengths = self.piece_length[ids]
        flat = self.piece_bytes[ragged(self.piece_start[ids], lengths)].tobytes()
        ends = np.cumsum(np.r_[0, lengths])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        starts = np.r_[0, ends[:-1]] if len(counts) else ends
        firsts = np.cumsum(counts) - counts
        out = []
        for k in range(len(counts)):
            raw = flat[starts[k] : ends[k]]
            if counts[k] and raw[:1] == b" " and not self.is_byte[ids[firsts[k]]]:
                raw = raw[1:]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(self._broken(ids[firsts[k] : firsts[k] + counts[k]]))
        return out

    def _broken(self, ids: np.ndarray) -> str:
        """Rows with byte pieces that are no text: each stray byte becomes U+FFFD."""
        out, raw = [], b""

        def flush() -> None:
            nonlocal raw
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[:n].decode())
                        raw = raw[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    raw = raw[1:]

        for k, i in enumerate(ids.tolist()):
            piece = self.piece_bytes[self.piece_start[i] : self.piece_start[i] + self.piece_length[i]].tobytes()
            if self.is_byte[i]:
                raw += piece
            else:
                flush()
                out.append((piece[1:] if k == 0 and piece[:1] == b" " else piece).decode())
        flush()
        return "".join(out)


class Encoder:
    """A worker's encoder: cached words over a ``PieceModel``."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids, counts = self.model.encode_words(new)
        n, k = len(self.index), len(new)
        while n + k > len(self.starts):
            self.starts, self.counts = (np.r_[x, np.zeros_like(x)] for x in (self.starts, self.counts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.counts[n : n + k] = counts
        self.starts[n : n + k] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.index.update(zip(new, range(n, n + k), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        every: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                found = _WORD.findall(" " + text.replace(SPACE, " "))
                counts[k] = len(found)
                every += found
        new = list(set(every).difference(self.index))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        sizes = self.counts[at]
        ids = self.ids[ragged(self.starts[at], sizes)]
        ends = np.cumsum(np.r_[0, sizes])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        return ids, np.diff(np.r_[0, ends])


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for hi, text in enumerate(texts):
        if size and size + len(text or "") > CHUNK_CHARS:
            yield lo, hi
            lo, size = hi, 0
        size += len(text or "")
    if lo < len(texts):
        yield lo, len(texts)


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row."""
    tables = PieceModel(model)  # bounded by the vocabulary; travels with the function
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables)
        for batch in batches:
            for lo, hi in _pieces(texts := batch.column(1).to_pylist()):
                ids, counts = encoder.encode([t or "" for t in texts[lo:hi]])
                decoded = encoder.model.decode(ids, counts)
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")

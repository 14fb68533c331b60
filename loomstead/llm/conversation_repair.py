"""Cheapest structural repair of conversations by a lazily determinised weighted automaton.

A repaired conversation reads ``(s?(ua)+)?`` in role initials: four places of an automaton. Rows are kept (0),
rerolled to user or assistant (2) or deleted (3, the only way for blank and duplicate rows); empty rows of user or
assistant are inserted (2); a truncated row that stays costs 1 more. The vector of what each place still has to pay,
less its minimum, is a state of the determinised automaton. Its moves are computed when first met and kept in a
table, so a scan over rows looks up one entry a row and adds one weight. The scan runs from the last row to the first;
the trace runs against it along arcs that are tight in those vectors, so it meets the edits in the order of the audit
and takes the ASCII-least letter (D, I, K, R) wherever several are tight. A letter leads to one place, hence the first
least letters give the least audit.

Conversations of any length are spread: rows are numbered within their conversation by ranges of the order, pieces
of ``PIECE`` rows are scanned and traced by themselves, from every place they can end or begin in. Only a row of 16
costs (then of 4 places) a piece is combined in the order of a conversation, as a stream with one vector of memory.
Rows with the same role and text at the same turn are one row with a count.

Defined results: null conversations, turns, roles and texts read as one space where they are text (conversation and
turn in the key of the damage, role and text in rows); rows of a null turn come first; rows of one turn are taken by
role, then by a digest of role and text; conversations of null id are one conversation; roles other than those that
begin with s, u or a can't be kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ranking import positions
from .staging import Stage, spread_join

PIECE = 4096
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INITIALS = "sua"
#: Faults of a row as the automaton sees them.
SOUND, SHORT, GONE = range(3)
#: Places: nothing yet, after s, after u, after ua. The role that may come next, and where it leads.
EXPECT, LEADS, PLACES = "uuau", (2, 2, 3, 2), 4
FAR = 1 << 40
BLANK = r"^[\x20\x09-\x0D]*\z"


def _closed(costs: list[int]) -> list[int]:
    """With rows inserted where that is cheaper."""
    for _ in range(PLACES):
        costs = [min(c, INSERT + costs[LEADS[q]]) for q, c in enumerate(costs)]
    return costs


#: What is left to pay after the last row.
FINAL = tuple(_closed([0, FAR, FAR, 0]))


@dataclass
class Automaton:
    """States are cost vectors less their minimum; moves on (state, row) are filled in when first met."""

    vectors: list[tuple[int, ...]] = field(default_factory=list)
    known: dict[tuple[int, ...], int] = field(default_factory=dict)
    after: np.ndarray = field(default_factory=lambda: np.full((64, 12), -1, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros((64, 12), np.int64))
    #: [state behind the row, row, place]: number of the edits, and the place they lead to.
    edit: np.ndarray = field(default_factory=lambda: np.zeros((64, 12, PLACES), np.int64))
    edits: list[tuple[str, int]] = field(default_factory=list)
    numbers: dict[tuple[str, int], int] = field(default_factory=dict)

    def state(self, vector: list[int] | tuple[int, ...]) -> tuple[int, int]:
        """The state of a cost vector, and what was taken off."""
        least = min(vector)
        key = tuple(min(int(c - least), FAR) if c < FAR else FAR for c in vector)
        if key not in self.known:
            self.known[key] = len(self.vectors)
            self.vectors.append(key)
            if len(self.vectors) > len(self.after):
                grown = len(self.after)
                self.after = np.concatenate([self.after, np.full((grown, 12), -1, np.int64)])
                self.weight = np.concatenate([self.weight, np.zeros((grown, 12), np.int64)])
                self.edit = np.concatenate([self.edit, np.zeros((grown, 12, PLACES), np.int64)])
        return self.known[key], int(least)

    def _arcs(self, behind: tuple[int, ...], row: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost with all that follows, place) of the edits of a row; capital U and A are rerolled rows."""
        kind, fault = divmod(row, 3)
        found = [("D", DELETE + behind[q], q)]
        if fault != GONE:
            extra = TRUNCATED if fault == SHORT else 0
            if kind < 3 and INITIALS[kind] == EXPECT[q]:
                found.append(("K", extra + behind[LEADS[q]], LEADS[q]))
            if kind == 0 and q == 0:
                found.append(("K", extra + behind[1], 1))
            found.append((EXPECT[q].upper(), REROLE + extra + behind[LEADS[q]], LEADS[q]))
        return found

    def _fill(self, state: int, row: int) -> None:
        behind = self.vectors[state]
        arcs = [self._arcs(behind, row, q) for q in range(PLACES)]
        costs = _closed([min(cost for _, cost, _ in a) for a in arcs])
        for q in range(PLACES):
            letters, at = "", q
            while costs[q] < FAR:  # D, then I, then K, then R: arcs are in that order but for I
                tight = {letter: to for letter, cost, to in arcs[at] if cost == costs[at]}
                if "D" not in tight and INSERT + costs[LEADS[at]] == costs[at]:
                    letters, at = letters + EXPECT[at], LEADS[at]
                    continue
                letter = next(x for x in "DKUA" if x in tight)
                key = (letters + letter, tight[letter])
                self.numbers.setdefault(key, len(self.numbers))
                if len(self.edits) < len(self.numbers):
                    self.edits.append(key)
                self.edit[state, row, q] = self.numbers[key]
                break
        after, least = self.state(costs)
        self.after[state, row], self.weight[state, row] = after, least

    def move(self, states: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states before the rows, what they add)."""
        after = self.after[states, rows]
        if (after < 0).any():
            for state, row in set(zip(states[after < 0].tolist(), rows[after < 0].tolist(), strict=True)):
                self._fill(state, row)
            after = self.after[states, rows]
        return after, self.weight[states, rows]


@functools.cache
def automaton() -> Automaton:
    """One table for all batches of a worker."""
    return Automaton()


def scan(rows: np.ndarray, begin: np.ndarray, end: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many pieces at once, from their last row to their first: state behind each row, state and cost before all."""
    auto = automaton()
    seen, now, total = np.zeros(len(rows), np.int64), behind.copy(), np.zeros(len(begin), np.int64)
    order = np.argsort(begin - end, kind="stable")
    lengths = (end - begin)[order]
    for step in range(int(lengths.max(initial=0))):
        live = order[: int(np.searchsorted(-lengths, -step, "left"))]
        at = end[live] - 1 - step
        seen[at] = now[live]
        now[live], more = auto.move(now[live], rows[at])
        total[live] += more
    return seen, now, total


def trace(rows: np.ndarray, begin: np.ndarray, end: np.ndarray, seen: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """The edits of every row along least tight arcs, beginning in ``place``; and where each piece ends."""
    auto = automaton()
    made, at_place = np.zeros(len(rows), np.int64), np.full(len(begin), place)
    order = np.argsort(begin - end, kind="stable")
    lengths = (end - begin)[order]
    leads = None
    for step in range(int(lengths.max(initial=0))):
        live = order[: int(np.searchsorted(-lengths, -step, "left"))]
        at = begin[live] + step
        made[at] = auto.edit[seen[at], rows[at], at_place[live]]
        if leads is None or len(leads) < len(auto.edits):
            leads = np.array([to for _, to in auto.edits], np.int64)
        at_place[live] = leads[made[at]]
    return made, at_place


def closing(place: int) -> str:
    """The rows inserted after the last one."""
    letters = ""
    while place not in (0, 3):
        letters, place = letters + EXPECT[place], LEADS[place]
    return letters


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): drops, empties, unstops, repeats and rerolls rows by a checksum of their key."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return rows.where(what != 0).select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(text("role")).alias("role"),
        F.when(what == 1, "").when(what == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"), F.when(what == 3, 2).otherwise(1).alias("copies"),
    )


def _group() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")).alias("g")


def _costs(pieces: DataFrame) -> DataFrame:
    """(g, piece, costs): least cost from each place before a piece to each behind it, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begin, end = _ragged(batch.column(2))
            out = np.full((batch.num_rows, PLACES, PLACES), FAR, np.int64)
            for last in range(PLACES):
                auto = automaton()
                start, _ = auto.state([0 if q == last else FAR for q in range(PLACES)])
                _, now, total = scan(rows, begin, end, np.full(batch.num_rows, start))
                out[:, :, last] = np.minimum(np.array(auto.vectors, np.int64)[now] + total[:, None], FAR)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out.reshape(len(out), -1))], ["g", "piece", "costs"])

    return pieces.select("g", "piece", "rows").mapInArrow(run, "g string, piece bigint, costs array<bigint>")


def _behind(costs: DataFrame) -> DataFrame:
    """(g, piece, behind, last): what is left to pay behind each piece; a stream over the pieces, last ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, vector = None, FINAL
        for batch in batches:
            m = batch.column(2).flatten().to_numpy().reshape(-1, PLACES, PLACES)
            out, last = np.empty((batch.num_rows, PLACES), np.int64), np.zeros(batch.num_rows, bool)
            for i, g in enumerate(batch.column(0).to_pylist()):
                if g != group:
                    group, vector, last[i] = g, np.array(FINAL), True
                out[i] = vector
                vector = (m[i] + vector).min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out), pa.array(last)], ["g", "piece", "behind", "last"])

    return costs.repartition("g").sortWithinPartitions("g", F.desc("piece")).mapInArrow(run, "g string, piece bigint, behind array<bigint>, last boolean")


def _traced(pieces: DataFrame) -> DataFrame:
    """For every place a piece may begin in: its edits, where it ends, what it and all behind it cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            auto = automaton()
            rows, begin, end = _ragged(batch.column("rows"))
            vectors = batch.column("behind").flatten().to_numpy().reshape(-1, PLACES)
            known = [auto.state(v) for v in vectors.tolist()]
            behind, least = (np.array([k[i] for k in known], np.int64) for i in (0, 1))
            seen, now, total = scan(rows, begin, end, behind)
            start = np.array(auto.vectors, np.int64)[now] + (total + least)[:, None]
            last = batch.column("last").to_numpy(zero_copy_only=False)
            moves, ends = [], []
            for place in range(PLACES):
                made, to = trace(rows, begin, end, seen, place)
                letters = [auto.edits[k][0] for k in made.tolist()] if len(made) else []
                moves.append(["".join(letters[b:e]) + (closing(t) if z else "") for b, e, t, z in zip(begin.tolist(), end.tolist(), to.tolist(), last.tolist(), strict=True)])
                ends.append(to)
            kind = rows // 3
            pairs = kind[:-1] * 4 + kind[1:] if len(kind) else kind
            odd = np.r_[0, np.cumsum(~np.isin(pairs, LEGAL))] if len(kind) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("piece"), pa.array([list(x) for x in zip(*moves, strict=True)], pa.list_(pa.string())), _lists(np.array(ends).T), _lists(start),
                 pa.array(kind[begin]), pa.array(kind[end - 1]), pa.array(odd[end - 1] - odd[begin])],
                ["g", "piece", "moves", "ends", "start", "first", "final", "odd"],
            )

    return pieces.mapInArrow(run, "g string, piece bigint, moves array<string>, ends array<bigint>, start array<bigint>, first bigint, final bigint, odd bigint")


#: su, ua, au as numbers of a pair of initials.
LEGAL = [INITIALS.index(x) * 4 + INITIALS.index(y) for x, y in ("su", "ua", "au")]


def _entered(traced: DataFrame) -> DataFrame:
    """(g, piece, place, crossing): where each piece begins, and whether its first row is illegal after the row before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, place, before = None, 0, 0
        for batch in batches:
            ends = batch.column(2).flatten().to_numpy().reshape(-1, PLACES).tolist()
            places, crossing = [], []
            for g, to, first, final in zip(batch.column(0).to_pylist(), ends, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                inner = g == group
                if not inner:
                    group, place = g, 0
                places.append(place)
                crossing.append(int(inner and before * 4 + first not in LEGAL))
                place, before = to[place], final
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int32()), pa.array(crossing, pa.int64())], ["g", "piece", "place", "crossing"])

    narrow = traced.select("g", "piece", "ends", "first", "final")
    return narrow.repartition("g").sortWithinPartitions("g", "piece").mapInArrow(run, "g string, piece bigint, place int, crossing bigint")


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.asarray(column.value_lengths(), np.int64)
    end = np.cumsum(sizes)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), end - sizes, end


def _lists(x: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x, dtype=np.int64).ravel()))


@dataclass
class Repair:
    """``plan``: (g, conv_id, gaps, blank, duplicate, truncated, illegal, cost) a conversation with rows; ``pieces``: their
    edits; ``texts``: (g, d, role, text) of every different row; ``ids``: every conversation."""

    plan: DataFrame
    pieces: DataFrame
    texts: DataFrame
    ids: DataFrame


def repair(rows: DataFrame, ids: DataFrame | None = None) -> Repair:
    """The cheapest edits of ``rows`` (conv_id, turn, role, text, copies).

    ``ids`` are the conversations that get a result, those of ``rows`` if it is left out.
    """
    stage = Stage(rows.sparkSession, "conversations")
    digest = F.substring(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256), 1, 32)
    each = rows.select(_group(), "conv_id", "turn", "role", "text", "copies", digest.alias("d"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    kind = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)], F.lit(len(INITIALS)))
    seen = each.select("g", "turn", "role", "d", "copies", F.col("text").rlike(BLANK).alias("blank"), (~last.isin(".", "!", "?")).alias("short"), kind.alias("kind"))
    distinct = stage.cut(seen.groupBy("g", "turn", "role", "d", "blank", "short", "kind").agg(F.sum("copies").alias("n")))
    firsts = stage.cut(distinct.groupBy("g", "d").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("none"), F.count("*").alias("rows")))
    told = spread_join(distinct, firsts, ["g", "d"], "rows", distinct.count())
    new = F.when(F.col("none"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    fault = F.when(F.col("blank") | ~new, GONE).when(F.col("short"), SHORT).otherwise(SOUND)
    coded = told.select("g", "turn", "role", "d", "n", "blank", new.alias("new"), (F.col("kind") * 3 + fault).alias("row"))
    placed = stage.cut(positions(coded, "g", ["turn", "role", "d"], stage).withColumn("piece", F.floor(F.col("position") / PIECE)))
    # A group has PIECE rows at most.
    listed = placed.groupBy("g", "piece").agg(F.sort_array(F.collect_list(F.struct("position", "row", "d", "n"))).alias("r"))
    pieces = stage.cut(listed.select("g", "piece", F.col("r.row").alias("rows"), F.col("r.d").alias("ds"), F.col("r.n").alias("ns")))
    costs = stage.cut(_costs(pieces), narrow=True)
    traced = stage.cut(_traced(pieces.select("g", "piece", "rows").join(_behind(costs), ["g", "piece"])))
    entered = _entered(traced)
    held = pieces.select("g", "piece", "ds", "ns").join(traced, ["g", "piece"]).join(entered, ["g", "piece"])
    split = F.regexp_extract_all(F.element_at("moves", F.col("place") + 1), F.lit("[ua]*[DKUA]"), F.lit(0))
    tail = F.regexp_extract(F.element_at("moves", F.col("place") + 1), "[ua]*$", 0)
    chosen = stage.cut(held.select("g", "piece", F.arrays_zip(split.alias("move"), "ds", "ns").alias("edits"), tail.alias("tail"), F.element_at("start", F.col("place") + 1).alias("start"), (F.col("odd") + F.col("crossing")).alias("odd")))
    live = F.when(F.col("blank"), 0)
    counts = placed.groupBy("g").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(live.otherwise(F.col("n") - F.col("new").cast("int"))).alias("duplicate"), F.sum((F.col("row") % 3 == SHORT).cast("long")).alias("truncated"), F.sum(F.col("n") - 1).alias("more"),
    )
    whole = chosen.groupBy("g").agg(F.sum("odd").alias("odd"), F.min_by("start", "piece").alias("start"))
    plan = counts.join(whole, "g").select("g", "gaps", "blank", "duplicate", "truncated", (F.col("odd") + F.col("more")).alias("illegal"), (F.col("start") + DELETE * F.col("more")).alias("cost"))
    texts = each.groupBy("g", "d").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    known = (rows if ids is None else ids).select("conv_id").distinct().select(_group(), "conv_id")
    return Repair(plan, chosen, texts, known)


def repaired_rows(done: Repair) -> DataFrame:
    """(g, position, edit, role, text) of every row that stays, is rerolled or inserted; ``edit`` is K, R or I."""
    wide = done.pieces.select("g", "piece", F.col("tail"), F.posexplode_outer("edits").alias("i", "e"), F.size("edits").alias("n"))
    at = F.col("piece") * PIECE + F.col("i")
    real = wide.select("g", at.alias("row"), F.col("e.move").alias("move"), F.col("e.ds").alias("d"))
    behind = wide.where((F.col("i") == F.col("n") - 1) & (F.col("tail") != "")).select("g", (at + 1).alias("row"), F.col("tail").alias("move"), F.lit(None).cast("string").alias("d"))
    letters = real.union(behind).where("move <> 'D'").select("g", "row", "d", F.posexplode(F.split("move", "")).alias("k", "letter")).where("letter NOT IN ('', 'D')")
    own = letters.where("letter IN ('K', 'U', 'A')").join(done.texts, ["g", "d"])
    inserted = letters.where("letter IN ('u', 'a')").withColumns({"role": F.lit(None).cast("string"), "text": F.lit("")})
    role = F.when(F.lower("letter") == "u", "user").when(F.lower("letter") == "a", "assistant").otherwise(F.col("role"))
    edit = F.translate("letter", "uaUA", "IIRR")
    return own.unionByName(inserted).select("g", F.struct("row", "k").alias("position"), edit.alias("edit"), role.alias("role"), "text")


def audits(done: Repair) -> DataFrame:
    """(g, audit): the initials of all edits of a conversation, in order; as long as the conversation has rows."""
    part = F.concat(F.array_join(F.transform("edits", lambda e: F.concat(F.translate(e["move"], "uaUA", "IIRR"), F.repeat(F.lit("D"), (e["ns"] - 1).cast("int")))), ""), F.translate("tail", "ua", "II"))
    return done.pieces.select("g", "piece", part.alias("part")).groupBy("g").agg(F.array_join(F.sort_array(F.collect_list(F.struct("piece", "part"))).getField("part"), "").alias("audit"))


def text_digests(lines: DataFrame) -> DataFrame:
    """(g, sha256) of the newline-joined ``role:text`` of (g, position, role, text): a stream, a digest of memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest = None, None
        for batch in batches:
            names, found = [], []
            for g, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if g != group:
                    if digest is not None:
                        names.append(group)
                        found.append(digest.hexdigest())
                    group, digest = g, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["g", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([digest.hexdigest()])], ["g", "sha256"])

    ordered = lines.repartition("g").sortWithinPartitions("g", "position").select("g", F.concat("role", F.lit(":"), "text").alias("line"))
    return ordered.mapInArrow(run, "g string, sha256 string")


def summary(done: Repair) -> DataFrame:
    """One row a conversation: counts of faults, cost, audit and a digest of the repaired text.

    A digest and an audit are single values, so a conversation's lines pass one task, as a stream.
    """
    none = F.sha2(F.lit(""), 256)
    joined = done.ids.join(done.plan, "g", "left").join(audits(done), "g", "left").join(text_digests(repaired_rows(done)), "g", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", none).alias("repaired_sha256"))

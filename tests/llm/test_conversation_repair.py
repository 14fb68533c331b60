"""Repairs against a shortest-path search over strings, pieces against whole conversations, and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loomstead.llm import conversation_repair as cr
from loomstead.llm import queries

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
COLUMNS = "conv_id long, turn long, role string, text string, cost int"


def damaged(rows):
    """(conv_id, turn, role, text) of every row after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()[:32]
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r)))


def cheapest(rows):
    """Least (cost, audit, lines) of rows (role, text, gone, short): every string of edits, place by place."""
    nexts = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    full = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(4):
            for q, (cost, audit, lines) in list(best.items()):
                c, to = nexts[q]
                new = (cost + 2, audit + "I", [*lines, full[c] + ":"])
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    best = with_inserts({0: (0, "", [])})
    for role, text, gone, short in rows:
        new = {}
        for q, (cost, audit, lines) in best.items():
            options = [(q, (cost + 3, audit + "D", lines))]
            if not gone:
                c, to = nexts[q]
                options.append((to, (cost + 2 + short, audit + "R", [*lines, f"{full[c]}:{text}"])))
                if role[:1] == c:
                    options.append((to, (cost + short, audit + "K", [*lines, f"{role}:{text}"])))
                if role[:1] == "s" and q == 0:
                    options.append((1, (cost + short, audit + "K", [*lines, f"{role}:{text}"])))
            for to, option in options:
                if to not in new or option < new[to]:
                    new[to] = option
        best = with_inserts(new)
    return min(best[q] for q in (0, 3) if q in best)


def expected(rows):
    out = {}
    done = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = [r for r in done if r[0] == conv]
        seen, told, counts = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            blank, dup = not text.strip(SPACE), (role, text) in seen
            short = not blank and not dup and text.rstrip(SPACE)[-1] not in ".!?"
            counts = [a + b for a, b in zip(counts, (blank, not blank and dup, short))]
            seen.add((role, text))
            told.append((role, text, blank or dup, short))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(told)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, rows, frame=None):
    frame = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS) if frame is None else frame
    found = cr.summary(cr.repair(cr.damage(frame), frame)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


def drawn(seed, n, roles=("user", "assistant", "system", "tool", "", None, "us")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "half", "é。", "", " \n", None, "end.  ", "a:b", "a.b", " "]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles[:2]) if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv if conv else None, None if rng.random() < 0.1 else turn + rng.randint(0, 1) * 3, role, f"{turn}." if rng.random() < 0.4 else rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_against_search_over_strings(spark):
    rows = drawn(5, 250)
    assert got(spark, rows) == expected(rows)


def test_query_is_whole_and_exact(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    assert found == expected(rows)


def test_pieces_do_not_change_a_repair(spark, monkeypatch):
    """One conversation has a third of all rows; pieces of 3 rows, so it is 40 of them."""
    rng = random.Random(3)
    rows = drawn(8, 60) + [(7, 100 + t, rng.choice(["user", "assistant", "assistant", "system"]), f"{t}" + rng.choice(["", ".", "?"])) for t in range(120)]
    whole = got(spark, rows)
    assert whole == expected(rows)
    monkeypatch.setattr(cr, "PIECE", 3)
    assert got(spark, rows) == whole


def test_many_equal_rows_are_one(spark):
    frame = spark.range(60_000).selectExpr("5L AS conv_id", "id % 2 AS turn", "'user' AS role", "'same.' AS text", "1 AS cost")
    (row,) = cr.summary(cr.repair(cr.damage(frame), frame)).collect()
    rows = cr.damage(frame).groupBy().sum("copies").first()[0]
    assert row.duplicate == rows - 1 and row.illegal == rows - 1 and row.cost == 3 * (rows - 1) + 2
    assert row.audit == "K" + "D" * (rows - 1) + "I" or row.audit == "D" * rows


def test_scan_and_trace_by_hand():
    rows = lambda text: np.array([{"s": 0, "u": 3, "a": 6, "t": 9}[c] for c in text])
    for text, cost, audit in (("sua", 0, "KKK"), ("uu", 2, "KR"), ("ua" * 4, 0, "K" * 8), ("", 0, ""), ("s", 3, "D"), ("au", 4, "DKI"[:0] or None), ("t", 3, "D")):
        auto = cr.automaton()
        state, least = auto.state(cr.FINAL)
        begin, end = np.zeros(1, np.int64), np.array([len(text)])
        seen, now, total = cr.scan(rows(text), begin, end, np.array([state]))
        made, to = cr.trace(rows(text), begin, end, seen, 0)
        letters = "".join(auto.edits[k][0] for k in made) + cr.closing(int(to[0]))
        assert auto.vectors[now[0]][0] + total[0] + least == cost
        assert audit is None or letters.translate(str.maketrans("uaUA", "IIRR")) == audit


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, 0, "user", "x" * 300_000)]])
def test_odd_tables(spark, rows):
    assert got(spark, rows) == expected(rows)

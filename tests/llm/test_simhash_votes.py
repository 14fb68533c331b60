"""Fingerprints by a vote counted bit by bit."""

import collections
import math
import re

import pyarrow as pa

from loomstead.llm import simhash
from loomstead.llm.textbytes import lowered, shingle_hashes, span_hashes, text_chunks, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hash_of(pair):
    """A term's 64 bits, from a text that is nothing but the term."""
    (t,) = text_chunks(pa.array([" ".join(pair)]))
    data = lowered(t.data)
    starts, ends, rows = words(t, data)
    return int(shingle_hashes(span_hashes(data, starts, ends), rows, 2, 1)[0][0])


def by_vote(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    terms = collections.Counter(zip(found, found[1:])) if len(found) > 1 else collections.Counter([tuple(found)] if found else [])
    weights = {hash_of(t): round(16 * (1 + math.log(n))) for t, n in terms.items()}
    return sum(1 << bit for bit in range(64) if sum(w if h >> bit & 1 else -w for h, w in weights.items()) > 0)


def test_every_bit_is_a_vote(tables):
    texts = [None, "", "one", "One two", "a b a b a b c", "é ü é ü x", "\n x \t y "] + [r.text[:900] for r in tables("documents").limit(25).collect()]
    got = [int(f) for t in text_chunks(pa.array(texts, pa.string()), 2000) for f in simhash.fingerprints(t)]
    assert got == [by_vote(t) for t in texts]

"""Keep-first by buckets against keep-first from all pairs, MinHash bands against one set at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomstead.functions import hashing
from loomstead.operators import similarity as sim


def words(rng, n=40):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def corpus(seed, n=220):
    rng = random.Random(seed)
    bases = [words(rng) for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
        rows.append((i, rng.choice(["a", "b", None]), " ".join(text)))
    return rows + [(n, "a", None), (n + 1, "a", ""), (n + 2, "a", "é"), (n + 3, "a", "one"), (n + 4, "a", "One!")]


def shingles(text):
    w = "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else set(w)


@pytest.mark.parametrize("seed,threshold,few", [(1, 0.8, 2000), (2, 0.85, 0), (3, 0.7, 0), (3, 0.7, 20)])
def test_equals_keep_first_from_all_pairs(spark, monkeypatch, seed, threshold, few):
    monkeypatch.setattr(sim, "FEW", few)
    rows = corpus(seed)
    sets = {i: shingles(t) for i, _, t in rows}
    grp = {i: g for i, g, _ in rows}
    near = lambda i, j: grp[i] == grp[j] and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
    stays = []
    for i, _, _ in rows:
        if not any(near(i, j) for j in stays):
            stays.append(i)
    got = {r.id: r.partner for r in sim.near_gone(spark.createDataFrame(rows, "id long, grp string, text string"), threshold).collect()}
    assert set(got) == set(sets) - set(stays) and len(got) > 50
    assert all(p in stays and p < i and near(i, p) for i, p in got.items())


def test_bands_of_sets_together_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 300, 2, 70, 1])
    flat = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    whole = sim._bands(flat, sizes, 128, 4)
    for at_once in (1, 64, 1 << 20):
        monkeypatch.setattr(sim, "SIGNED_AT_ONCE", at_once)
        assert (sim._bands(flat, sizes, 128, 4) == whole).all()
    ends = np.cumsum(sizes)
    assert all((sim._bands(flat[e - n : e], np.array([n]), 128, 4)[0] == whole[i]).all() for i, (e, n) in enumerate(zip(ends, sizes)))


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, grp string, text string")
    assert sim.near_gone(none, 0.8).collect() == []


def test_sizes_decide_before_sets_travel(spark, monkeypatch):
    """Pairs are cut down by their sizes as a table without sets; the pairs found are the exact ones."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(0, "en", " ".join(words)), (1, "en", " ".join(words[:58])), (2, "en", " ".join(words[:20])), (3, "en", " ".join(words))], "id long, grp string, text string")
    seen = []
    cut = sim.Scratch.cut
    monkeypatch.setattr(sim.Scratch, "cut", lambda self, df: (seen.append(set(df.columns)), cut(self, df))[1])
    members, pairs = sim.near_classes(docs, 0.85)
    assert {"grp", "i", "j", "ni", "nj"} in seen
    assert [(r.i, r.j, round(r.jaccard, 6)) for r in pairs.collect()] == [(0, 1, round(56 / 58, 6))] and members.count() == 4


def test_chains_of_buckets_take_few_stretches(spark, monkeypatch):
    """Each text shares words with the next ones only, so each waits for those before it; what is written doesn't grow with the chain."""
    monkeypatch.setattr(sim, "FEW", 32)
    rows = [(i, "a", " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(256)]
    written = []
    cut = sim.Scratch.cut
    monkeypatch.setattr(sim.Scratch, "cut", lambda self, df: (written.append(1), cut(self, df))[1])
    got = {r.id: r.partner for r in sim.near_gone(spark.createDataFrame(rows, "id long, grp string, text string"), 0.85).collect()}
    assert got == {i: i - i % 4 for i in range(256) if i % 4}  # 35 of 41 shingles are common at a distance of 3, 34 of 42 at 4
    assert len(written) < 60


def test_hashed_shingles_are_those_of_the_texts(monkeypatch):
    rng = random.Random(5)
    texts = [None, "", "a", "a b", "a b a", "é", "éa bé c"] + [" ".join(rng.choice(["ab", "b", "c1", "é", "x-y", "longer"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    for sizes in ((1 << 20, 1 << 17), (50, 7), (1, 1)):
        monkeypatch.setattr(hashing, "CHUNK_BYTES", sizes[0])
        monkeypatch.setattr(hashing, "HASH_BYTES", sizes[1])
        got = []
        for lo, flat, n in hashing.hashed_shingles(pa.array(["x", *texts]).slice(1), 3):
            assert lo == len(got)
            got += [set(flat[e - m : e].tolist()) for e, m in zip(np.cumsum(n), n)]
        held = [shingles(t) for t in texts]
        assert all(len(got[i] & got[j]) == len(held[i] & held[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_few_pairs_of_a_late_group_are_made(spark, monkeypatch):
    """A group of near texts that comes last shares its buckets; pairs grow with the rows of buckets, not with its square."""
    monkeypatch.setattr(sim, "FEW", 16)
    rng = random.Random(7)
    base = words(rng, 120)
    alone = [(i, "a", " ".join(words(rng, 30)) + f" {i}") for i in range(150)]
    pairs = [(150 + i, "a", alone[i][2] + " and more") for i in range(150)]
    group = [(300 + i, "a", " ".join([*base[:60], f"x{i}", *base[60:]])) for i in range(300)]
    made = []
    cut = sim.Scratch.cut
    monkeypatch.setattr(sim.Scratch, "cut", lambda self, df: (lambda out: (made.append(out.count() if df.columns == ["i", "j"] else 0), out)[1])(cut(self, df)))
    got = {r.id: r.partner for r in sim.near_gone(spark.createDataFrame(alone + pairs + group, "id long, grp string, text string"), 0.85).collect()}
    assert got == {150 + i: i for i in range(150)} | {300 + i: 300 for i in range(1, 300)}
    assert max(made) < 5_000  # a stretch with 212 of the group would make 22,366

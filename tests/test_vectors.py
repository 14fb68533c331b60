"""Vector links against all pairs, whatever the cells; text vectors by hand; probes; keep-first from classes."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from loomstead.operators import similarity, vectors as vec
from loomstead.plans import curation


def cosines(x):
    x = np.array(x, float)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def clustered(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(12, size=n)] + spread * rng.standard_normal((n, dim))
    x[n // 3 : n // 2] = x[0]  # copies: a sixth of all rows
    return x.round(3)


@pytest.mark.parametrize("seed,spread,cosine", [(1, 0.1, 0.9), (2, 0.3, 0.9), (3, 0.6, 0.6), (4, 1.5, 0.2), (5, 0.3, -0.5)])
def test_links_equal_all_pairs(spark, monkeypatch, seed, spread, cosine):
    monkeypatch.setattr(vec, "CELL", 16)
    monkeypatch.setattr(vec, "BLOCK", 16)
    monkeypatch.setattr(vec, "GUESTS", 24)
    n = 400
    x = clustered(n, 8, seed, spread)
    grp = [None if i % 4 == 3 else i % 4 if i % 4 < 2 else 0 for i in range(n)]
    rows = spark.createDataFrame([(i, grp[i], x[i].tolist()) for i in range(n)], "id long, grp int, vector array<double>")
    members, pairs = vec.vector_classes(rows, cosine, None)
    rep = {r.id: r.rep for r in members.collect()}
    key = {}
    for i in range(n):
        key.setdefault((grp[i], tuple(x[i])), i)
    assert rep == {i: key[grp[i], tuple(x[i])] for i in range(n)}
    sims, reps = cosines(x), sorted(set(rep.values()))
    want = {(i, j) for i in reps for j in reps if i < j and grp[i] == grp[j] and sims[i, j] >= cosine}
    got = [(r.i, r.j) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    links = {r.id: r.n_links for r in vec.class_links(rows, cosine, None).collect()}
    assert links == {i: sum(j != i and grp[i] == grp[j] and (sims[i, j] >= cosine or tuple(x[i]) == tuple(x[j])) for j in range(n)) for i in range(n)}
    held = rows.select("id", "vector", (rows.id % 5 == 0).alias("held"))
    leaked = {r.id for r in vec.near_held(held, cosine, None).collect()}
    assert leaked == {i for i in range(n) if i % 5 and any(sims[i, j] >= cosine for j in range(0, n, 5))}
    kept = {r.id: r.kept for r in similarity.keep_first_classes(rows.select("id"), members, pairs).collect()}
    gone = {r.id: r.partner for r in vec.keep_first(rows, cosine, None).collect()}
    stays = []
    for i in range(n):
        if not any(grp[i] == grp[j] and (sims[i, j] >= cosine or tuple(x[i]) == tuple(x[j])) for j in stays):
            stays.append(i)
    assert [i for i in range(n) if kept[i]] == stays
    partner = {r.id: r.partner for r in similarity.drop_partners(spark.createDataFrame(list(kept.items()), "id long, kept boolean"), members, pairs).collect()}
    assert set(gone) == set(partner) and all(kept[p] and p < i and (sims[i, p] >= cosine or rep[i] == p) for i, p in gone.items())
    assert set(partner) == {i for i in range(n) if not kept[i]} and all(kept[p] and grp[p] == grp[i] for i, p in partner.items())


@pytest.mark.parametrize("many", [1, 5])
def test_cells_spare_visits(many):
    """Rows of clusters visit few cells, with parts and without, and every near pair still meets."""
    x = clustered(3000, 16, 7, 0.15)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    middle = vec.centroids(x, 24)
    parts = vec.centroids(x - middle[vec._nearest(x, middle).argmin(1)], many) if many > 1 else np.zeros((1, 16))
    home, row, cell = vec.visits(x, middle, parts, (2 - 2 * 0.9) ** 0.5, None)
    assert len(row) < 0.25 * len(x) * 24 * many
    seen = set(zip(row.tolist(), cell.tolist()))
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1))):
        assert home[i] == home[j] or (i, home[j]) in seen and (j, home[i]) in seen
    few = vec.visits(x, middle, parts, 2.0, 3)
    assert np.bincount(few[1]).max() <= 4 * min(many, vec.PARTS) and set(zip(few[1].tolist(), few[2].tolist())) & seen


def test_recall_of_the_default_probes(spark, monkeypatch):
    """Pairs at cosines of 0.9 to 0.93 among vectors without any structure, which visit 8 of 40 cells."""
    monkeypatch.setattr(vec, "CELL", 100)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.standard_normal((400, 64))
    noise -= (noise * x[:400]).sum(1)[:, None] * x[:400]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.9, 0.93, 400)[:, None]
    x[400:800] = c * x[:400] + np.sqrt(1 - c * c) * noise
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, grp int, vector array<double>")
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)))}
    got = {(r.i, r.j) for r in vec.vector_classes(rows, 0.9)[1].collect()}
    links = {r.id: r.n_links for r in vec.class_links(rows, 0.9).collect()}
    assert sum(links.values()) == 2 * len(got)  # a pair that meets twice counts once
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 390


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 1, None), (3, 1, []), (4, 1, [0.0, 0.0]), (5, 1, [nan, 1.0]), (6, 1, [inf, 1.0]), (7, 1, [None, 1.0]), (8, 1, [1.0, 0.0, 0.0]), (9, None, [1.0, 0.0]), (10, 1, [1.0, 0.0])]
    members, pairs = vec.vector_classes(spark.createDataFrame(data, "id long, grp int, vector array<double>"), 0.9)
    assert {r.id: (r.rep, r.copies) for r in members.collect()} == {0: (0, 2), 1: (1, 1), 8: (8, 1), 9: (9, 1), 10: (0, 2)}
    assert [(r.grp, r.i, r.j) for r in pairs.collect()] == [(1, 0, 1)]
    none = vec.vector_classes(spark.createDataFrame([], "id long, grp int, vector array<double>"), 0.9)
    assert [t.count() for t in none] == [0, 0]


def by_hand(text, dim=vec.DIM):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    h = [int(hashlib.md5(f"v|{w}".encode()).hexdigest()[:8], 16) for w in words]
    grams = {(x * 7919 + 1) % vec.PRIME for x in h} | {(a * 1_000_003 + b) % vec.PRIME for a, b in zip(h, h[1:])}
    out = np.zeros(dim)
    for g in grams:
        out[g % dim] += 1 - 2 * (g // dim % 2)
    return out


def test_text_vectors_and_probes(spark, monkeypatch):
    texts = [None, "", "é", "one", "one two one two", "Please book a table for two at noon", "book a table for two at noon please!", "x " * 3000] + [f"word{i} and word{i % 7} with {i}" for i in range(60)]
    for at_once in (5, 500_000):
        monkeypatch.setattr(vec, "TOKENS_AT_ONCE", at_once)
        rows = vec.text_vectors(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
        got = {r.id: r.vector for r in rows.collect()}
        assert all(np.array_equal(got[i], by_hand(t)) for i, t in enumerate(texts))
    probes = vec.text_vectors(spark.createDataFrame([(0, "zz"), (3, "book a table for two at noon"), (4, ""), (5, "book a table for two at noon")] + [(10 + i, f"word{i}") for i in range(20)], "probe long, text string"))
    want = {}
    held = {r.probe: np.array(r.vector) for r in probes.collect() if any(r.vector)}
    for i, t in enumerate(texts):
        v = by_hand(t)
        sims = {p: round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9) for p, w in held.items()} if v.any() else {}
        want[i] = min(((-s, p) for p, s in sims.items()), default=(0.0, None))
    for most in (3, 1000):
        found = {r.id: (round(-r.cosine, 9), r.probe) for r in vec.best_probe(rows, probes, most).collect()}
        assert found == {i: w for i, w in want.items() if w[1] is not None}
    assert vec.best_probe(rows, probes.limit(0)).collect() == []


def test_decontamination_by_either_branch(spark):
    queries = spark.createDataFrame([(0, "start a ten minute timer for the pasta"), (1, "pasta the for timer minute ten a start"), (2, "nothing alike here"), (3, None)], "id long, text string")
    probes = spark.createDataFrame([(7, "Start a ten minute timer for the pasta.")], "id long, text string")
    got = {r.id: r for r in vec.decontaminate(queries, probes, 0.6, 0.5).collect()}
    assert got[0].score == 1.0 and got[0].cosine > 0.999 and got[0].dropped and got[0].near == 7
    assert got[1].score == 0.0 and got[1].dropped == (got[1].cosine >= 0.5) and not got[2].dropped and not got[3].dropped
    assert {r.id for r in vec.decontaminate(queries, probes, 0.6, 0.3).collect() if r.dropped} == {0, 1}


def test_a_block_of_near_rows_is_compared_by_stretches(monkeypatch):
    """All of a block's pairs are near: only a stretch's are held at once, and none is lost or told twice."""
    x = np.random.default_rng(2).standard_normal((1, 16)) + np.random.default_rng(3).standard_normal((300, 16)) / 100
    guest = np.arange(300) >= 100
    code = [b"\x08" + r.tobytes() for r in x]

    def block(i, j, guests):
        at = np.flatnonzero(~guest | guests)
        table = {"cell": pa.array([0] * len(at)), "i": pa.array([i] * len(at)), "j": pa.array([j] * len(at)), "guest": pa.array(guest[at]), "piece": pa.array([0] * len(at)), "home": pa.array(guest[at].astype(int)), "seen": pa.array([[]] * len(at), pa.list_(pa.int32()))}
        return pa.table(table | {"code": pa.array([code[k] for k in at], pa.binary())})

    monkeypatch.setattr(vec, "MET", 1000)
    for table, want in ((block(0, 0, False), {(u, v) for u in range(100) for v in range(u + 1, 100)}), (block(0, -1, True), {(u, v) for u in range(100) for v in range(100, 300)})):
        found = [(u, v) for u, v, _ in vec._close(table, 0.9)]
        pairs = [p for u, v in found for p in zip(u.tolist(), v.tolist())]
        assert len(found) > 1 and max(len(u) for u, _ in found) <= 1000 and len(pairs) == len(set(pairs)) and set(pairs) == want


def test_semantic_pairs_lose_no_link(spark, monkeypatch):
    """Vectors without any structure in 200 cells, one of them dealt in pieces: every pair that reaches the cosine, each once."""
    monkeypatch.setattr(vec, "CELL", 20)
    monkeypatch.setattr(vec, "BLOCK", 150)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x[3200:] = x[3199] + rng.standard_normal((800, 64)) * 0.45  # a heavy cell, near and not near
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.standard_normal((1500, 64))
    noise -= (noise * x[:1500]).sum(1)[:, None] * x[:1500]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.9, 0.92, 1500)[:, None]
    x[1500:3000] = c * x[:1500] + np.sqrt(1 - c * c) * noise
    rows = spark.createDataFrame([(i, "b" if i % 10 == 9 else "a", v.tolist()) for i, v in enumerate(x)], "id long, grp string, vector array<double>")
    monkeypatch.setattr(curation, "_vectors", lambda *_: rows)
    grp = np.arange(4000) % 10 == 9
    sims = x @ x.T
    want = {(int(i), int(j)): sims[i, j] for i, j in zip(*np.nonzero(np.triu((sims >= 0.9) & (grp[:, None] == grp), 1)))}
    got = curation.semantic_pairs(spark, "").collect()
    assert len(got) == len(want) > 1500 and all(r.cosine == pytest.approx(want[r.i, r.j], abs=1e-6) and r.lang == ("b" if grp[r.i] else "a") for r in got)


@pytest.mark.parametrize("cosine", [0.95, 0.5, -0.9])
def test_blocks_of_cells_meet_whole(cosine):
    """Two blocks with cells in common, equal centroids, and vectors of another length, against all pairs."""
    rng = np.random.default_rng(5)
    middle = np.repeat(rng.standard_normal((3, 8)), [1, 2, 1], 0) / 3
    cell = np.r_[rng.integers(4, size=180), np.full(20, -3)]
    x = [(middle[c] + rng.standard_normal(8) / 8 if c >= 0 else rng.standard_normal(3)) for c in cell]
    block = rng.integers(2, size=200)
    unit = [v / np.linalg.norm(v) for v in x]
    near = lambda u, v: len(x[u]) == len(x[v]) and unit[u] @ unit[v] >= cosine
    for i, j in ((0, 0), (0, 1), (1, 1)):
        at = [k for k in range(200) if block[k] in (i, j)]
        table = pa.table({"i": pa.array([i] * len(at)), "j": pa.array([j] * len(at)), "block": pa.array(block[at]), "cell": pa.array(cell[at]), "code": pa.array([b"\x08" + x[k].tobytes() for k in at], pa.binary())})
        got = [tuple(sorted((at[p], at[q]))) for u, v, _ in vec._within(table, cosine, middle) for p, q in zip(u.tolist(), v.tolist())]
        want = {(u, v) for u in at for v in at if u < v and {block[u], block[v]} == {i, j} and near(u, v)}
        assert len(got) == len(set(got)) and set(got) == want and want

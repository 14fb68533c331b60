"""Mined rows against all pairs, trees and cells of many shapes, and odd tables."""

import math
import random

import numpy as np
import pytest

from loomstead.llm import hard_negatives as hn

COLUMNS = "vec_id long, embedding array<double>, label int, rank string"


def expected(rows, every=50):
    live = {}
    for i, vector, label, *_ in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * x) for x in vector]
        if max(map(abs, q), default=0) < 2**31 and sum(x * x for x in q) <= hn.MOST and (i not in live or (label, q) < live[i]):
            live[i] = (label, q)
    out = set()
    for a, (label, q) in live.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other == label) for i, (other, v) in live.items() if i != a and len(v) == len(q))
        for s, p, _ in [t for t in scored if t[2]][:5]:
            fits = [(n, i) for n, i, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s]
            out |= {(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(fits[:3], 1)}
    return out


def mined(spark, rows, every=50):
    frame = spark.createDataFrame(rows, COLUMNS)
    got = [tuple(r) for r in hn.mine(frame, lambda i: i % every == 0).collect()]
    assert len(got) == len(set(got))
    return set(got)


def clustered(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    return [(i, (centres[i % 8] + spread * rng.standard_normal(dim)).tolist(), int(rng.integers(4)), "x") for i in range(n)]


@pytest.mark.parametrize("seed,spread,sizes", [(1, 0.3, (64, 16, 8)), (2, 1.5, (64, 16, 8)), (3, 0.05, (40, 8, 4)), (4, 0.3, (8192, 256, 4096))])
def test_equals_all_pairs(spark, monkeypatch, seed, spread, sizes):
    for name, value in zip(("BLOCK", "LEAF", "CHUNK"), sizes):
        monkeypatch.setattr(hn, name, value)
    monkeypatch.setattr(hn, "A_CELL", 8)
    rows = clustered(700, 6, seed, spread)
    want = expected(rows, 20)
    assert want and mined(spark, rows, 20) == want


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    """A third of all rows are one vector; ids repeat, components are null, infinite or huge, lengths differ."""
    monkeypatch.setattr(hn, "BLOCK", 32)
    monkeypatch.setattr(hn, "A_CELL", 4)
    rows = clustered(300, 4, 9) + [(1000 + i, [1.0, 0.5, -0.25, 2.0], i % 3, None) for i in range(150)]
    rows += [(20, [0.1, 0.2, 0.3, 0.4], 1, None), (None, [1.0] * 4, 1, None), (2020, None, 1, None), (2040, [1.0, None, 0.0, 0.0], 1, None), (2060, [1.0, math.inf, 0.0, 0.0], 1, None)]
    rows += [(2080, [float("nan")] * 4, 1, None), (2100, [1e300, 0.0, 0.0, 0.0], 1, None), (2120, [1e6] * 4, 1, None), (2140, [], 1, None), (2160, [], 2, None), (2161, [], 1, None)]
    rows += [(2180 + i, [0.5, 0.5], i % 2, None) for i in range(5)] + [(2200, [0.0] * 4, None, None), (-40, [1.0, 1.0, 0.0, 0.0], 2, None), (2220, [-1.0, 0.0, 0.0, 0.0], 7, None)]
    random.Random(1).shuffle(rows)
    assert mined(spark, rows, 20) == expected(rows, 20)


def test_nothing(spark):
    assert mined(spark, []) == set() and mined(spark, [(50, [1.0], 1, None)]) == set()


def test_trees_prune(monkeypatch):
    """In a clustered block, searches look at few leaves, and the window's inner rim spares the nearest ones."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-400, 400, (32, 8))
    q = np.repeat(centres, 64, 0) + rng.integers(-5, 5, (2048, 8))
    n2 = (q * q).sum(1)
    tree = hn.grow(q.astype(float), n2.astype(float), hn._lift(n2, int(n2.max())), 64, len(q), 1, False)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(2048))
    near, far = tree.reach(q[:50].astype(float), n2[:50].astype(float))
    lift = hn._lift(n2, int(n2.max()))
    true = np.sqrt(((q[:50, None] - q) ** 2).sum(2) + lift**2)
    for leaf, members in enumerate(tree.members):
        assert (near[:, leaf] <= true[:, members].min(1) + 1e-6).all() and (far[:, leaf] >= true[:, members].max(1) - 1e-6).all()
    assert near.max() > 0 and (near > np.sort(true, 1)[:, 5:6]).mean() > 0.2


def test_only_cells_are_broadcast(spark, monkeypatch, tmp_path):
    """Files of requests are small where they repeat a vector for every cell; neither they nor rows go through the driver by that."""
    monkeypatch.setattr(hn, "A_CELL", 8)
    monkeypatch.setattr(hn, "BLOCK", 64)
    stage = hn.Stage(spark, "plan")
    frame = spark.createDataFrame(clustered(300, 6, 5), COLUMNS).selectExpr("vec_id", "label::bigint", "embedding")
    index = hn.Index(stage.cut(hn.as_integers(frame, 256.0)), stage)
    wide = [hn.F.lit(x).alias(c) for c, x in (("lo", hn.NONE), ("hi", -hn.NONE), ("least", hn.NONE))]
    units = index.rows.select(hn.F.col("id").alias("a"), hn.F.col("id").alias("p"), "label", hn.F.lit(True).alias("same"), *wide, "q")
    plan = index._answers(index._requests(units, True), 3)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(joins) == 2 and all("BuildRight" in line for line in joins)

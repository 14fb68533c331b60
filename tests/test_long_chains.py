"""Keep-first selection decides every node, however long a chain of links is."""

import numpy as np
import pytest

from loomstead.operators import similarity


def greedy(n, edges):
    kept = []
    for j in range(n):
        kept.append(not any(kept[i] for i, k in edges if k == j))
    return kept


def found(spark, n, edges, **options):
    df = similarity.keep_first(spark.range(n), spark.createDataFrame(edges, "i long, j long"), **options)
    return [r.kept for r in df.orderBy("id").collect()]


def test_chain_longer_than_any_number_of_rounds(spark):
    n = 2200
    assert found(spark, n, [(i, i + 1) for i in range(n - 1)]) == [i % 2 == 0 for i in range(n)]


@pytest.mark.parametrize("few", [0, 10, 1000])
def test_rounds_and_walk_agree(spark, monkeypatch, few):
    monkeypatch.setattr(similarity, "GONE_TABLES", 2)
    pairs = np.random.default_rng(3).integers(0, 60, (90, 2)).tolist()
    edges = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]} | {(i, i + 1) for i in range(12)})
    assert found(spark, 60, edges, few=few) == greedy(60, edges)

"""Hybrid retrieval against plain loops, one block or many."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.operators import ranking, vectors
from test_vectors import by_hand

NAMES = ["get_weather", "book_flight", "send_email", "set_timer", "play_music", "stock_price", "weather_alert", "cancel_flight", "", "email_search"]


def expected(queries, tools, k, weight):
    words = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1 and w not in ranking.STOP_WORDS]
    docs = {t: words(text) for t, text, _ in tools}
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    out = {}
    for q, text in queries:
        lex = {t: sum(d.count(w) * (math.log((len(tools) + 1) / (df[w] + 0.5)) + 1) for w in words(text or "") if w in df) for t, d in docs.items()}
        v = by_hand(text)
        dense = {}
        for t, _, sentence in tools:
            u = by_hand(sentence)
            dense[t] = float(u @ v / max(np.linalg.norm(u) * np.linalg.norm(v), 1e-300))
        scale = lambda s: {t: (x - min(s.values())) / (max(s.values()) - min(s.values())) if max(s.values()) - min(s.values()) >= 1e-12 else 0.0 for t, x in s.items()}
        a, b = scale(lex), scale(dense)
        fused = {t: round((1 - weight) * a[t] + weight * b[t], 9) for t in a}
        out[q] = sorted(fused, key=lambda t: (-fused[t], t))[:k]
    return out


@pytest.mark.parametrize("block,weight", [(4096, 0.5), (4096, 0.0), (3, 0.5), (3, 1.0)])
def test_equals_plain_loops(spark, monkeypatch, block, weight):
    monkeypatch.setattr(ranking, "POOL_BLOCK", block)
    params = F.array(F.lit("city"), F.lit("day"))
    tools = spark.createDataFrame([(i, n, n.replace("_", " ").title()) for i, n in enumerate(NAMES)], "tool long, name string, description string")
    tools = tools.select("tool", ranking.tool_text(F.col("name"), F.col("description"), params).alias("text"), ranking.dense_text(F.col("name"), F.col("description"), params).alias("dense"))
    said = [(0, "what is the weather today"), (1, "cancel my flight and email me"), (2, ""), (3, None), (4, "weather weather flight"), (5, "zzz")]
    got = {}
    for r in ranking.hybrid(spark.createDataFrame(said, "query long, text string"), tools, 4, weight).collect():
        got.setdefault(r.query, []).append((r.place, r.tool))
    assert {q: [t for _, t in sorted(v)] for q, v in got.items()} == expected(said, [tuple(r) for r in tools.collect()], 4, weight)


def test_names_count_twice(spark):
    text = spark.range(1).select(ranking.tool_text(F.lit("get_weather"), F.lit("Now."), F.array(F.lit("city")))).first()[0]
    assert text == "get_weather get weather Now. city"
    none = spark.createDataFrame([], "tool long, text string, dense string")
    assert ranking.hybrid(spark.createDataFrame([(1, "a")], "query long, text string"), none, 3).collect() == []
    assert vectors.DIM == 128

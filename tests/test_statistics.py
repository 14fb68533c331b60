"""Resampling by counts: draws against the exact distribution, chains against their cells, tails against the library."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomstead.operators import statistics as st
from loomstead.plans import evaluation


def quantile(n, p, u):
    """The least k whose distribution function reaches u."""
    total = 0.0
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
        if total >= u:
            return k
    return n


def test_small_draws_are_exact_quantiles(spark):
    cases = [(n, p, (i + 0.5) / 40) for n in (1, 2, 17, 300) for p in (0.001, 0.2, 0.5, 0.77, 0.999) for i in range(40)]
    df = spark.createDataFrame(cases, "n long, p double, u double")
    got = df.select("n", "p", "u", st.binomial(F.col("n"), F.col("p"), F.col("u"), F.lit(0.3)).alias("k")).collect()
    for r in got:
        want = quantile(r.n, r.p, r.u) if r.p <= 0.5 else r.n - quantile(r.n, 1 - r.p, 1 - r.u)
        assert r.k == want


@pytest.mark.parametrize("n,p", [(2000, 0.4), (10**9, 0.003), (10**9, 0.999)])
def test_large_draws_follow_the_distribution(spark, n, p):
    k = st.binomial(F.lit(n), F.lit(p), st.uniform("a", F.col("id")), st.uniform("b", F.col("id")))
    r = spark.range(6000).select(k.alias("k")).agg(F.avg("k"), F.stddev("k"), F.min("k"), F.max("k")).first()
    sd = math.sqrt(n * p * (1 - p))
    assert abs(r[0] - n * p) < 4 * sd / math.sqrt(6000) and abs(r[1] / sd - 1) < 0.05 and 0 <= r[2] and r[3] <= n


def test_resampling_costs_cells_not_rows(spark):
    """Two billion rows of a group, given by their counts; means and errors are those of a multinomial."""
    cells = spark.createDataFrame([("g", 0, 0, 10**9), ("g", 0, 1, 5 * 10**8), ("g", 1, 1, 5 * 10**8), ("one", 1, 0, 3)], "g string, a int, b int, size long")
    counted = cells.withColumn("w", F.col("size"))
    table = counted.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("a", "b", "size"))).alias("cells"), F.sum("size").alias("n"))
    means = st.resampled_cells(table, "g", ["a", "b"], 400, "s").groupBy("g").agg(F.avg("a"), F.stddev("a"), F.avg("b"), F.stddev("b"), F.covar_samp("a", "b"), F.count("*"))
    got = {r.g: tuple(r)[1:] for r in means.collect()}
    n = 2 * 10**9
    a, sa, b, sb, together, rounds = got["g"]
    assert rounds == 400 and a == pytest.approx(0.25, abs=1e-5) and b == pytest.approx(0.5, abs=1e-5)
    assert sa == pytest.approx(math.sqrt(0.25 * 0.75 / n), rel=0.12) and sb == pytest.approx(math.sqrt(0.25 / n), rel=0.12) and together == pytest.approx(0.125 / n, rel=0.25)
    assert got["one"][0] == 1.0 and got["one"][1] == 0.0


def test_bits_are_counted_first(spark):
    bits = spark.createDataFrame([("g", int(i % 5 < 4)) for i in range(1000)] + [(None, 1)], "g string, x int")
    means = st.resampled(bits, "g", ["x"], 300, "s")
    by = {r.g: (r.m, r.s) for r in means.groupBy("g").agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).collect()}
    assert by[None] == (1.0, 0.0) and by["g"][0] == pytest.approx(0.8, abs=0.004) and by["g"][1] == pytest.approx(math.sqrt(0.16 / 1000), rel=0.15)
    assert means.where("g = 'g'").selectExpr("count(distinct x)").first()[0] > 20 and st.resampled(bits.limit(0), "g", ["x"], 5, "s").count() == 0


def test_mcnemar_tails(spark):
    for b, c in ((0, 0), (3, 3), (1, 9), (9000, 9500), (10_001, 10_500), (10**6, 10**6 + 3000), (10**9, 2 * 10**9), (10**9, 10**9)):
        p = spark.range(1).select(st.mcnemar(F.lit(b), F.lit(c))).first()[0]
        n, low = b + c, min(b, c)
        if low > 10_000:
            assert p == pytest.approx(min(1.0, math.erfc((abs(b - c) - 1) / math.sqrt(2 * n))) if b != c else 1.0, rel=1e-9, abs=1e-300)
        else:
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(low + 1))
            assert p == pytest.approx(min(1.0, 2 * tail) if n else 1.0, rel=1e-6)


def test_exact_mcnemar_has_no_switch(spark, tmp_path, monkeypatch):
    """Whole binomial tails in integers, on both sides of 10,000 of the rarer kind, and as the query gives them."""
    cases = [(0, 0), (0, 1), (3, 3), (3, 4), (1, 9), (0, 1000), (300, 2000), (9000, 9500), (10_001, 10_001), (10_001, 10_100), (10_500, 10_001), (20_000, 20_700)]
    df = spark.createDataFrame(cases, "b long, c long")
    for r in df.withColumn("p", st.exact_mcnemar(F.col("b"), F.col("c"))).collect():
        n, term, tail = r.b + r.c, 1, 1
        for i in range(1, min(r.b, r.c) + 1):
            term = term * (n - i + 1) // i
            tail += term
        assert r.p == pytest.approx(float(min(Fraction(1), Fraction(2 * tail, 2**n))), rel=1e-9, abs=0)
    # Far beyond: the tail that integers are too slow for, by the normal one, which is right to about 1 / sqrt(n) here.
    for b, c in ((10**9, 10**9), (10**9, 10**9 + 60_000), (10**9, 2 * 10**9)):
        p = spark.range(1).select(st.exact_mcnemar(F.lit(b), F.lit(c))).first()[0]
        assert p == pytest.approx(math.erfc((abs(b - c) - 1) / math.sqrt(2 * (b + c))) if b != c else 1.0, rel=1e-5)
    pairs = spark.createDataFrame([("g", 1, 0, 10_001), ("g", 0, 1, 10_100)], "category string, base int, ft int, times int")
    monkeypatch.setattr(evaluation, "_pairs", lambda *_: pairs.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_k", "times"))
    got = evaluation.mcnemar(spark, str(tmp_path)).first()
    exact = spark.range(1).select(F.round(st.exact_mcnemar(F.lit(10_001), F.lit(10_100)), 6)).first()[0]
    assert tuple(got) == ("g", 10_001, 10_100, exact) and got.p == 0.489427

"""Drawn charts and their questions: every answer from the values alone, by plain arithmetic."""

from collections import Counter
from fractions import Fraction

from loomstead.operators import chart_maker, chart_tables as ct


def number(text):
    return Fraction(text)


def test_answers_follow_from_the_values(spark):
    made = ct.tables(spark.range(3000).withColumnRenamed("id", "chart"))
    charts = {r.chart: r for r in made.collect()}
    assert set(Counter(r.type for r in charts.values())) == set(chart_maker.KINDS)
    for r in charts.values():
        assert len(r.q) == len(r.names) and all(len(row) == len(r.cats) for row in r.q) and (r.xs is not None) == (r.type == "scatter")
        if r.type != "scatter":
            assert all(len(set(row)) == len(row) and min(row) >= 100 for row in r.q)
    rows = ct.questions(made).collect()
    per = Counter(r.chart for r in rows)
    assert max(per.values()) == 2 and len({(r.chart, r.kind) for r in rows}) == len(rows)
    assert {r.kind for r in rows} == {k for kinds in chart_maker.KINDS.values() for k in kinds}
    for r in rows:
        c = charts[r.chart]
        assert r.kind in chart_maker.KINDS[c.type]
        unit = 10 if c.dec else 1
        series = next((i for i, n in enumerate(c.names) if len(c.names) > 1 and f" of {n}" in r.question), 0)
        row = [Fraction(v, unit) for v in c.q[series]]
        tall = [sum(Fraction(s[i], unit) for s in c.q) for i in range(len(c.cats))] if c.type == "stacked_bar" else row
        named = sorted((i for i, n in enumerate(c.cats) if f" {n}" in r.question.replace("?", " ") and c.type != "scatter"), key=lambda i: r.question.index(f" {c.cats[i]}"))
        if r.kind == "value_lookup":
            assert number(r.answer) == row[named[0]]
        elif r.kind in ("max", "min"):
            best = max(tall) if r.kind == "max" else min(tall)
            assert tall.count(best) == 1 and r.answer == c.cats[tall.index(best)]
        elif r.kind == "compare":
            assert (r.answer == "Yes") == (row[named[0]] > row[named[1]])
        elif r.kind == "difference":
            assert number(r.answer) == abs(row[named[0]] - row[named[1]])
        elif r.kind == "sum":
            assert number(r.answer) == (tall[named[0]] if c.type == "stacked_bar" else sum(row))
        elif r.kind == "mean":
            assert abs(number(r.answer) - sum(tall) / len(tall)) <= Fraction(1, 2 * unit)
        elif r.kind == "count":
            bar = number(r.question.split(" above ")[1].rstrip("?"))
            assert bar not in row and int(r.answer) == sum(v > bar for v in row)
        elif r.kind == "compare_then_compute":
            assert number(r.answer) == max(tall) - min(tall)
        elif r.kind == "trend":
            n = len(row)
            assert (r.answer == "increasing") == (sum((2 * i - n + 1) * v for i, v in enumerate(row)) > 0)
        elif r.kind == "proportion":
            assert abs(number(r.answer) - 100 * row[named[0]] / sum(row)) <= Fraction(1, 20)
        else:
            mx, my = Fraction(sum(c.xs), len(c.xs)), sum(row) / len(row)
            cov = sum((a - mx) * (b - my) for a, b in zip(c.xs, row))
            assert (r.answer == "positive") == (cov > 0) and cov**2 >= Fraction(9, 100) * sum((a - mx) ** 2 for a in c.xs) * sum((b - my) ** 2 for b in row)


def test_rows_and_none(spark):
    made = ct.tables(spark.range(50).withColumnRenamed("id", "chart"))
    flat = ct.long(made).collect()
    assert len(flat) == sum(len(r.q) * len(r.cats) for r in made.collect()) and made.collect() == ct.tables(spark.range(50).withColumnRenamed("id", "chart")).collect()
    none = ct.tables(spark.range(0).withColumnRenamed("id", "chart"))
    assert ct.questions(none).collect() == [] and ct.long(none).collect() == []
    assert len(ct.questions(made, 1).collect()) <= 50


def test_charts_are_dealt_to_all_cores_and_sorted_once(spark):
    made = ct.tables(spark.range(0, 50, 1, 1).withColumnRenamed("id", "chart"))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = ct.questions(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(_row") == 1

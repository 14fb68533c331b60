"""Queries over whole texts and all rows, on small tables that the registered SQL does not tell apart."""

import hashlib
from collections import Counter

import pytest

from loomstead import plans
from loomstead.plans import evaluation, examples


@pytest.fixture
def written(spark, tmp_path):
    """Writes a small table as ``name`` and gives the folder that queries read."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_chart_exact_dedup_reads_whole_texts(spark, written):
    opening = "Licensed under the terms that follow. " * 3
    texts = [opening + "one", opening + "TWO", opening + "two", opening + "three"]
    sf = written("documents", [(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert sorted(r.doc_id for r in plans.QUERIES["chart_exact_dedup"](spark, sf).collect()) == [0, 1, 3]


def test_over_refusal_keeps_whole_requests_of_all_languages(spark, written):
    long = "Compare the two offers " * 10
    sf = written("documents", [(1, long, "en"), (2, "Été" + long, "fr"), (3, "X", "es"), (4, "", "en"), (5, None, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in plans.QUERIES["over_refusal"](spark, sf).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].query.endswith(", c" + long[1:]) or got[1].query.endswith("but c" + long[1:])
    assert got[2].query.endswith("été" + long) and got[3].query.endswith(" x")
    assert {r.answer for r in got.values()} == {"call"}


def test_strip_think_passes_whole_texts(spark, written):
    long = "A long answer with <b>tags</b> and </think> further on. " * 5
    sf = written("documents", [(i, long, "en") for i in range(4)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.answer for r in plans.QUERIES["strip_think"](spark, sf).collect()}
    assert got[0] == got[1] == long and got[3] == "b</think>" + long
    assert got[2] == long[long.index("</think>") + len("</think>") :]


def test_dataset_digest_is_of_all_rows(spark, written, tmp_path):
    schema, rows = "doc_id long, text string, lang string", [(i, f"text {i}", ("es", "en", "fr")[i % 3]) for i in range(60)]

    def digest(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return plans.QUERIES["dataset_digest"](spark, f"{tmp_path}/{name}").first()

    rows.append((60, "text 1", "en"))
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    buckets = {}
    for h, n in Counter(sha([text]) for _, text, _ in rows).items():
        buckets.setdefault(h[:4], []).append(f"{h}:{n};")
    whole = digest("whole", rows)
    assert whole == digest("turned", rows[::-1]) == (sha(sha(sorted(buckets[b])) for b in sorted(buckets)), 61)
    assert digest("changed", [*rows[:1], (1, "text 1.", "en"), *rows[2:]]).digest != whole.digest
    assert digest("lost", rows[:-1]).digest != whole.digest
    assert digest("null", [*rows, (61, None, "en")]).digest != whole.digest


def test_conditions_outer_averages_all_rows(spark):
    """Every row of each system counts, those without a partner too."""
    sf = "/root/testdata/sf0.001"
    base, tuned = examples.systems(spark, sf)
    sides = [{}, {}]
    for side, df in zip(sides, (base, tuned), strict=True):
        for r in df.collect():
            side.setdefault(r.category, []).append(int(r.correct))
    mean = lambda bits: bits and sum(bits) / len(bits)
    got = {r.condition: (r.base, r.ft) for r in plans.QUERIES["conditions_outer"](spark, sf).collect()}
    assert got == {c: tuple(pytest.approx(mean(side[c]), abs=1e-6) for side in sides) for c in sides[0]} and sum(map(len, sides[1].values())) < sum(map(len, sides[0].values()))


def test_conditions_of_one_side_have_no_other(spark):
    base = spark.createDataFrame([("en", 1), ("en", 0), ("es", 1)], "category string, base int")
    ft = spark.createDataFrame([("en", 1), ("fr", 0)], "category string, ft int")
    assert {tuple(r) for r in evaluation._outer(base, ft).collect()} == {("en", 0.5, 1.0, 0.5), ("es", 1.0, None, None), ("fr", None, 0.0, None)}


@pytest.mark.parametrize("name", ["align_predictions", "conditions_outer"])
def test_both_systems_are_judged_in_one_pass(spark, name):
    """Examples are made once, and one pass asks all functions for both outputs."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert sum("FileScan" in line and "lineitem" in line for line in plan.splitlines()) == 1
    assert sum("ArrowEvalPython" in line for line in plan.splitlines()) == 1

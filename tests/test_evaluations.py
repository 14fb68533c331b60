"""Languages against matched twins, resampled shares, reading order, the line of a report; renderings and probes."""

import json

import pytest
from pyspark.sql import functions as F

from loomstead.functions import rendering
from loomstead.operators import evaluations as ev
from loomstead.sources import readers


def test_matched_pairs(spark):
    """English is right on all, Hindi fails where the pair is even; the last row of a pair and language counts."""
    rows = [(p, "en", 1, 0) for p in range(100)] + [(p, "hi", p % 2, 1) for p in range(80)] + [(p, "hi", 1, 0) for p in range(80)] + [(200, "hi", 0, 0), (3, None, 0, 0)]
    bits = ev.last_bits(spark.createDataFrame(rows, "pair_id int, lang string, ok int, at int"), ["at"])
    (delta,) = [r for r in ev.matched_deltas(bits, 300, "s").collect() if r.lang]
    assert (delta.lang, delta.pairs, delta.delta) == ("hi", 80, -0.5) and delta.lo <= -0.5 <= delta.hi and delta.p == 1.0
    got = {r.lang: r for r in ev.shares(bits, "lang", "ok", 300, "s").collect()}
    assert got["en"].accuracy == 1.0 and (got["en"].lo, got["en"].hi, got["en"].se) == (1.0, 1.0, 0.0)
    assert got["hi"].n == 81 and got["hi"].lo < got["hi"].accuracy < got["hi"].hi and got["hi"].se == pytest.approx((0.25 / 81) ** 0.5, rel=0.2) and got[None].n == 1


def test_twins_only(spark):
    metas = [{"source": "multilingual", "pair_id": "1", "lang": "en"}, {"source": "multilingual", "pair_id": "1"}, {"source": "orders", "pair_id": "1", "lang": "en"}, {}]
    assert ev.twins_only(spark.createDataFrame([(m,) for m in metas], "meta map<string,string>")).count() == 1


def test_reading_order(spark):
    rows = spark.createDataFrame([(c,) for c in ("zeta", "agentic", "simple", "alpha", "parallel")], "c string")
    assert [r.c for r in rows.orderBy(*ev.display_order(F.col("c"))).collect()] == ["simple", "parallel", "agentic", "alpha", "zeta"]


def test_the_line_of_a_report(spark):
    values = [F.lit(x) for x in (0.6, 0.5, 0.7, 0.9, 0.85, 0.95, 0.3, 0.2, 0.4, 0.001, 0.002)]
    line = spark.range(1).select(ev.significance(*values)).first()[0]
    assert line == "base 60.0% [50.0, 70.0]; tuned 90.0% [85.0, 95.0]; gap +30.0pp [+20.0, +40.0], bootstrap p 0.001, McNemar p 0.002; significant"


def test_indented_tools_and_own_probes(spark, tmp_path):
    text = json.dumps([{"name": "é", "description": "d"}])
    got = spark.createDataFrame([(text,), (None,)], "t string").select(rendering.indented("t")).collect()
    assert got[0][0] == json.dumps(json.loads(text), indent=2, sort_keys=True, ensure_ascii=False) and got[1][0] is None
    (tmp_path / "none.txt").write_text("\n \n")
    own = {r.text for r in readers.probes(spark).collect()}
    assert own == {r.text for r in readers.probes(spark, f"file://{tmp_path}/none.txt").collect()} == set(readers.HELD_OUT) and len(own) == 20

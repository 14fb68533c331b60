"""Rule statistics against a plain count, the forest on planted outliers, and odd tables."""

import re

import numpy as np
import pyarrow as pa
import pytest

from loomstead.llm import quality_rules, queries
from loomstead.llm.textbytes import text_chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "\n\na b\na b\n \n \na b ", "x " * 40, "one two\r\none two\r\n", "é " * 30 + "$$ | é", "a\x0bb\x0cc\x1cd", "l\n" * 9, ("w1 w2 w3 w4 w5 w6 w7 w8 q " * 2).strip(), "y z\n" + "k " * 5000]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(words) < 400 else None
    if covered is None:
        size = {}
        for w in windows:
            size[w] = size.get(w, 0) + 1
        covered = {i + j for i, w in enumerate(windows) if size[w] > 1 for j in range(8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered)]


@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
def test_counts_are_plain_counts(tables, limit):
    texts = ODD + [r.text for r in tables("documents").limit(150).collect()]
    got = np.concatenate([quality_rules.counts(t) for t in text_chunks(pa.array(texts, pa.string()), limit)])
    assert got[:, :5].tolist() == [plain(t) for t in texts]


def test_query_separates_labelled_rows(spark):
    rows = {r.doc_id: r for r in queries.op12_isolation_rules(spark, "/root/testdata/sf0.01").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert set(rows) == set(texts) and len(texts) == 1000
    for i, r in rows.items():
        n, chars, symbols, dups, repeats = plain(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and not (r.base_failed and r.kept)
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    assert np.mean([not r.kept for r, q in labels if q == 0]) > 0.95
    assert np.mean([r.kept for r, q in labels if q == 1 and not r.base_failed]) > 0.98


def test_rows_held_out_of_fitting_are_judged_alike(spark):
    """Trained on the odd half of the labels, judged on the even half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    stats = quality_rules.rule_statistics(docs)
    model = quality_rules.train(stats, labels.where("doc_id % 2 = 1"))
    judged = quality_rules.judge(stats, model).where("NOT base_failed").join(labels.where("doc_id % 2 = 0"), "doc_id").groupBy("quality").agg({"kept": "count", "anomaly": "avg"})
    kept = {r.quality: r.n for r in quality_rules.judge(stats, model).where("kept").join(labels.where("doc_id % 2 = 0"), "doc_id").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    total = {r.quality: r["count(kept)"] for r in judged.collect()}
    assert kept.get(0, 0) / total[0] < 0.05 and kept[1] / total[1] > 0.97


def test_forest_by_hand():
    """One feature, usual rows at 0 and one at 1, a box to 10: what is far out is isolated by about one split."""
    x = np.r_[np.zeros(63), 1.0][:, None]
    forest = quality_rules.grow(x, np.zeros(1), np.full(1, 10.0), trees=400, sample=64)
    usual, near, far = forest.scores(np.array([[0.0], [1.0], [10.0]]))
    assert usual < near < far
    # Whatever the first split, beyond it lies one usual row at most: a path of 1 in every tree.
    assert far == pytest.approx(2.0 ** -(1 / quality_rules.expected_path(64)))
    assert quality_rules.expected_path(np.array([1, 2])).tolist() == [0.0, 1.0]


def test_calibration():
    bins = {2000: (0, 5), 1500: (1, 4), 1000: (90, 1), 10: (9, 0)}
    assert quality_rules.calibrate(bins, 0.01) == 1500 / quality_rules.BINS
    assert quality_rules.calibrate(bins, 0.005) == 2000 / quality_rules.BINS
    assert quality_rules.calibrate({5: (3, 0)}) == quality_rules.calibrate({}) == 2.0
    assert quality_rules.calibrate({2000: (9, 0), 5: (0, 9)}) == 2.0


def test_odd_tables(spark):
    docs = spark.createDataFrame([(i % 5 if i else None, t, 7) for i, t in enumerate(ODD)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 5)], "doc_id long, quality int")
    for labels in (none, odd):
        got = quality_rules.filter_documents(docs, labels).collect()
        assert len(got) == len(ODD)
        assert sorted(r.n_words for r in got) == sorted(len(WORD.findall(t or "")) for t in ODD)
        assert all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.filter_documents(docs.limit(0), odd).collect() == []

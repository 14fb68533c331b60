"""Nulls, empty and long texts, repeated rows, empty tables and clashing names have the results the docstrings state."""

import pytest

from loomstead.llm import minhash, mixing, pairwise_quality, piece_bpe, pitman_yor, queries, sharding, simhash, substring_dedup, url_rules, vector_neardup
from loomstead.llm.staging import Masked, fresh

#: Beside the columns of documents, names that operators use themselves.
EXTRA = "score double, size long, copies long, block int, part int, id long, position long, shard int, rep long, _run int, turn int, kept boolean"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
CLASH = (0.5, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, False)
TEXTS = [(1, "One two three four five six."), (1, "One two three four five six."), (2, None), (3, ""), (4, "  \n\t"), (None, "no id here at all"), (5, "word " * 60_000), (6, "x" * 150_000), (7, "One two three four five six.")]


def rows_of(texts):
    return [(i, t, None if k % 3 else "en", None if k % 2 else "src0", None, *CLASH) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_quality(spark, odd, none):
    model = pairwise_quality.train(odd, labels(spark))
    assert {r.quality_ for r in pairwise_quality.score(odd, model, name="quality_").collect()} == {0.5}
    model = pairwise_quality.train(odd, labels(spark, [(1, 1, 0), (3, 0, None), (7, None, 1), (99, 1, 1), (6, 0, 0), (2, 0, 0), (4, 0, 0)]))
    got = pairwise_quality.score(odd.select("doc_id", "text"), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 7)}) == 1 and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert pairwise_quality.score(none, model, name="s2").count() == 0 and pairwise_quality.train(none, labels(spark)).spread == 0


def test_pieces(odd, none):
    got = piece_bpe.encode_decode(odd, queries.piece_model()).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t in TEXTS)
    assert all(not r.ids for r in got if r.doc_id in (2, 3))
    assert piece_bpe.encode_decode(none, queries.piece_model()).count() == 0


def test_pitman_yor(odd, none):
    got = pitman_yor.score(odd).collect()
    assert len(got) == len(TEXTS) and all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 4)) and [r.held_out for r in got if r.doc_id is None] == [True]
    assert len({r.base_score for r in got if r.doc_id in (1, 7)}) == 1 and all(r.score < 0 for r in got)
    assert pitman_yor.score(none).count() == 0
    nothing = pitman_yor.score(odd.where("doc_id IS NULL")).collect()
    assert [(r.train_tokens, r.base_score, r.score) for r in nothing] == [(0, 0.0, 0.0)]


def test_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), (None, None, None), ("A.net", "/b", "allow"), ("a.net", "/b", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.net/" + "b/" * 300, "x"), (1, "http://a.net/b", "x"), (2, None, "x"), (None, "://", "x")], "page_id long, url string, host string")
    got = sorted(((r.page_id or 0, r.host, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()), key=str)
    assert got == sorted([(1, "a.net", "a.net/b", "block"), (1, "a.net", "a.net/b", "block"), (2, "", None, "allow"), (0, "", None, "allow")], key=str)
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://" + "s." * 3000 + "a.net/b/" + "c/" * 50_000)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_rules.judge_urls(long, rules).collect()] == [("a.net/b", "block")]
    accented = spark.createDataFrame([("\u00c4.net", "/", "block")], "host string, path string, action string")
    assert [r.verdict for r in url_rules.judge_urls(spark.createDataFrame([(1, "http://\u00c4.NET/")], "page_id long, url string"), accented).collect()] == ["block"]
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, cell long, rep long"
    rows = [(1, [1.0, 0.0], None, 0, 0), (1, [1.0, 0.0], 1, 0, 0), (2, [2.0, 0.0], 1, 0, 0), (3, [0.0, 0.0], 1, 0, 0), (4, None, 1, 0, 0), (5, [float("inf"), 1.0], 1, 0, 0), (None, [1.0, 0.0], 1, 0, 0)]
    got = vector_neardup.link_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert vector_neardup.link_vectors(spark.createDataFrame([], schema)).count() == 0


def test_repeats(odd, none):
    got = substring_dedup.without_repeats(odd)
    assert got.columns == odd.columns
    rows = {(r.doc_id, r.text, r.size) for r in got.collect()}
    assert (2, "", 7) in rows and (1, TEXTS[0][1], 7) in rows and (6, "x" * 150_000, 7) in rows and got.count() == len(TEXTS)
    assert substring_dedup.without_repeats(none).count() == 0


def test_sharding(odd, none):
    got = sharding.shard(odd, 3).collect()
    assert len(got) == len(TEXTS) and {r.size for r in got if r.doc_id in (2, 3)} == {8} and {r.text_crc32 for r in got if r.doc_id in (2, 3)} == {0}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(3))
    assert sharding.shard(none).columns == sharding.shard(odd).columns and sharding.shard(none).count() == 0


def test_simhash(odd, none):
    got = simhash.edited_fingerprints(odd).collect()
    assert len(got) == len(TEXTS) and {r.fp for r in got if r.doc_id in (2, 3, 4)} == {0} and len({r.fp for r in got if r.doc_id in (1, 7)}) == 1
    assert simhash.edited_fingerprints(none).count() == 0
    alone = simhash.edited_fingerprints(odd.where("doc_id = 7")).collect()
    assert alone[0].fp == alone[0].next_fp


def test_mixing(odd, none):
    got = mixing.sample(odd)
    assert got.columns == odd.columns and mixing.sample(none).count() == 0
    assert all(r.size == 7 for r in got.collect())
    assert mixing.draw(odd).where("size = 0").count() == 3 and mixing.draw(odd).count() == len(TEXTS)
    twins = odd.sparkSession.createDataFrame([(1, "a b c", "s", 1), (1, "a b c", "s", 2), (None, "a b c", "s", 3), (None, "a b c", "s", 4), (2, "d", None, 5), (3, "e", "t", 6)], "doc_id long, text string, source string, copies long")
    got, drawn = mixing.sample(twins).collect(), mixing.draw(twins).collect()
    assert sorted((str(r.doc_id), r.source or "") for r in got) == sorted((str(r.doc_id), r.source or "") for r in drawn for _ in range(r.copies))
    assert {r.copies for r in got if r.source == "s"} == {1, 2, 3, 4}


def test_near_duplicates(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == sorted([(1, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (0, None, True), (5, 5, True), (6, 6, True), (7, 1, False)], key=lambda x: x[0])
    one = minhash.keep_one(odd)
    assert one.columns == odd.columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_names(odd):
    assert fresh(["Score", "_score"], "score") == "__score"
    plain = Masked(odd, ("doc_id",))
    assert plain.back(plain.df).columns == odd.columns

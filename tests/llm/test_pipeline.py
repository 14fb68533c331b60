"""The pipeline's stages against the brute-force versions of the operators, each on its own input."""

import hashlib

import corpus_pipeline
from loomstead.llm import mixing, queries
from loomstead.llm.staging import Stage
from test_operators import near_by_hand, repeats_by_hand

import pytest

from conftest import DATA


def test_stages(spark, tables):
    stage, sf_dir = Stage(spark, "test"), f"{DATA}/sf0.001"
    docs, seen = tables("documents"), []
    for name, apply in corpus_pipeline.STAGES:
        after = stage.cut(apply(spark, docs, sf_dir))
        seen.append(name)
        if name != "tokens":
            assert after.columns == docs.columns
        before, now = docs.collect(), after.collect()
        if name == "quality":
            bad = {r.doc_id for r in tables("labels").collect() if r.quality == 0}
            kept = {r.doc_id for r in now}
            good = {r.doc_id for r in tables("labels").collect() if r.quality == 1}
            assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.2 * len(bad)
        elif name == "near_duplicates":
            _, comps = near_by_hand([(r.doc_id, r.text) for r in before], 5, 80)
            assert {r.doc_id for r in now} == set(comps.values())
        elif name == "repeated_passages":
            want = repeats_by_hand([(r.doc_id, r.text) for r in before])
            same = sum(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3] for r in now)
            assert len(now) == len(before) and same >= 0.98 * len(now) and all(r.n_chars == len(r.text) for r in now)
        elif name == "mix_sources":
            copies = {r.doc_id: r.copies for r in mixing.draw(docs).collect()}
            assert sorted(r.doc_id for r in now) == sorted(i for i, c in copies.items() for _ in range(c))
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
            text = {r.doc_id: r.text for r in before}
            assert len(now) == len(before) and all(r.ids == library.encode(text[r.doc_id]) for r in now)
        docs = after
    assert seen == ["quality", "near_duplicates", "repeated_passages", "mix_sources", "tokens"]


EXTRA = "score double, size long, copies long, position long, turn int, part int, kept boolean, tie long"


def written(spark, tmp_path, docs, labels=()):
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def row(i, text, source="web"):
    return (i, text, None, source, None if text is None else len(text), 0.5, 1, 2, 3, 4, 5, None, 6)


def test_run_with_odd_rows(spark, tmp_path):
    import sentencepiece

    own = [f"Document {i} tells of {i * 37} birds, {i * 11} boats and a harbour that {i} people know well enough." for i in range(20)]
    shared = "This passage of more than fifty bytes stands in two documents, word for word. "
    docs = [row(i, t) for i, t in enumerate(own)] + [
        row(100, own[3]), row(101, own[4] + " Now."), row(3, own[3]), row(102, None), row(103, ""), row(104, "  \n"), row(None, "A row without an id."), row(None, "A row without an id."), row(105, "word " * 50_000, None),
        row(106, shared + "One.", None), row(107, "Two, quite another text. " + shared, None), row(108, "x" * 200_000, None),
    ]
    got = corpus_pipeline.run(spark, written(spark, tmp_path, docs)).collect()
    library = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    ids = [r.doc_id for r in got]
    assert not {100, 101} & set(ids) and max(ids.count(i) for i in set(ids) - {None}) <= 2 and set(ids) & set(range(20))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == digest(",".join(map(str, r.ids))) and r.decoded_sha256 == digest(library.decode(r.ids))
    by_id = {r.doc_id: library.decode(r.ids) for r in got}
    assert all(by_id[i] == own[i] for i in range(20) if i in by_id)
    assert by_id.get(107, "Two, quite another text. ").startswith("Two, quite another text. ") and shared not in by_id.get(107, "")


def test_run_with_nothing(spark, tmp_path):
    got = corpus_pipeline.run(spark, written(spark, tmp_path, []))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_all_columns(spark, tmp_path, name):
    sf_dir = written(spark, tmp_path, [row(i, f"text {i} of some words") for i in range(5)], [(0, 1, 0), (1, 0, 0)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).columns == docs.columns

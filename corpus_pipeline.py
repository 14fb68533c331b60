"""The corpus pipeline: five stages over ``documents``, each a whole-table pass of one operator.

Every stage but the last returns the columns it got, extra ones included whatever their names. An empty table
goes through all stages as an empty table. What null, empty and repeated rows become is said at each stage; texts
of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomstead.llm import minhash, mixing, pairwise_quality, piece_bpe, substring_dedup
from loomstead.llm.queries import piece_model
from loomstead.llm.staging import Stage, fresh


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise classifier accepts; it learns from the labels of this input.

    Null and empty texts are scored like any other; with labels of one kind only, or none, every document stays.
    Equal texts are accepted or rejected together, each row for itself.
    """
    model = pairwise_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs.columns, "score")
    return pairwise_quality.score(docs, model, name=name).where(F.col(name) >= pairwise_quality.CUT).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id: five-word shingles, similarity 0.8 or more.

    Of rows that share a doc_id one stays. Rows without words and rows with a null doc_id all stay.
    """
    return minhash.keep_one(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document of a smaller doc_id has.

    No row goes: a null text becomes an empty one, and so may a text all of which stands elsewhere. A null doc_id
    counts as larger than all. A character that loses some of its bytes goes as a whole.
    """
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them: not at all, once or twice.

    Rows of a null source are a source of their own, the last. Texts without words may be drawn; a source of nothing
    else has target 0 and gives no rows. Equal rows are documents of their own.
    """
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document, and digests of them and of the text they decode to.

    A null text has no ids. Of the columns only doc_id goes on; every drawn row has its row.
    """
    done = piece_bpe.encode_decode(docs, piece_model())
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix_sources", mix_sources), ("tokens", tokens)]
#: The classifier, near-duplicates and tokenizer are not SQL-expressible; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is a written table in the shared folder and is read again."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = stage.cut(apply(spark, docs, sf_dir))
    return docs

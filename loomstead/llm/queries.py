"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_repair, hard_negatives, minhash, mixing, pairwise_quality, piece_bpe, pitman_yor, quality_rules, sharding, simhash, substring_dedup, url_rules, vector_neardup
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neardup.link_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_columnwise_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.draw(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pairwise_quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = pairwise_quality.score(docs, model, drop_text=True)
    return scored.select("doc_id", pairwise_quality.held_out().alias("held_out"), "score", (F.col("score") >= pairwise_quality.CUT).cast("int").alias("predicted"))


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_bpe.encode_decode(_table(spark, sf_dir, "documents"), piece_model())
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_fingerprints(simhash.edited_fingerprints(_table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_hex(F.col("fp")).alias("fingerprint"), simhash.as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", moved.alias("label")))


def op12_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.filter_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_repair.summary(conversation_repair.repair(conversation_repair.damage(conversations), conversations))


QUERIES = {f.__name__: f for f in (op1_pairwise_quality, op2_sentencepiece, op3_pitman_yor, op4_url_rules, op5_collision_counting, op6_columnwise_bwt, op7_vector_packing, op8_simhash, op9_systematic_mix, op10_circulant_minhash, op11_vantage_negatives, op12_isolation_rules, op13_conversation_repair)}

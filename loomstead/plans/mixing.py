"""Tool pools, splits, shares, subsets, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import draw
from ..operators import shaping, similarity
from ..operators.ordering import ordered
from . import query, table


@query("SELECT p_name AS name, min(p_partkey) AS first_key, count(*)::BIGINT AS offered FROM part GROUP BY p_name")
def tool_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tools by name; the first one wins."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("offered"))


_SPLIT = """
k AS (SELECT conv_id, row_number() OVER (ORDER BY md5('split|' || conv_id), conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
s AS (SELECT conv_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM k)
"""


@query(f"WITH {_SPLIT} SELECT c.conv_id, c.turn, s.split FROM conversations c JOIN s USING (conv_id)")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a conversation in one split."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return turns.join(shaping.group_split(turns.select("conv_id"), "conv_id"), "conv_id")


@query(f"WITH {_SPLIT} SELECT s.split, c.role, count(*)::BIGINT AS n, count(DISTINCT c.conv_id)::BIGINT AS conversations FROM conversations c JOIN s USING (conv_id) GROUP BY GROUPING SETS ((s.split), (s.split, c.role))")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role")
    both = turns.join(shaping.group_split(turns.select("conv_id"), "conv_id"), "conv_id")
    return both.groupingSets([["split"], ["split", "role"]], "split", "role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


@query(
    """WITH b AS (SELECT DISTINCT p_brand AS name FROM part),
r AS (SELECT name, row_number() OVER (ORDER BY md5('novel|' || name), name) AS k, count(*) OVER () AS n FROM b),
h AS (SELECT name FROM r WHERE k <= floor(n * 0.2)),
x AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey AS order_key, CASE WHEN count(h.name) = count(*) THEN 'test_novel' WHEN count(h.name) = 0 THEN 'train' ELSE 'dropped' END AS route
FROM x LEFT JOIN h ON h.name = x.p_brand GROUP BY l_orderkey"""
)
def novel_tool_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as examples, brands of their lines as tools: all new, none new, or mixed."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(similarity.small(part), "l_partkey").select(F.col("l_orderkey").alias("id"), "name").distinct()
    return shaping.route_by_names(used, part.select("name"), 0.2).withColumnRenamed("id", "order_key")


_RATIOS = {"hard_negative": 0.22, "multi_turn": 0.20, "drift": 0.08}


@query("SELECT unnest(['hard_negative', 'multi_turn', 'drift']) AS slice, unnest([round(n / (1 - 0.5) * 0.22), round(n / (1 - 0.5) * 0.20), round(n / (1 - 0.5) * 0.08)])::BIGINT AS n_rows FROM (SELECT count(*)::DOUBLE AS n FROM documents)")
def slice_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n"))
    return n.select(F.explode_outer(F.array(*[F.struct(F.lit(name).alias("slice"), size.cast("long").alias("n_rows")) for name, size in shaping.slice_sizes(F.col("n"), _RATIOS)])).alias("e")).select("e.*")


@query("SELECT source, lang, count(*)::BIGINT AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY GROUPING SETS ((source), (lang), (source, lang))")
def mix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang")
    n = docs.agg(F.count("*").alias("all"))
    counted = docs.groupingSets([["source"], ["lang"], ["source", "lang"]], "source", "lang").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(n)).select("source", "lang", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


@query("SELECT round(avg((quality = 0)::INT), 6) AS no_tool_share, count(*) FILTER (WHERE toxic = 1)::BIGINT AS miss_param, avg((quality = 0)::INT) BETWEEN 0.06 AND 0.14 AND count(*) FILTER (WHERE toxic = 1) >= 10 AS passes FROM labels")
def mix_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mix is inside its guard band."""
    share, few = F.avg((F.col("quality") == 0).cast("int")), F.count_if(F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").agg(F.round(share, 6).alias("no_tool_share"), few.alias("miss_param"), (share.between(0.06, 0.14) & (few >= 10)).alias("passes"))


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('ablation|' || doc_id), 1, 8))::BIGINT, doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, f AS fraction FROM r, (VALUES (0.25::DOUBLE), (0.5), (1.0)) t(f) WHERE k <= greatest(1, floor(n * f))"""
)
def ablation_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.nested_subsets(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", (0.25, 0.5, 1.0))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def artifact_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    """WITH r AS (SELECT coalesce(sha256(text), '') AS h, count(*) AS n FROM documents GROUP BY 1),
b AS (SELECT substr(h, 1, 4) AS bucket, sha256(string_agg(h || ':' || n || ';', '' ORDER BY h || ':' || n || ';')) AS d, sum(n) AS n FROM r GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY bucket)) AS digest, sum(n)::BIGINT AS n FROM b"""
)
def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all rows that doesn't depend on their order.

    Distinct row digests with their counts are sorted in buckets of the digest's first four digits, and
    the digests of the buckets, 65,537 at most, are digested in turn. A null text has an empty row digest.
    """
    rows = table(spark, sf_dir, "documents").groupBy(F.coalesce(F.sha2("text", 256), F.lit("")).alias("h")).agg(F.count("*").alias("n"))
    counted = F.array_sort(F.collect_list(F.concat("h", F.lit(":"), F.col("n").cast("string"), F.lit(";"))))
    buckets = rows.groupBy(F.substring("h", 1, 4).alias("bucket")).agg(F.sha2(F.array_join(counted, ""), 256).alias("d"), F.sum("n").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda b: b["d"])
    return buckets.agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents ORDER BY turn, lang, source, doc_id LIMIT 100")
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 100 documents that take turns over language and source."""
    return shaping.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], 100)


@query("SELECT event_id, 'BFCL_v4_' || event_type || '_' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS export_id FROM events")
def bfcl_export_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export ids numbered from 0 within a category, in input order."""
    numbered = ordered(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], "number")
    return numbered.select("event_id", F.concat(F.lit("BFCL_v4_"), "event_type", F.lit("_"), F.col("number").cast("string")).alias("export_id"))


@query(
    """WITH t AS (SELECT doc_id, source, CASE WHEN lang IN ('es') THEN NULL ELSE source END AS g FROM documents),
r AS (SELECT g, row_number() OVER (ORDER BY md5('chart|' || g), g) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM t WHERE g IS NOT NULL))
SELECT t.doc_id, CASE WHEN t.g IS NULL THEN 'test_novel' WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM t LEFT JOIN r USING (g)"""
)
def novel_type_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of held-out types (a language here) go to test_novel; the rest is split by group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "es", F.col("source")).alias("g"))
    split = shaping.group_split(docs.where("g IS NOT NULL").select("g"), "g", seed="chart")
    return docs.join(split, "g", "left").select("doc_id", F.coalesce("split", F.lit("test_novel")).alias("split"))


@query("SELECT doc_id, ('0x' || substr(md5('kind|' || doc_id), 1, 8))::BIGINT % 100 AS draw, CASE WHEN ('0x' || substr(md5('kind|' || doc_id), 1, 8))::BIGINT % 100 < 35 THEN 'recovery' WHEN ('0x' || substr(md5('kind|' || doc_id), 1, 8))::BIGINT % 100 < 65 THEN 'fault' ELSE 'clean' END AS kind FROM documents")
def weighted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted choice by a counter draw."""
    d = draw("kind", F.col("doc_id")) % 100
    return table(spark, sf_dir, "documents").select("doc_id", d.alias("draw"), F.when(d < 35, "recovery").when(d < 65, "fault").otherwise("clean").alias("kind"))


@query(
    """WITH a AS (SELECT doc_id, 1 AS part, NULL AS hn_kind FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, 2 AS part, lang AS hn_kind FROM documents WHERE lang <> 'en' OR lang IS NULL)
SELECT doc_id, hn_kind, row_number() OVER (ORDER BY part, doc_id) - 1 AS ord FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
)
def slice_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag union of slices with different columns (positives, and hard negatives with their kind); positions start anew, slice after slice."""
    docs = table(spark, sf_dir, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    positives = docs.where(english).select("doc_id", F.lit(1).alias("part"))
    negatives = docs.where(~english).select("doc_id", F.lit(2).alias("part"), F.col("lang").alias("hn_kind"))
    every = positives.unionByName(negatives, allowMissingColumns=True)
    return ordered(every, [], ["part", "doc_id"], "ord").select("doc_id", "hn_kind", "ord")

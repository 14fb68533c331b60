"""Tool retrieval and the decision simulator: part types are tools, documents and names are queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ranking
from ..operators.ordering import ordered
from . import query, table

_STOP = ", ".join(f"'{w}'" for w in ranking.STOP_WORDS)
_T = f"""
tools AS (SELECT row_number() OVER (ORDER BY name) AS tool, name FROM (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part)),
tt AS (SELECT tool, term, count(*) AS tf FROM (SELECT tool, unnest(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) AS term FROM tools) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM tools) + 1) / (count(*) + 0.5)) + 1 AS idf FROM tt GROUP BY term),
qs AS (SELECT DISTINCT p_brand || ' ' || p_type AS text FROM part), q AS (SELECT row_number() OVER (ORDER BY text) AS query, text FROM qs),
qt AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) AS term FROM q) GROUP BY ALL),
s AS (SELECT query, tool, sum(times * tf * idf) AS score FROM qt JOIN tt USING (term) JOIN idf USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, tool) AS place FROM s)
"""


def _pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    tools = part.select(F.concat_ws(" ", "p_name", "p_type").alias("text")).distinct()
    queries = part.select(F.concat_ws(" ", "p_brand", "p_type").alias("text")).distinct()
    number = lambda df, name: ordered(df, [], ["text"], name).withColumn(name, (F.col(name) + 1).cast("int"))
    return number(tools, "tool"), number(queries, "query")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    tools, queries = _pool(spark, d)
    return ranking.lexical(queries, tools)


@query(f"WITH {_T} SELECT query, tool, place, round(score, 6) AS score FROM k WHERE place <= 5")
def tfidf_retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(_scores(spark, sf_dir), 5).select("query", "tool", "place", F.round("score", 6).alias("score"))


_HYBRID = f"""
tools AS (SELECT row_number() OVER (ORDER BY name, kind) AS tool, name, kind FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS name, p_type AS kind FROM part)),
q AS (SELECT row_number() OVER (ORDER BY text) AS query, text FROM (SELECT DISTINCT p_brand || ' ' || p_type AS text FROM part)),
ta AS (SELECT tool, list_filter(regexp_extract_all(lower(name || ' ' || replace(name, '_', ' ') || ' ' || kind || ' quantity note'), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})) AS w FROM tools),
tt AS (SELECT tool, term, count(*) AS tf FROM (SELECT tool, unnest(w) AS term FROM ta) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM tools) + 1) / (count(*) + 0.5)) + 1 AS idf FROM tt GROUP BY term),
qt AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) AS term FROM q) GROUP BY ALL),
s AS (SELECT query, tool, sum(times * tf * idf) AS score FROM qt JOIN tt USING (term) JOIN idf USING (term) GROUP BY ALL),
wv AS (SELECT side, id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: ('0x' || substr(md5('v|' || x), 1, 8))::BIGINT) AS h FROM (SELECT 'q' AS side, query AS id, text FROM q UNION ALL SELECT 't', tool, name || '. ' || kind || '. params: quantity, note' FROM tools)),
gv AS (SELECT side, id, unnest(list_distinct(list_concat(list_transform(h, lambda x: (x * 7919 + 1) % 2147483647), list_transform(range(1, len(h)), lambda i: (h[i] * 1000003 + h[i + 1]) % 2147483647)))) AS g FROM wv),
cv AS (SELECT side, id, g % 128 AS d, sum(1 - 2 * (g // 128 % 2)) AS x FROM gv GROUP BY ALL),
vec AS (SELECT i.side, i.id, list(coalesce(cv.x, 0)::DOUBLE ORDER BY r.d) AS v FROM (SELECT DISTINCT side, id FROM cv) i CROSS JOIN range(128) r(d) LEFT JOIN cv ON cv.side = i.side AND cv.id = i.id AND cv.d = r.d GROUP BY ALL),
b AS (SELECT a.id AS query, t.id AS tool, coalesce(s.score, 0) AS l, list_cosine_similarity(a.v, t.v) AS d FROM vec a JOIN vec t ON a.side = 'q' AND t.side = 't' LEFT JOIN s ON s.query = a.id AND s.tool = t.id),
m AS (SELECT *, min(l) OVER w AS ll, max(l) OVER w AS lh, min(d) OVER w AS dl, max(d) OVER w AS dh FROM b WINDOW w AS (PARTITION BY query)),
f AS (SELECT w.weight, query, tool, round((1 - weight) * CASE WHEN lh - ll >= 1e-12 THEN (l - ll) / (lh - ll) ELSE 0 END + weight * CASE WHEN dh - dl >= 1e-12 THEN (d - dl) / (dh - dl) ELSE 0 END, 9) AS score FROM m, (VALUES (0.3::DOUBLE), (0.7)) w(weight))
"""


@query(f"WITH {_HYBRID} SELECT weight, query, tool, row_number() OVER (PARTITION BY weight, query ORDER BY score DESC, tool) AS place, round(score, 6) AS score FROM f QUALIFY place <= 5")
def hybrid_retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best tools of every query by lexical and dense scores, at two weights of the latter."""
    part = table(spark, sf_dir, "part")
    params = F.array(F.lit("quantity"), F.lit("note"))
    tools = ordered(part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.col("p_type").alias("kind")).distinct(), [], ["name", "kind"], "tool")
    tools = tools.select((F.col("tool") + 1).alias("tool"), ranking.tool_text(F.col("name"), F.col("kind"), params).alias("text"), ranking.dense_text(F.col("name"), F.col("kind"), params).alias("dense"))
    queries = ordered(part.select(F.concat_ws(" ", "p_brand", "p_type").alias("text")).distinct(), [], ["text"], "query").withColumn("query", F.col("query") + 1)
    one, two = (ranking.hybrid(queries, tools, 5, w).withColumn("weight", F.lit(w)) for w in (0.3, 0.7))
    return one.unionByName(two).select("weight", "query", "tool", "place", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_T}, g AS (SELECT q.query, min(t.tool) AS gold FROM q JOIN tools t ON ends_with(t.name, regexp_extract(q.text, '^[^ ]+ (.*)$', 1)) GROUP BY 1),
h AS (SELECT g.query, bool_or(coalesce(k.tool = g.gold, false)) AS hit FROM g LEFT JOIN k ON k.query = g.query AND k.place <= 5 GROUP BY 1) SELECT count(*)::BIGINT AS queries, round(avg(hit::INT), 6) AS recall_at_5 FROM h"""
)
def retrieval_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries whose gold tools are all among the five retrieved."""
    tools, queries = _pool(spark, sf_dir)
    kind = queries.select("query", F.regexp_extract("text", "^[^ ]+ (.*)$", 1).alias("type"))
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_type").alias("type")).distinct().join(tools, "text")
    gold = kind.join(names, "type").groupBy("query").agg(F.array(F.min("tool")).alias("gold"))
    got = ranking.top_k(ranking.lexical(queries, tools), 5).groupBy("query").agg(F.collect_set("tool").alias("got"))
    both = gold.join(got, "query", "left").withColumn("hit", F.size(F.array_except("gold", F.coalesce("got", F.array().cast("array<int>")))) == 0)
    return both.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("recall_at_5"))


@query(
    f"""WITH {_T}, m AS (SELECT query, tool, score, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi FROM s),
f AS (SELECT query, tool, 0.5 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END + 0.5 / tool AS fused FROM m) SELECT query, tool, round(fused, 6) AS fused FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(fused, 9) DESC, tool) = 1"""
)
def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best tool by a half-and-half blend of scaled lexical scores and another score."""
    fused = ranking.scaled(_scores(spark, sf_dir)).withColumn("score", 0.5 * F.col("score") + 0.5 / F.col("tool"))
    return ranking.top_k(fused, 1).select("query", "tool", F.round("score", 6).alias("fused"))


@query(
    f"""WITH {_T}, o AS (SELECT query, tool, count(*) AS score, tool % 7 <> 0 AS complete FROM qt JOIN tt USING (term) WHERE term NOT LIKE 'brand%' GROUP BY ALL),
b AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM o), t AS (SELECT query, count(*) AS n, min(tool) AS tool, bool_or(complete) AS complete FROM b WHERE score = best GROUP BY query)
SELECT q.query, CASE WHEN n IS NULL THEN 'refuse' WHEN n > 1 OR NOT complete THEN 'clarify' ELSE 'call' END AS action, CASE WHEN n = 1 AND complete THEN tool END AS tool FROM q LEFT JOIN t USING (query)"""
)
def decision_simulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refuse, clarify or call by word overlap with the pool."""
    from ..functions.text import exploded

    tools, queries = _pool(spark, sf_dir)
    t = exploded(tools.select("tool", F.array_distinct(ranking.terms(F.col("text"))).alias("w")), "w", "term")
    q = exploded(queries.select("query", F.array_distinct(ranking.terms(F.col("text"))).alias("w")), "w", "term").where("term NOT LIKE 'brand%'")
    overlaps = q.join(t, "term").groupBy("query", "tool").agg(F.count("*").alias("score")).withColumn("complete", F.col("tool") % 7 != 0)
    return ranking.decide(overlaps, queries)

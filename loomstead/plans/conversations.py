"""Histories, turns, renderings, curricula over conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import tokens, without_thinking
from ..operators.ordering import ordered
from ..operators import shaping, similarity
from . import query, table


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turns): one ordered array of turns for each conversation."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


@query("SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def history_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"]))
    return _turns(spark, sf_dir).select("conv_id", F.array_join(lines, "\n").alias("history"))


@query("SELECT conv_id, turn, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations")
def history_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn has before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array_join(F.collect_list("role").over(w), ">")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.size(F.collect_list("role").over(w)) > 0, before).alias("before"))


@query(
    """WITH u AS (SELECT conv_id, min(turn) AS u FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT c.conv_id, u.u, min(c.turn) AS a FROM conversations c JOIN u USING (conv_id) WHERE c.role = 'assistant' AND c.turn > u.u GROUP BY ALL)
SELECT a.conv_id, x.text AS query, y.text AS answer FROM a JOIN conversations x ON x.conv_id = a.conv_id AND x.turn = a.u JOIN conversations y ON y.conv_id = a.conv_id AND y.turn = a.a"""
)
def first_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First user turn and the first assistant turn after it."""
    cut = _turns(spark, sf_dir).withColumn("u", F.try_element_at(F.filter("turns", lambda t: t["role"] == "user"), F.lit(1)))
    reply = F.try_element_at(F.filter("turns", lambda t: (t["role"] == "assistant") & (t["turn"] > F.col("u.turn"))), F.lit(1))
    return cut.where("u IS NOT NULL").withColumn("a", reply).where("a IS NOT NULL").select("conv_id", F.col("u.text").alias("query"), F.col("a.text").alias("answer"))


@query("SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY conv_id")
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"))


@query("SELECT conv_id, g AS grp, count(*)::BIGINT AS n, min(turn) AS first_turn FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS g FROM conversations) GROUP BY conv_id, g")
def turn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn opens a new group."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    cut = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "user").cast("long")).over(w).alias("grp"))
    return cut.groupBy("conv_id", "grp").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query(
    """WITH l AS (SELECT conv_id, max(turn) AS l FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE turn < l) AS prompt, max(text) FILTER (WHERE turn = l) AS completion FROM conversations c JOIN l USING (conv_id) GROUP BY c.conv_id"""
)
def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completion: everything before the last assistant turn, and that turn."""
    cut = _turns(spark, sf_dir).withColumn("last", F.array_max(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["turn"])))
    before = F.filter("turns", lambda t: t["turn"] < F.col("last"))
    prompt = F.when(F.size(before) > 0, F.array_join(F.transform(before, lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"])), "\n"))
    final = F.element_at(F.filter("turns", lambda t: t["turn"] == F.col("last")), 1)["text"]
    return cut.where("last IS NOT NULL").select("conv_id", prompt.alias("prompt"), final.alias("completion"))


@query(
    """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '<think>why</think>' || text WHEN 2 THEN '<THINK>open ' || text ELSE 'x<think>a</think>b</think>' || text END AS t FROM documents)
SELECT doc_id, CASE WHEN instr(lower(t), '<think>') = 0 THEN t WHEN instr(substr(lower(t), instr(lower(t), '<think>')), '</think>') = 0 THEN NULL
  ELSE substr(t, instr(lower(t), '<think>') + instr(substr(lower(t), instr(lower(t), '<think>')), '</think>') + 7) END AS answer FROM t"""
)
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer part of outputs with no, closed, open and repeated reasoning blocks."""
    text, k = F.col("text"), F.col("doc_id") % 4
    made = F.when(k == 0, text).when(k == 1, F.concat(F.lit("<think>why</think>"), text)).when(k == 2, F.concat(F.lit("<THINK>open "), text)).otherwise(F.concat(F.lit("x<think>a</think>b</think>"), text))
    return table(spark, sf_dir, "documents").select("doc_id", without_thinking(made).alias("answer"))


_DIFF = """
d AS (SELECT o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 'refuse' WHEN o_orderstatus = 'P' THEN 'clarify' ELSE 'tool_call' END AS kind, o_orderpriority AS p FROM orders),
l AS (SELECT l_orderkey AS ord, count(*) AS n, sum(l_linenumber) AS a, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
s AS (SELECT d.ord, (1 + CASE WHEN kind IN ('refuse', 'clarify') THEN 2 ELSE 0 END + least(floor(coalesce(n, 0) / 2), 3) + CASE WHEN kind = 'tool_call' THEN greatest(coalesce(n, 0) - 1, 0) * 2 + least(coalesce(a, 0), 3) ELSE 0 END
  + CASE WHEN p LIKE '1%' THEN 2 ELSE 0 END + CASE WHEN p LIKE '2%' THEN 2 ELSE 0 END + CASE WHEN coalesce(r, false) THEN 1 ELSE 0 END + CASE WHEN p LIKE '5%' THEN 1 ELSE 0 END)::BIGINT AS difficulty FROM d LEFT JOIN l USING (ord)),
b AS (SELECT *, CASE WHEN difficulty <= 3 THEN 'easy' WHEN difficulty <= 6 THEN 'medium' ELSE 'hard' END AS band FROM s)
"""


def _difficulty(spark: SparkSession, d: str) -> DataFrame:
    """Orders as examples: status is the answer's type, lines are tools, calls and arguments, priority marks slices."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("a"), F.max(F.col("l_returnflag") == "R").alias("r"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", "refuse").when(F.col("o_orderstatus") == "P", "clarify").otherwise("tool_call").alias("kind"), F.col("o_orderpriority").alias("p")).join(lines, "ord", "left")
    n, a = F.coalesce("n", F.lit(0)), F.coalesce("a", F.lit(0))
    score = shaping.difficulty(F.col("kind"), n, n, a, F.startswith("p", F.lit("1")), F.startswith("p", F.lit("2")), F.coalesce("r", F.lit(False)), F.startswith("p", F.lit("5")))
    return rows.select("ord", score.alias("difficulty")).withColumn("band", shaping.band(F.col("difficulty")))


@query(f"WITH {_DIFF} SELECT ord, difficulty, band FROM b")
def difficulty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difficulty(spark, sf_dir)


@query(f"WITH {_DIFF} SELECT band, difficulty, count(*)::BIGINT AS n, round(avg(difficulty), 2) AS mean, min(difficulty) AS lo, max(difficulty) AS hi FROM b GROUP BY GROUPING SETS ((), (band), (difficulty))")
def difficulty_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _difficulty(spark, sf_dir).withColumn("v", F.col("difficulty"))
    return d.groupingSets([[], ["band"], ["difficulty"]], "band", "difficulty").agg(F.count("*").alias("n"), F.round(F.avg("v"), 2).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query(f"WITH {_DIFF} SELECT ord, difficulty, row_number() OVER (ORDER BY difficulty, ord) AS place FROM b")
def curriculum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable order from easy to hard."""
    d = ordered(_difficulty(spark, sf_dir).select("ord", "difficulty"), [], ["difficulty", "ord"], "place")
    return d.select("ord", "difficulty", (F.col("place") + 1).alias("place"))


_QUALITY = """
q AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, source, lang FROM documents),
t AS (SELECT p_type, list_distinct(regexp_extract_all(lower(p_type || ' the of and to'), '[a-z0-9]+')) AS tw FROM (SELECT DISTINCT p_type FROM part)),
n AS (SELECT row_number() OVER (ORDER BY p_type) - 1 AS k, p_type, tw, count(*) OVER () AS c FROM t),
x AS (SELECT q.doc_id, len(q.w) AS nw, q.source AS v, len(list_intersect(list_distinct(q.w), n.tw)) AS g, q.lang <> 'es' AS ok FROM q JOIN n ON q.doc_id % n.c = n.k),
s AS (SELECT doc_id, CASE WHEN ok THEN least(0.35::DOUBLE + CASE WHEN nw BETWEEN 4 AND 60 THEN 0.2::DOUBLE WHEN nw >= 3 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN lower(trim(v)) NOT IN ('src1', '') THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END
  + CASE WHEN g >= 2 THEN 0.2::DOUBLE WHEN g = 1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS score FROM x)
"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    """Documents as queries, each with one tool whose text it may share words with."""
    tools = table(spark, d, "part").select("p_type").distinct()
    numbered = ordered(tools, [], ["p_type"], "k").select((F.col("k") + 1).alias("k"), F.array_distinct(tokens(F.concat("p_type", F.lit(" the of and to")))).alias("tw"))
    n = numbered.count()
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("w"), "source", "lang").withColumn("k", F.col("doc_id") % n + 1)
    both = docs.join(similarity.small(numbered), "k")
    grounded = F.size(F.array_intersect("w", "tw"))
    real = shaping.real_value(F.nullif(F.col("source"), F.lit("src1")))
    return both.select("doc_id", shaping.quality(F.size("w"), F.lit(1), F.coalesce(real, F.lit(False)), grounded, F.col("lang") != "es").alias("score"))


@query(f"WITH {_QUALITY} SELECT doc_id, round(score, 6) AS score FROM s")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_QUALITY} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT (SELECT greatest(1, floor(count(*) * 0.3))::BIGINT FROM s)")
def quality_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _quality(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))
    return shaping.top_fraction(scored, 0.3, "score", "doc_id")


@query(
    """WITH p AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS have FROM lineitem GROUP BY 1)
SELECT l_orderkey AS order_key, list_has_all(have, ['N']) AND list_has_all(['N', 'A', 'R'], have) AND len(have) <= 2 AS valid, len(list_filter(['N', 'A'], lambda x: NOT list_contains(have, x)))::BIGINT AS missing FROM p"""
)
def required_arg_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set part of call validation: required keys present, no unknown keys."""
    have = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.collect_set("l_returnflag").alias("have"))
    arr = lambda *x: F.array(*map(F.lit, x))
    valid = (F.size(F.array_except(arr("N"), "have")) == 0) & (F.size(F.array_except("have", arr("N", "A", "R"))) == 0) & (F.size("have") <= 2)
    return have.select("order_key", valid.alias("valid"), F.size(F.array_except(arr("N", "A"), "have")).cast("long").alias("missing"))


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS calls, count(DISTINCT l_suppkey) AS tools FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_key, CASE WHEN o_orderpriority LIKE '5%' THEN 'agentic' WHEN o_orderpriority LIKE '4%' THEN 'multi_turn' WHEN o_orderstatus = 'F' THEN 'irrelevance' WHEN o_orderstatus = 'P' THEN 'clarify'
  WHEN coalesce(calls, 0) > 3 THEN 'parallel' WHEN coalesce(tools, 0) > 1 THEN 'multiple' ELSE 'simple' END AS category FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""
)
def category_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("calls"), F.countDistinct("l_suppkey").alias("tools"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(lines, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("order_key"), category(F.startswith("o_orderpriority", F.lit("5")), F.startswith("o_orderpriority", F.lit("4")), F.when(F.col("o_orderstatus") == "F", "refuse").when(F.col("o_orderstatus") == "P", "clarify").otherwise("tool_call"), F.coalesce("calls", F.lit(0)) > 3, F.coalesce("tools", F.lit(0)) > 1).alias("category"))


def category(agentic, history, kind, many_calls, many_tools):
    """Evaluation category of an example; the first that applies."""
    return F.when(agentic, "agentic").when(history, "multi_turn").when(kind == "refuse", "irrelevance").when(kind == "clarify", "clarify").when(many_calls, "parallel").when(many_tools, "multiple").otherwise("simple")

"""Chart questions over revenue by nation and month, specs, localisation and the scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chart_maker, chart_tables, charts
from ..operators.similarity import small
from . import query, table

_L = """
l AS (SELECT n.n_name AS chart, month(o.o_orderdate) - 1 AS pos, strftime(o.o_orderdate, '%m') AS category, round(sum(l.l_extendedprice::DECIMAL(18,2)), 1)::DOUBLE AS value
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY ALL),
a AS (SELECT chart, max(value) AS hi, min(value) AS lo, sum(value) AS total, avg(value) AS mean, count(*) AS n, regr_slope(value, pos) AS slope, corr(pos, value) AS r FROM l GROUP BY chart),
c AS (SELECT l.chart, count(*) FILTER (WHERE value = hi) AS n_hi, count(*) FILTER (WHERE value = lo) AS n_lo, count(*) FILTER (WHERE value > mean) AS above, arg_max(category, value) AS top, arg_min(category, value) AS bottom FROM l JOIN a USING (chart) GROUP BY l.chart),
f AS (SELECT a.*, c.above, CASE WHEN n_hi = 1 THEN top END AS top, CASE WHEN n_lo = 1 THEN bottom END AS bottom, CASE WHEN hi > lo THEN slope * (n - 1) / (hi - lo) ELSE 0 END AS change FROM a JOIN c USING (chart))
"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    """(chart, pos, category, value): monthly revenue of each nation, summed exactly on a grid of cents.

    Small tables join by broadcast when they are.
    """
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    who = cust.join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), "n_nationkey").select("o_custkey", "n_name")  # nations: 25 rows
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.month("o_orderdate").alias("m"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice")
    rows = lines.join(orders, "l_orderkey").join(small(who), "o_custkey")
    return rows.groupBy(F.col("n_name").alias("chart"), (F.col("m") - 1).alias("pos"), F.lpad(F.col("m").cast("string"), 2, "0").alias("category")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 1).cast("double").alias("value"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return charts.facts(_long(spark, d))


@query(f"WITH {_L} SELECT chart, category, value FROM l")
def chart_value_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).select("chart", "category", "value")


@query(f"WITH {_L} SELECT chart, top, hi AS value FROM f")
def chart_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest category; null on a tie."""
    return _facts(spark, sf_dir).select("chart", "top", F.col("hi").alias("value"))


@query(f"WITH {_L} SELECT chart, bottom, lo AS value FROM f")
def chart_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("chart", "bottom", F.col("lo").alias("value"))


@query(f"WITH {_L} SELECT x.chart, CASE WHEN x.value > y.value THEN 'Yes' ELSE 'No' END AS answer FROM l x JOIN l y ON x.chart = y.chart AND x.pos = 0 AND y.pos = 6")
def chart_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether January is above July."""
    at = lambda p: F.max(F.when(F.col("pos") == p, F.col("value")))
    both = _long(spark, sf_dir).groupBy("chart").agg(at(0).alias("x"), at(6).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return both.select("chart", F.when(F.col("x") > F.col("y"), "Yes").otherwise("No").alias("answer"))


@query(f"WITH {_L} SELECT chart, round(hi - lo, 1) AS difference FROM f")
def chart_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("chart", F.round("difference", 1).alias("difference"))


@query(f"WITH {_L} SELECT chart, round(total, 1) AS total FROM f")
def chart_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("chart", F.round("total", 1).alias("total"))


@query(f"WITH {_L} SELECT chart, round(mean, 3) AS mean FROM f")
def chart_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("chart", F.round("mean", 3).alias("mean"))


@query(f"WITH {_L} SELECT chart, above::BIGINT AS above, n::BIGINT AS n FROM f")
def chart_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories above the mean."""
    return _facts(spark, sf_dir).select("chart", "above", "n")


@query(f"WITH {_L} SELECT chart, CASE WHEN abs(change) <= 0.10 THEN 'none' WHEN change > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM f")
def chart_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("chart", "trend")


@query(f"WITH {_L} SELECT chart, round(100 * hi / total, 1) AS top_percent FROM f")
def chart_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("chart", F.round(100 * F.col("top_share"), 1).alias("top_percent"))


@query(f"WITH {_L} SELECT chart, CASE WHEN abs(r) < 0.3 THEN 'none' WHEN r > 0 THEN 'positive' ELSE 'negative' END AS correlation FROM f")
def chart_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("chart", "correlation")


@query(f"WITH {_L}, h AS (SELECT chart, sum(value) FILTER (WHERE pos < 6) AS x, sum(value) FILTER (WHERE pos >= 6) AS y FROM l GROUP BY chart) SELECT chart, CASE WHEN x > y THEN 'first half' ELSE 'second half' END AS larger, round(abs(x - y), 1) AS by FROM h")
def chart_compare_then_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda c: F.sum(F.when(c, F.col("value")))
    h = _long(spark, sf_dir).groupBy("chart").agg(half(F.col("pos") < 6).alias("x"), half(F.col("pos") >= 6).alias("y"))
    return h.select("chart", F.when(F.col("x") > F.col("y"), "first half").otherwise("second half").alias("larger"), F.round(F.abs(F.col("x") - F.col("y")), 1).alias("by"))


@query(f"WITH {_L} SELECT chart, CASE WHEN total = floor(total) THEN floor(total)::BIGINT::VARCHAR ELSE regexp_replace(printf('%.4f', total), '\\.?0+$', '') END AS answer FROM (SELECT chart, round(total, 1) AS total FROM f)")
def chart_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals as answer text."""
    return _facts(spark, sf_dir).select("chart", charts.answer_text(F.round("total", 1)).alias("answer"))


@query("SELECT r_name AS chart, n_name AS category, n_nationkey::BIGINT AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
def vega_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec as JSON text is built per region, parsed again, and its values are read back."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    values = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("category"), F.col("n_nationkey").cast("bigint").alias("value"))))
    spec = nation.groupBy("r_name").agg(values.alias("v")).select("r_name", F.to_json(F.struct(F.lit("bar").alias("mark"), F.struct(F.col("v").alias("values")).alias("data"))).alias("spec"))
    back = spec.select("r_name", F.explode_outer(F.from_json("spec", "mark string, data struct<values: array<struct<category:string,value:bigint>>>")["data"]["values"]).alias("x"))
    return back.select(F.col("r_name").alias("chart"), "x.category", "x.value")


_TR = {"AFRICA": "अफ़्रीका", "AMERICA": "अमेरिका", "ASIA": "एशिया", "EUROPE": "यूरोप"}


@query("WITH t(en, hi) AS (VALUES ('AFRICA', 'अफ़्रीका'), ('AMERICA', 'अमेरिका'), ('ASIA', 'एशिया'), ('EUROPE', 'यूरोप')), g(lang) AS (VALUES ('en'), ('hi')) SELECT r_regionkey::BIGINT AS pair_id, lang, CASE lang WHEN 'hi' THEN coalesce(hi, r_name) ELSE r_name END AS label FROM region LEFT JOIN t ON en = r_name, g")
def localized_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An English chart label and its translation share a pair id; a missing translation falls back to English."""
    words = spark.createDataFrame(list(_TR.items()), "r_name string, hi string")
    rows = table(spark, sf_dir, "region").join(F.broadcast(words), "r_name", "left").withColumn("lang", F.explode_outer(F.array(F.lit("en"), F.lit("hi"))))
    return rows.select(F.col("r_regionkey").cast("bigint").alias("pair_id"), "lang", F.when(F.col("lang") == "hi", F.coalesce("hi", "r_name")).otherwise(F.col("r_name")).alias("label"))


_SAID = """
s AS (SELECT o_orderkey, o_totalprice AS gold, o_orderkey % 5 AS k, CASE o_orderkey % 5 WHEN 0 THEN printf('%.2f', o_totalprice) WHEN 1 THEN printf('%.2f', o_totalprice * 1.04) WHEN 2 THEN printf('%.2f', o_totalprice * 1.07) WHEN 3 THEN printf('%.1fK', o_totalprice / 1000) ELSE 'unknown' END AS said FROM orders),
v AS (SELECT *, try_cast(regexp_replace(said, 'K$', '') AS DOUBLE) * CASE WHEN ends_with(said, 'K') THEN 1000 ELSE 1 END AS got FROM s)
"""


def _said(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.col("o_orderkey") % 5, F.col("o_totalprice")
    text = F.when(k == 0, F.format_string("%.2f", x)).when(k == 1, F.format_string("%.2f", x * 1.04)).when(k == 2, F.format_string("%.2f", x * 1.07)).when(k == 3, F.format_string("%.1fK", x / 1000)).otherwise("unknown")
    rows = table(spark, d, "orders").select("o_orderkey", x.alias("gold"), k.alias("k"), text.alias("said"))
    scale = F.when(F.endswith("said", F.lit("K")), 1000).otherwise(1)
    return rows.withColumn("got", F.regexp_replace("said", "K$", "").try_cast("double") * scale)


@query(f"WITH {_SAID} SELECT o_orderkey, coalesce(abs(got - gold) <= 0.05 * abs(gold), false) AS correct FROM v")
def relaxed_match_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric answers within 5 percent; the ASCII part of the scorer as expressions."""
    no = F.lit(False)
    return _said(spark, sf_dir).select("o_orderkey", charts.numbers_match(F.col("gold"), no, F.col("got"), no).alias("correct"))


@query(f"WITH {_SAID} SELECT o_orderkey, coalesce(abs(got - gold) <= 0.05 * abs(gold), false) AS correct FROM v")
def relaxed_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full scorer, as an Arrow function, on the same answers."""
    rows = _said(spark, sf_dir)
    return rows.select("o_orderkey", charts.relaxed(F.col("gold").cast("string"), "said", F.lit("")).alias("correct"))


@query(
    f"""WITH {_SAID}, r AS (SELECT CASE WHEN k IN (0, 1) THEN 'reasoning' ELSE 'descriptive' END AS kind, k, coalesce(abs(got - gold) <= 0.05 * abs(gold), false) AS ok, got IS NULL AS failed FROM v)
SELECT kind, k, count(*)::BIGINT AS n, round(avg(ok::INT), 6) AS accuracy, round(avg(failed::INT), 6) AS parse_failure FROM r GROUP BY GROUPING SETS ((), (kind), (k))"""
)
def chart_eval_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    rows = _said(spark, sf_dir).select(F.when(F.col("k").isin(0, 1), "reasoning").otherwise("descriptive").alias("kind"), "k", charts.numbers_match(F.col("gold"), no, F.col("got"), no).alias("ok"), F.col("got").isNull().alias("failed"))
    return rows.groupingSets([[], ["kind"], ["k"]], "kind", "k").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("failed").cast("int")), 6).alias("parse_failure"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')), n_chars::VARCHAR")
def chart_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each (normalised question, answer text); the whole text is hashed before it is shuffled."""
    from ..functions.text import collapsed

    key = F.sha2(collapsed(F.col("text")), 256)
    return table(spark, sf_dir, "documents").groupBy(key.alias("q"), F.col("n_chars").cast("string").alias("a")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_TYPES = "[" + ", ".join(f"'{t}'" for t in chart_maker.KINDS) + "]"
_FITS = ", ".join(f"('{t}', '{k}')" for t, ks in chart_maker.KINDS.items() for k in ks)
_TEXT = "CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE regexp_replace(printf('%.4f', {x}), '\\.?0+$', '') END"


def _text(x: str) -> str:
    return _TEXT.format(x=f"round({x}, 1)")


_QA = f"""
z AS (SELECT chart, arg_min(category, pos) AS c0, arg_min(value, pos) AS v0, arg_max(category, pos) AS c1, arg_max(value, pos) AS v1, arg_min(category, md5('cat|' || chart || '|' || category)) AS xc, arg_min(value, md5('cat|' || chart || '|' || category)) AS xv FROM l GROUP BY chart),
j AS (SELECT f.*, z.* EXCLUDE (chart) FROM f JOIN z USING (chart)),
q AS (SELECT chart, 'value_lookup' AS kind, 'What is the value of ' || xc || '?' AS question, {_text('xv')} AS answer FROM j
UNION ALL SELECT chart, 'max', 'Which category is the highest?', top FROM j UNION ALL SELECT chart, 'min', 'Which category is the lowest?', bottom FROM j
UNION ALL SELECT chart, 'compare', 'Is ' || c0 || ' above ' || c1 || '?', CASE WHEN v0 > v1 THEN 'Yes' ELSE 'No' END FROM j UNION ALL SELECT chart, 'sum', 'What do all add up to?', {_text('total')} FROM j
UNION ALL SELECT chart, 'count', 'How many are above the mean?', above::VARCHAR FROM j UNION ALL SELECT chart, 'difference', 'How far apart are ' || c0 || ' and ' || c1 || '?', {_text('abs(v0 - v1)')} FROM j
UNION ALL SELECT chart, 'mean', 'What is the mean?', {_text('mean')} FROM j UNION ALL SELECT chart, 'compare_then_compute', 'By how much does the highest exceed the lowest?', {_text('(hi - lo)')} FROM j
UNION ALL SELECT chart, 'trend', 'Is it increasing or decreasing?', CASE WHEN abs(change) <= 0.10 THEN NULL WHEN change > 0 THEN 'increasing' ELSE 'decreasing' END FROM j
UNION ALL SELECT chart, 'proportion', 'What share has the largest part?', {_text('100 * (hi / total)')} || '%' FROM j
UNION ALL SELECT chart, 'correlation', 'Is the correlation positive or negative?', CASE WHEN abs(r) < 0.3 THEN NULL WHEN r > 0 THEN 'positive' ELSE 'negative' END FROM j)
"""


@query(
    f"""WITH {_L}, {_QA}, t AS (SELECT *, ({_TYPES})[('0x' || substr(md5('type|' || chart), 1, 8))::BIGINT % {len(chart_maker.KINDS)} + 1] AS type FROM q WHERE answer IS NOT NULL)
SELECT chart, type, kind, question, answer FROM t WHERE (type, kind) IN (VALUES {_FITS}) QUALIFY row_number() OVER (PARTITION BY chart ORDER BY ('0x' || substr(md5('ask|' || chart || '|' || kind), 1, 8))::BIGINT, kind) <= 2"""
)
def chart_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions a chart at most, of the kinds that suit its drawn type."""
    return chart_maker.questions(_long(spark, sf_dir))


@query(f"WITH {_L}, {_QA} SELECT chart, kind, question, answer FROM q WHERE kind IN ('value_lookup', 'max', 'min', 'compare', 'compare_then_compute') AND answer IS NOT NULL")
def vega_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of questions, answered from the JSON text of specifications alone."""
    return chart_maker.spec_questions(chart_maker.specs(_long(spark, sf_dir)))


_KINDS = """
k AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_orderpriority AS p, 10 + o_orderkey % 90 AS n FROM orders)
SELECT o_orderkey, k IN (0, 2, 4, 6, 7, 8) AS correct, k = 8 AS strict, k <> 9 AS parsed_ok FROM k
"""


@query("WITH " + _KINDS.strip())
def scorer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in any order, trends by direction, ranges, shares, yes and no, and texts: what counts, and what is the same text."""
    k, n, p = F.col("o_orderkey") % 10, (10 + F.col("o_orderkey") % 90), F.col("o_orderpriority")
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    number = lambda c: c.cast("string")
    gold = (
        F.when(k.isin(0, 1), text('["', p, '", ', number(n), ', "west"]')).when(k == 2, '"increasing"').when(k == 3, '"decreasing"').when(k.isin(4, 5), text('"', number(n), "-", number(2 * n), '"'))
        .when(k == 6, number(n)).when(k == 7, F.lit("true")).otherwise(text('"', p, '"'))
    )
    said = (
        F.when(k == 0, text("West; ", number(n), ", ", F.lower(p))).when(k == 1, text("west, ", number(n))).when(k == 2, "it was rising until May").when(k == 3, "बढ़ता").when(k == 4, text(number(2 * n), " to ", number(n)))
        .when(k == 5, text(number(n), " to ", number(3 * n))).when(k == 6, text(number(n), "%")).when(k == 7, "Yes.").when(k == 8, text(" ", F.lower(p))).otherwise("  ")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", charts.verdicts(gold, said, F.when(k.isin(2, 3), "trend").when(k == 6, "proportion").otherwise("")).alias("v"))
    return rows.select("o_orderkey", "v.correct", "v.strict", "v.parsed_ok")


_D = lambda seed, *parts: f"('0x' || substr(md5('{seed}|' || " + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"
_TYPES = "[" + ", ".join(f"'{t}'" for t in chart_maker.KINDS) + "]"
_KINDS = "CASE type " + " ".join(f"WHEN '{t}' THEN [" + ", ".join(f"'{k}'" for k in kinds) + "]" for t, kinds in chart_maker.KINDS.items()) + " END"
_THEME = lambda i: "CASE theme " + " ".join(f"WHEN {k} THEN " + (str(list(t[i])) if isinstance(t[i], tuple) else repr(t[i])) for k, t in enumerate(chart_tables.THEMES)) + " END"
_CHARTS = f"""
g0 AS (SELECT c_custkey AS chart, ({_TYPES})[{_D('type', 'c_custkey')} % 9 + 1] AS type FROM customer),
g1 AS (SELECT *, CASE WHEN type IN ('line', 'multiline', 'area') THEN 0 ELSE {_D('theme', 'chart')} % 3 + 1 END AS theme, CASE WHEN type = 'scatter' THEN {_D('points', 'chart')} % 7 + 8 ELSE {_D('cats', 'chart')} % 3 + 4 END AS nc,
  CASE WHEN type IN ('grouped_bar', 'stacked_bar', 'multiline') THEN {_D('series', 'chart')} % 2 + 2 ELSE 1 END AS ns FROM g0),
g2 AS (SELECT *, CASE WHEN type = 'scatter' THEN list_transform(range(nc), lambda i: i * 7 + {_D('x', 'chart', 'i')} % 7) END AS xs FROM g1),
g AS (SELECT chart, type, {_THEME(1)} AS x, {_THEME(2)} AS y, CASE WHEN type = 'scatter' THEN 0 ELSE {_THEME(3)} END AS dec, nc, ns, xs, ['North', 'South', 'East'][1:ns] AS names,
  CASE WHEN type = 'scatter' THEN list_transform(range(nc), lambda i: (i + 1)::VARCHAR) ELSE ({_THEME(4)})[1:nc] END AS cats,
  CASE WHEN type = 'scatter' THEN [list_transform(range(nc), lambda i: 120 + ({_D('sign', 'chart')} % 2 * 2 - 1) * xs[i + 1] + {_D('y', 'chart', 'i')} % 31 - 15)]
    ELSE list_transform(range(ns), lambda s: list_transform(range(nc), lambda c: ({_D('value', 'chart', 's', 'c')} % 90 + 10) * 10 + c)) END AS q FROM g2)
"""


def _charts(spark: SparkSession, d: str) -> DataFrame:
    """A drawn chart for each customer."""
    return chart_tables.tables(table(spark, d, "customer").select(F.col("c_custkey").alias("chart")))


@query(
    f"""WITH {_CHARTS}, r AS (SELECT chart, type, names, cats, xs, unnest(q) AS row, generate_subscripts(q, 1) AS s FROM g), v AS (SELECT *, unnest(row) AS quanta, generate_subscripts(row, 1) AS p FROM r)
SELECT chart, type, names[s] AS series, (p - 1)::INT AS pos, cats[p] AS category, quanta, xs[p] AS x FROM v"""
)
def chart_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of nine types, one row a value, in whole quanta."""
    return chart_tables.long(_charts(spark, sf_dir))


_N = lambda v, dec="dec": f"CASE WHEN {dec} = 0 THEN ({v})::BIGINT::VARCHAR WHEN ({v}) % 10 = 0 THEN (({v}) // 10)::BIGINT::VARCHAR ELSE (({v}) // 10)::BIGINT || '.' || (({v}) % 10)::BIGINT END"


@query(
    f"""WITH {_CHARTS},
h0 AS (SELECT *, type = 'stacked_bar' AS st, CASE WHEN type = 'stacked_bar' THEN 0 ELSE {_D('of_series', 'chart')} % ns END + 1 AS s, {_D('of_category', 'chart')} % nc AS c1 FROM g),
h1 AS (SELECT *, (c1 + 1 + {_D('beside', 'chart')} % (nc - 1)) % nc AS c2, q[s] AS r, list_transform(range(nc), lambda c: list_sum(list_transform(q, lambda z: z[c + 1]))::BIGINT) AS tot FROM h0),
h2 AS (SELECT *, CASE WHEN st THEN tot ELSE r END AS tall, list_sort(r) AS k, r[c1 + 1] AS a, r[c2 + 1] AS b, cats[c1 + 1] AS one, cats[c2 + 1] AS two, list_sum(r)::BIGINT AS sy,
  CASE WHEN ns > 1 AND NOT st THEN ' of ' || names[s] WHEN st THEN ' of all together' ELSE '' END AS o, CASE WHEN ns > 1 THEN ' of ' || names[s] ELSE '' END AS bo FROM h1),
h3 AS (SELECT *, list_max(tall) AS top, list_min(tall) AS low, list_sum(tall)::BIGINT AS every, list_filter(range(1, nc), lambda i: k[i + 1] - k[i] >= 2) AS gaps,
  list_sum(list_transform(range(nc), lambda i: (2 * i - (nc - 1)) * r[i + 1]))::BIGINT AS slope, list_sum(list_transform(range(nc), lambda i: (2 * i - (nc - 1)) ** 2))::BIGINT AS sq, list_max(r) - list_min(r) AS span,
  (nc * list_sum(list_transform(range(nc), lambda i: xs[i + 1] * r[i + 1])) - list_sum(xs) * list_sum(r))::BIGINT AS tg,
  ((nc * list_sum(list_transform(xs, lambda v: v * v)) - list_sum(xs) * list_sum(xs)) * (nc * list_sum(list_transform(r, lambda v: v * v)) - list_sum(r) * list_sum(r)))::BIGINT AS sp FROM h2),
h4 AS (SELECT *, gaps[{_D('gap', 'chart')} % greatest(len(gaps), 1) + 1] AS gp, len(list_filter(tall, lambda v: v = top)) = 1 AS ot, len(list_filter(tall, lambda v: v = low)) = 1 AS ol FROM h3),
h5 AS (SELECT *, k[gp] + (k[gp + 1] - k[gp]) // 2 AS bar FROM h4),
qa AS (SELECT chart, type, unnest([
  {{'kind': 'value_lookup', 'question': 'What is the ' || y || bo || ' for ' || one || '?', 'answer': {_N('a')}}},
  {{'kind': 'max', 'question': 'Which ' || x || ' has the highest ' || y || o || '?', 'answer': CASE WHEN ot THEN cats[list_position(tall, top)] END}},
  {{'kind': 'min', 'question': 'Which ' || x || ' has the lowest ' || y || o || '?', 'answer': CASE WHEN ol THEN cats[list_position(tall, low)] END}},
  {{'kind': 'compare', 'question': 'Is the ' || y || bo || ' for ' || one || ' above that for ' || two || '?', 'answer': CASE WHEN a > b THEN 'Yes' ELSE 'No' END}},
  {{'kind': 'difference', 'question': 'By how much do ' || one || ' and ' || two || ' differ in ' || y || bo || '?', 'answer': {_N('abs(a - b)')}}},
  {{'kind': 'sum', 'question': CASE WHEN st THEN 'What is the ' || y || ' of all together for ' || one || '?' ELSE 'What is the total ' || y || '?' END, 'answer': {_N('CASE WHEN st THEN tot[c1 + 1] ELSE sy END')}}},
  {{'kind': 'mean', 'question': 'What is the mean ' || y || o || ' of a ' || x || '?', 'answer': {_N('(2 * every + nc) // (2 * nc)')}}},
  {{'kind': 'count', 'question': 'In how many places (' || x || ') is the ' || y || bo || ' above ' || {_N('bar')} || '?', 'answer': CASE WHEN bar IS NOT NULL THEN len(list_filter(r, lambda v: v > bar))::VARCHAR END}},
  {{'kind': 'compare_then_compute', 'question': 'By how much does the highest ' || y || o || ' exceed the lowest?', 'answer': CASE WHEN ot AND ol THEN {_N('top - low')} END}},
  {{'kind': 'trend', 'question': 'Does the ' || y || bo || ' increase or decrease?', 'answer': CASE WHEN 10 * abs(2 * slope) * (nc - 1) > sq * span THEN CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END END}},
  {{'kind': 'proportion', 'question': 'What percentage of the total is ' || one || '?', 'answer': {_N('(2000 * a + sy) // (2 * sy)', '1')}}},
  {{'kind': 'correlation', 'question': 'Is the correlation of both axes positive or negative?', 'answer': CASE WHEN sp > 0 AND 100 * tg * tg >= 9 * sp THEN CASE WHEN tg > 0 THEN 'positive' ELSE 'negative' END END}}]) AS z, {_KINDS} AS fits FROM h5)
SELECT chart, type, z.kind AS kind, z.question AS question, z.answer AS answer FROM qa WHERE list_contains(fits, z.kind) AND z.answer IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY chart ORDER BY {_D('ask', 'chart', 'z.kind')}, z.kind) <= 2"""
)
def chart_table_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two questions a drawn chart, of kinds that suit its type, with answers that leave no doubt."""
    return chart_tables.questions(_charts(spark, sf_dir))

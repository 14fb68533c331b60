"""Questions about charts: of the kinds that suit a chart's type and have an answer, a few drawn ones each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import draw
from . import charts

#: Chart types, and the kinds of questions that can be read off each.
KINDS = {
    "bar": ("value_lookup", "max", "min", "compare", "sum", "count", "difference", "mean", "compare_then_compute"), "hbar": ("value_lookup", "max", "min", "compare", "difference", "mean", "compare_then_compute"),
    "grouped_bar": ("value_lookup", "max", "min", "compare"), "stacked_bar": ("max", "min", "sum", "mean", "value_lookup", "compare_then_compute"), "line": ("trend", "value_lookup", "max", "mean"),
    "multiline": ("value_lookup", "max", "compare"), "area": ("trend", "max"), "pie": ("proportion", "compare"), "scatter": ("correlation",),
}
#: Kinds of questions about a specification.
SPEC_KINDS = ("value_lookup", "max", "min", "compare", "compare_then_compute")
PER_CHART = 2


def type_of(chart: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (draw("type", chart) % len(KINDS) + 1).cast("int"))


def answers(long: DataFrame) -> DataFrame:
    """(chart, type, qa): every kind's question and answer for charts (chart, pos, category, value); null answers where a kind has none."""
    asked = F.md5(F.concat_ws("|", F.lit("cat"), "chart", "category"))
    ends = long.groupBy("chart").agg(F.min_by("category", "pos").alias("c0"), F.min_by("value", "pos").alias("v0"), F.max_by("category", "pos").alias("c1"), F.max_by("value", "pos").alias("v1"), F.min_by(F.struct("category", "value"), asked).alias("x"))
    f = charts.facts(long).join(ends, "chart")
    number = lambda c: charts.answer_text(F.round(c, 1))
    made = {
        "value_lookup": (F.concat(F.lit("What is the value of "), F.col("x.category"), F.lit("?")), number(F.col("x.value"))), "max": (F.lit("Which category is the highest?"), F.col("top")), "min": (F.lit("Which category is the lowest?"), F.col("bottom")),
        "compare": (F.concat(F.lit("Is "), "c0", F.lit(" above "), "c1", F.lit("?")), F.when(F.col("v0") > F.col("v1"), "Yes").otherwise("No")), "sum": (F.lit("What do all add up to?"), number(F.col("total"))), "count": (F.lit("How many are above the mean?"), F.col("above").cast("string")),
        "difference": (F.concat(F.lit("How far apart are "), "c0", F.lit(" and "), "c1", F.lit("?")), number(F.abs(F.col("v0") - F.col("v1")))), "mean": (F.lit("What is the mean?"), number(F.col("mean"))), "compare_then_compute": (F.lit("By how much does the highest exceed the lowest?"), number(F.col("difference"))),
        "trend": (F.lit("Is it increasing or decreasing?"), F.nullif(F.col("trend"), F.lit("none"))), "proportion": (F.lit("What share has the largest part?"), F.concat(number(100 * F.col("top_share")), F.lit("%"))), "correlation": (F.lit("Is the correlation positive or negative?"), F.nullif(F.col("correlation"), F.lit("none"))),
    }
    qa = F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("question"), a.cast("string").alias("answer")) for k, (q, a) in made.items()])
    return f.select("chart", type_of(F.col("chart")).alias("type"), qa.alias("qa"))


def questions(long: DataFrame, per_chart: int = PER_CHART) -> DataFrame:
    """(chart, type, kind, question, answer): the first ``per_chart`` by a draw of those that suit the type and have an answer."""
    rows = answers(long)
    kinds = F.create_map(*[x for t, k in KINDS.items() for x in (F.lit(t), F.array(*map(F.lit, k)))])
    fit = F.filter("qa", lambda x: F.array_contains(F.col("_kinds"), x["kind"]) & x["answer"].isNotNull())
    turned = F.array_sort(F.transform(fit, lambda x: F.struct(draw("ask", F.col("chart"), x["kind"]).alias("d"), x["kind"].alias("kind"), x["question"].alias("question"), x["answer"].alias("answer"))))
    each = rows.withColumn("_kinds", F.element_at(kinds, F.col("type"))).withColumn("_x", F.explode_outer(F.slice(turned, 1, per_chart))).where("_x IS NOT NULL")
    return each.select("chart", "type", "_x.kind", "_x.question", "_x.answer")


def specs(long: DataFrame) -> DataFrame:
    """(chart, spec): a chart as the JSON text of a bar specification with its values."""
    values = F.array_sort(F.collect_list(F.struct("pos", "category", "value")))
    field = lambda name, kind: F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"))
    body = F.struct(F.lit("bar").alias("mark"), F.struct(F.col("v").alias("values")).alias("data"), F.struct(field("category", "nominal").alias("x"), field("value", "quantitative").alias("y")).alias("encoding"))
    return long.groupBy("chart").agg(values.alias("v")).select("chart", F.to_json(body).alias("spec"))


def spec_questions(made: DataFrame) -> DataFrame:
    """(chart, kind, question, answer) for every kind that a specification's own values answer."""
    values = F.from_json("spec", "data struct<values: array<struct<pos:int,category:string,value:double>>>")["data"]["values"]
    long = made.select("chart", F.explode_outer(values).alias("x")).where("x IS NOT NULL").select("chart", "x.pos", "x.category", "x.value")
    return answers(long).select("chart", F.explode_outer("qa").alias("x")).where(F.col("x.kind").isin(*SPEC_KINDS) & F.col("x.answer").isNotNull()).select("chart", "x.kind", "x.question", "x.answer")

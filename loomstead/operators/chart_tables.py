"""Charts of nine types from counter draws, and questions whose answers are right by construction.

Values are whole quanta (tenths or units), and the last digit of one is its category's number, so no two of a series are equal
and every answer is integer arithmetic. A chart is one row with its values as small arrays; a question that a chart can't
be asked without doubt (a tie of totals, a flat trend, a weak correlation, no gap for a threshold) has no answer and is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import draw
from .chart_maker import KINDS, PER_CHART, type_of

#: Title, what stands on the axes, decimals, categories; the first is in order of time.
THEMES = (
    ("Orders by month", "month", "number of orders", 0, ("Jan", "Feb", "Mar", "Apr", "May", "Jun")), ("Visitors by park", "park", "number of visitors", 0, ("Elm", "Lake", "Hill", "Rose", "Mill", "Oak")),
    ("Rain by town", "town", "rainfall", 1, ("Avon", "Bree", "Cray", "Dunn", "Esk", "Fenn")), ("Price by grain", "grain", "price", 1, ("barley", "maize", "millet", "oats", "rye", "wheat")),
)
SERIES = ("North", "South", "East")
IN_TIME, MANY = ("line", "multiline", "area"), ("grouped_bar", "stacked_bar", "multiline")
#: A trend is told from this share of the span on, in tenths; a correlation from this square of r on, in hundredths.
LEAST_TREND, LEAST_SQUARE = 1, 9
#: Parts a core that charts are dealt to.
PARTS = 4


def _upto(n: Column, make: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), make)


def tables(ids: DataFrame) -> DataFrame:
    """(chart, type, title, x, y, dec, cats, names, q, xs) for each of ``ids`` (chart): quanta by series and category; xs of a scatter."""
    chart, kind = F.col("chart"), F.col("type")
    pick = lambda i: F.coalesce(*[F.when(F.col("theme") == k, F.lit(t[i]) if not isinstance(t[i], tuple) else F.array(*map(F.lit, t[i]))) for k, t in enumerate(THEMES)])
    # Ids are a few bytes a chart and lie in one small file; a chart is a lot of work, which all cores share.
    ids = ids.select("chart").repartition(PARTS * ids.sparkSession.sparkContext.defaultParallelism)
    rows = ids.select("chart", type_of(chart).alias("type"))
    rows = rows.withColumn("theme", F.when(kind.isin(*IN_TIME), 0).otherwise(draw("theme", chart) % 3 + 1))
    rows = rows.withColumn("nc", F.when(kind == "scatter", draw("points", chart) % 7 + 8).otherwise(draw("cats", chart) % 3 + 4)).withColumn("ns", F.when(kind.isin(*MANY), draw("series", chart) % 2 + 2).otherwise(1).cast("long"))
    rows = rows.withColumn("xs", F.when(kind == "scatter", _upto(F.col("nc"), lambda i: i * 7 + draw("x", chart, i) % 7)))
    rising = draw("sign", chart) % 2 * 2 - 1
    cloud = F.array(_upto(F.col("nc"), lambda i: 120 + rising * F.get("xs", i.cast("int")) + draw("y", chart, i) % 31 - 15))
    grid = _upto(F.col("ns"), lambda s: _upto(F.col("nc"), lambda c: (draw("value", chart, s, c) % 90 + 10) * 10 + c))
    cats = F.when(kind == "scatter", _upto(F.col("nc"), lambda i: (i + 1).cast("string"))).otherwise(F.slice(pick(4), F.lit(1), F.col("nc").cast("int")))
    dec = F.when(kind == "scatter", 0).otherwise(pick(3))
    return rows.select("chart", "type", pick(0).alias("title"), pick(1).alias("x"), pick(2).alias("y"), dec.alias("dec"), cats.alias("cats"), F.slice(F.array(*map(F.lit, SERIES)), F.lit(1), F.col("ns").cast("int")).alias("names"), F.when(kind == "scatter", cloud).otherwise(grid).alias("q"), "xs")


def long(made: DataFrame) -> DataFrame:
    """(chart, type, series, pos, category, quanta, x): one row a value; x of a scatter."""
    rows = made.select("chart", "type", "names", "cats", "xs", F.posexplode("q").alias("s", "row"))
    return rows.select("chart", "type", F.get("names", F.col("s")).alias("series"), "cats", "xs", F.posexplode("row").alias("pos", "quanta")).select("chart", "type", "series", "pos", F.get("cats", F.col("pos")).alias("category"), "quanta", F.get("xs", F.col("pos")).alias("x"))


def shown(quanta: Column, dec: Column) -> Column:
    """Quanta as a number's text, without a needless zero; they are never negative."""
    tenths = F.concat(F.floor(quanta / 10).cast("string"), F.lit("."), (quanta % 10).cast("string"))
    return F.when(dec == 0, quanta.cast("string")).when(quanta % 10 == 0, F.floor(quanta / 10).cast("string")).otherwise(tenths)


def _sum(values: Column, term: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + term(v))


def asked(made: DataFrame) -> DataFrame:
    """``made`` with ``qa``: kind, question and answer of every kind, the answer null where there is none."""
    chart, kind, dec = F.col("chart"), F.col("type"), F.col("dec")
    nc, ns = F.size("cats").cast("long"), F.size("q").cast("long")
    stacked = kind == "stacked_bar"
    s = F.when(stacked, 0).otherwise(draw("of_series", chart) % ns).cast("int")
    c1 = draw("of_category", chart) % nc
    c2 = (c1 + 1 + draw("beside", chart) % (nc - 1)) % nc
    rows = made.withColumns({"_s": s, "_1": c1.cast("int"), "_2": c2.cast("int")})
    rows = rows.withColumn("_row", F.get("q", F.col("_s"))).withColumn("_total", _upto(nc, lambda c: _sum("q", lambda r: F.get(r, c.cast("int")))))
    rows = rows.withColumn("_tall", F.when(stacked, F.col("_total")).otherwise(F.col("_row")))
    a, b = F.get("_row", F.col("_1")), F.get("_row", F.col("_2"))
    one, two = F.get("cats", F.col("_1")), F.get("cats", F.col("_2"))
    # What several answers or a lambda need is a column of its own, computed once a chart: written out inside a lambda it
    # would be computed again for every element, and sorts within sorts.
    rows = rows.withColumns({"_top": F.array_max("_tall"), "_low": F.array_min("_tall"), "_ranked": F.array_sort("_row")})
    tall, top, low, ranked = F.col("_tall"), F.col("_top"), F.col("_low"), F.col("_ranked")
    rows = rows.withColumn("_gaps", F.filter(_upto(nc - 1, lambda i: i), lambda i: F.get(ranked, (i + 1).cast("int")) - F.get(ranked, i.cast("int")) >= 2))
    rows = rows.withColumn("_gap", F.get("_gaps", (draw("gap", chart) % F.greatest(F.size("_gaps"), F.lit(1))).cast("int")))
    floor_, ceil_ = F.get(ranked, F.col("_gap").cast("int")), F.get(ranked, (F.col("_gap") + 1).cast("int"))
    rows = rows.withColumn("_bar", floor_ + F.floor((ceil_ - floor_) / 2))
    bar = F.col("_bar")
    only = lambda v: F.size(F.filter(tall, lambda x: x == v)) == 1
    at = lambda v: F.get("cats", (F.array_position(tall, v) - 1).cast("int"))
    of = F.when((ns > 1) & ~stacked, F.concat(F.lit(" of "), F.get("names", F.col("_s")))).when(stacked, F.lit(" of all together")).otherwise("")
    bottom = F.when(ns > 1, F.concat(F.lit(" of "), F.get("names", F.col("_s")))).otherwise("")
    x, y = F.col("x"), F.col("y")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    total = F.when(stacked, F.get("_total", F.col("_1"))).otherwise(_sum("_row"))
    every = _sum("_tall")
    z = lambda i: 2 * i - (nc - 1)
    slope, square = _sum(_upto(nc, lambda i: z(i) * F.get("_row", i.cast("int")))), _sum(_upto(nc, lambda i: z(i) * z(i)))
    span = F.array_max("_row") - F.array_min("_row")
    steep = 10 * F.abs(2 * slope) * (nc - 1) > LEAST_TREND * square * span
    sx, sy = _sum("xs"), _sum("_row")
    together = nc * _sum(_upto(nc, lambda i: F.get("xs", i.cast("int")) * F.get("_row", i.cast("int")))) - sx * sy
    spread = (nc * _sum("xs", lambda v: v * v) - sx * sx) * (nc * _sum("_row", lambda v: v * v) - sy * sy)
    strong = (spread > 0) & (100 * together * together >= LEAST_SQUARE * spread)
    tenths = F.floor((2000 * a + sy) / (2 * sy))
    found = {
        "value_lookup": (text("What is the ", y, bottom, " for ", one, "?"), shown(a, dec)),
        "max": (text("Which ", x, " has the highest ", y, of, "?"), F.when(only(top), at(top))), "min": (text("Which ", x, " has the lowest ", y, of, "?"), F.when(only(low), at(low))),
        "compare": (text("Is the ", y, bottom, " for ", one, " above that for ", two, "?"), F.when(a > b, "Yes").otherwise("No")),
        "difference": (text("By how much do ", one, " and ", two, " differ in ", y, bottom, "?"), shown(F.abs(a - b), dec)),
        "sum": (F.when(stacked, text("What is the ", y, " of all together for ", one, "?")).otherwise(text("What is the total ", y, "?")), shown(total, dec)),
        "mean": (text("What is the mean ", y, of, " of a ", x, "?"), shown(F.floor((2 * every + nc) / (2 * nc)), dec)),
        "count": (text("In how many places (", x, ") is the ", y, bottom, " above ", shown(bar, dec), "?"), F.when(bar.isNotNull(), F.size(F.filter("_row", lambda v: v > bar)).cast("string"))),
        "compare_then_compute": (text("By how much does the highest ", y, of, " exceed the lowest?"), F.when(only(top) & only(low), shown(top - low, dec))),
        "trend": (text("Does the ", y, bottom, " increase or decrease?"), F.when(steep, F.when(slope > 0, "increasing").otherwise("decreasing"))),
        "proportion": (text("What percentage of the total is ", one, "?"), shown(tenths, F.lit(1))),
        "correlation": (F.lit("Is the correlation of both axes positive or negative?"), F.when(strong, F.when(together > 0, "positive").otherwise("negative"))),
    }
    suits = lambda k: kind.isin(*[t for t, kinds in KINDS.items() if k in kinds])
    qa = F.array(*[F.when(suits(k), F.struct(F.lit(k).alias("kind"), q.alias("question"), v.cast("string").alias("answer"))) for k, (q, v) in found.items()])
    return rows.withColumn("qa", F.array_compact(qa)).select(*made.columns, "qa")


def questions(made: DataFrame, most: int = PER_CHART) -> DataFrame:
    """(chart, type, kind, question, answer): up to ``most`` by a draw of the kinds that suit a chart and have an answer."""
    able = F.filter("qa", lambda q: q["answer"].isNotNull())
    turned = F.array_sort(F.transform(able, lambda q: F.struct(draw("ask", F.col("chart"), q["kind"]).alias("d"), q["kind"].alias("kind"), q["question"].alias("question"), q["answer"].alias("answer"))))
    each = asked(made).withColumn("_x", F.explode_outer(F.slice(turned, 1, most))).where("_x IS NOT NULL")
    return each.select("chart", "type", "_x.kind", "_x.question", "_x.answer")

"""Examples made from examples and tool pools, with answers that are right by construction.

Every row is made by itself from its id and counter draws, so tasks need nothing of each other and reruns agree.
A pool is numbered once; a row names the numbers it draws, meets those tools in an equi-join, and chooses among them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import draw, kept
from ..sources.scratch import Scratch
from . import examples as ex
from .ordering import ordered
from .similarity import BROADCAST_ROWS, small

#: Tools that a row draws from the pool before it chooses the least similar ones.
CANDIDATES = 8
#: Attempts for every row that a driver of several kinds is asked for.
ATTEMPTS = 4
HEDGES = ("I might be wrong, but ", "If that is possible at all, ", "Not sure you have something for this, still ")
VERBS = ("handle", "look after", "settle")
#: Requests that tools hardly ever cover.
OFF_DOMAIN = ("Compose a haiku about snowfall.", "Do machines dream at night?", "Which novel moved you most?", "Invent a bedtime story with dragons.", "Who wins the next election?", "Suggest a filling for dumplings.")
#: Properties that a schema may come to need, and sets of options by property name.
NEW_PROPERTIES = ("confirmation_token", "api_version", "region", "account_id")
OPTIONS = {"priority": ("low", "medium", "high"), "status": ("open", "closed", "pending"), "unit": ("celsius", "fahrenheit"), "mode": ("fast", "accurate")}
NOT_AN_OPTION = "urgent-ASAP"


def pool_of(rows: DataFrame) -> DataFrame:
    """(k, tool): the distinct tools of examples, numbered by name; of several with one name, that of the least ex_id."""
    each = rows.select("ex_id", F.posexplode_outer("tools").alias("pos", "tool")).where("tool.name IS NOT NULL")
    first = each.groupBy(F.col("tool.name").alias("name")).agg(F.min_by("tool", F.struct("ex_id", "pos")).alias("tool"))
    return ordered(first, [], ["name"], "k").select("k", "tool")


def with_drawn(rows: DataFrame, pool: DataFrame, picks: list[Column], name: str) -> DataFrame:
    """``rows`` with the tools of the numbers ``picks`` (nulls pick none), in that order, the first of each name; rows without any are gone.

    A small pool comes to the rows, once a pick, and no row travels; rows go to a large one and meet again by ex_id.
    """
    if pool.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        wanted = rows.select("ex_id", F.posexplode_outer(F.array(*picks)).alias("_pos", "k"))
        met = wanted.join(pool, "k").groupBy("ex_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "tool"))).alias("_t"))
        return rows.join(met, "ex_id").withColumn(name, ex.first_of_names(F.transform("_t", lambda x: x["tool"]))).drop("_t")
    met = rows.where("ex_id IS NOT NULL").withColumns({f"_k{i}": k.cast("long") for i, k in enumerate(picks)})
    for i in range(len(picks)):
        met = met.join(F.broadcast(pool.select(F.col("k").cast("long").alias(f"_k{i}"), F.col("tool").alias(f"_t{i}"))), f"_k{i}", "left")
    found = met.select(*rows.columns, F.array_compact(F.array(*[f"_t{i}" for i in range(len(picks))])).alias("_t")).where(F.size("_t") > 0)
    return found.withColumn(name, ex.first_of_names(F.col("_t"))).drop("_t")


def _numbers(seed: str, n: int, many: int) -> list[Column]:
    return [draw(seed, F.col("ex_id"), i) % n for i in range(many)]


def _one(seed: str, choices: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (draw(seed, F.col("ex_id")) % len(choices) + 1).cast("int"))


def _made(rows: DataFrame, tools: Column, query: Column, kind: Column | str, calls: Column | None, content: Column | None, history: Column | None = None, **meta: Column | str) -> DataFrame:
    calls = F.array().cast(f"array<{ex.CALL}>") if calls is None else calls
    answer = F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), calls.alias("calls"), (F.lit("") if content is None else content).alias("content")).cast(ex.ANSWER)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).cast("string").alias("value")) for k, v in meta.items()])
    turns = F.lit(None) if history is None else history
    return rows.select("ex_id", tools.cast(f"array<{ex.TOOL}>").alias("tools"), query.alias("query"), answer.alias("answer"), turns.cast(ex.TURNS).alias("history"), F.map_from_entries(entries).alias("meta"))


def _turns(*turns: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns])


def refusal(tools: Column) -> Column:
    """A refusal that names what is on offer."""
    return F.concat(F.lit("No tool on offer fits this request; I have "), F.array_join(F.transform(tools, lambda t: F.concat(F.lit("`"), t["name"], F.lit("`"))), ", "), F.lit("."))


def _plain(tool: Column) -> Column:
    """What a tool does, as part of a sentence."""
    return F.rtrim(F.coalesce(F.nullif(tool["description"], F.lit("")), tool["name"]), F.lit("."))


def value_of(prop: Column, seed: Column) -> Column:
    """A value that fits a property, as JSON text."""
    number = F.element_at(F.array(*map(F.lit, ("1", "3", "7", "12", "30"))), (F.pmod(seed, F.lit(5)) + 1).cast("int"))
    option = F.element_at(prop["options"], (F.pmod(seed, F.greatest(F.size(prop["options"]), F.lit(1))) + 1).cast("int"))
    return (
        F.when(F.size(prop["options"]) > 0, ex.quoted(option)).when(prop["type"].isin("integer", "number"), number).when(prop["type"] == "boolean", F.lit("true"))
        .when(prop["type"] == "array", F.lit("[]")).when(prop["type"] == "object", F.lit("{}")).otherwise(F.lit('"sample"'))
    )


def _arguments(tool: Column, seed: Column) -> Column:
    """A value for every required property."""
    return F.transform(F.filter(tool["props"], lambda p: p["required"]), lambda p: F.struct(p["name"].alias("name"), value_of(p, seed).alias("value")))


def _call(tool: Column, seed: Column) -> Column:
    return F.array(F.struct(tool["name"].alias("name"), _arguments(tool, seed).alias("args")))


# Hard negatives


def no_tool(rows: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """A positive's request with two to four tools that leave out the ones it needs: refuse.

    Of the tools that a row draws, those with the fewest topic words of the request are offered.
    """
    gold = F.size(ex.called(F.col("answer"))) > 0
    drawn = with_drawn(rows.where(gold & (F.length("query") > 0)), pool, _numbers("no_tool", n_pool, CANDIDATES), "_tools")
    asked = drawn.withColumn("_asked", ex.topics(F.col("query"))).withColumn("_gold", ex.called(F.col("answer")))
    other = F.filter("_tools", lambda t: ~F.array_contains("_gold", t["name"]))
    ranked = F.transform(other, lambda t, i: F.struct(F.size(F.array_intersect("_asked", ex.topics(F.concat_ws(" ", t["name"], t["description"])))).alias("o"), i.alias("i"), t.alias("t")))
    keep = (draw("no_tool_size", F.col("ex_id")) % 3 + 2).cast("int")
    fit = asked.withColumn("_few", F.transform(F.slice(F.array_sort(F.transform(ranked, lambda r: F.struct(r["o"], r["i"]))), F.lit(1), keep), lambda r: r["i"])).withColumn("_other", other)
    fit = kept(fit, F.size("_few") > 1)
    offered = F.transform("_few", lambda i: F.element_at("_other", i + 1))
    return _made(fit, offered, F.col("query"), "refuse", None, refusal(offered), source="hard_negative", hn_kind="no_tool", removed_tool=F.array_min("_gold"))


def no_tool_off_domain(seeds: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """A request that none of two to four drawn tools covers: of a row's order of requests the first with under two words in common."""
    size = (draw("off_size", F.col("ex_id")) % 3 + 2).cast("int")
    drawn = with_drawn(seeds.select("ex_id"), pool, [F.when(size > i, k) for i, k in enumerate(_numbers("off", n_pool, 4))], "_tools")
    words = F.array_distinct(F.flatten(F.transform("_tools", lambda t: ex.topics(F.concat_ws(" ", t["name"], t["description"])))))
    turned = F.array_sort(F.array(*[F.struct(draw("off_order", F.col("ex_id"), i).alias("d"), F.lit(q).alias("q")) for i, q in enumerate(OFF_DOMAIN)]))
    able = F.filter("_turned", lambda r: F.size(F.array_intersect(ex.topics(r["q"]), F.col("_words"))) < 2)
    marked = drawn.withColumn("_words", words).withColumn("_turned", turned)
    query = F.coalesce(F.try_element_at(able, F.lit(1))["q"], F.element_at("_turned", 1)["q"])
    return _made(marked, F.col("_tools"), query, "refuse", None, refusal(F.col("_tools")), source="hard_negative", hn_kind="no_tool")


def over_refusal(rows: DataFrame) -> DataFrame:
    """A hedge before a request that can be met; the gold calls stay."""
    query = F.concat(_one("hedge", HEDGES), F.lower(F.substring("query", 1, 1)), F.substr("query", F.lit(2)))
    good = rows.where(ex.callable_(F.col("answer"), F.col("tools"), F.col("query")))
    return _made(good, F.col("tools"), query, "tool_call", F.col("answer.calls"), None, source="hard_negative", hn_kind="over_refusal", gold_type="tool_call")


def partial_parallel(rows: DataFrame) -> DataFrame:
    """Two requests with one call each, of different tools, as one request with both calls.

    Rows stand in the order of a draw, and neighbours are paired.
    """
    single = rows.where(ex.callable_(F.col("answer"), F.col("tools"), F.col("query")) & (F.size("answer.calls") == 1)).select("ex_id", "tools", "query", "answer").withColumn("_d", draw("pair", F.col("ex_id")))
    placed = ordered(single, [], ["_d", "ex_id"], "_place").drop("_d")
    a = placed.where("_place % 2 = 0").withColumn("_pair", F.expr("_place div 2"))
    b = placed.where("_place % 2 = 1").select(F.expr("_place div 2").alias("_pair"), F.col("tools").alias("_tools"), F.col("query").alias("_query"), F.col("answer.calls").alias("_calls"), F.col("ex_id").alias("_with"))
    both = a.join(b, "_pair").where(F.element_at("answer.calls", 1)["name"] != F.element_at("_calls", 1)["name"])
    two = F.rtrim("_query", F.lit("."))
    query = F.concat(F.rtrim("query", F.lit(".")), F.lit(". Also, "), F.lower(F.substr(two, F.lit(1), F.lit(1))), F.substr(two, F.lit(2)), F.lit("."))
    return _made(both, ex.first_of_names(F.concat("tools", "_tools")), query, "tool_call", F.concat("answer.calls", "_calls"), None, source="hard_negative", hn_kind="partial_parallel", gold_type="tool_call", partner=F.col("_with"))


def _own(seeds: DataFrame, pool: DataFrame, n_pool: int, seed: str, others: int) -> DataFrame:
    """Seeds with a tool of their own (``_tool``), and up to ``others`` different ones (``_others``)."""
    drawn = with_drawn(seeds.select("ex_id"), pool, _numbers(seed, n_pool, others + 1), "_tools")
    return drawn.select("ex_id", F.element_at("_tools", 1).alias("_tool"), F.slice("_tools", 2, max(others, 1)).alias("_others"))


def missing_arg(seeds: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """A request for a tool that leaves out one required argument: ask for it. Up to two other tools are on offer."""
    made = _own(seeds, pool, n_pool, "missing", 2).withColumn("_need", ex.required(F.col("_tool"))).where(F.size("_need") > 0)
    gone = F.element_at("_need", (F.pmod(draw("missing_which", F.col("ex_id")), F.size("_need")) + 1).cast("int"))
    kept = F.array_remove("_need", gone)
    query = F.concat(F.lit("Please "), F.lower(_plain(F.col("_tool"))), F.lit("."), F.when(F.size(kept) > 0, F.concat(F.lit(" I have the "), F.array_join(kept, ", "), F.lit("."))).otherwise(""))
    kind = F.element_at(F.filter(F.col("_tool")["props"], lambda p: p["name"] == gone), 1)["type"]
    content = F.concat(F.lit("`"), F.col("_tool")["name"], F.lit("` needs the required `"), gone, F.lit("` ("), kind, F.lit("). What should it be?"))
    return _made(made, F.concat(F.array("_tool"), F.slice("_others", 1, 2)), query, "clarify", None, content, source="hard_negative", hn_kind="missing_arg", dropped=gone)


def hint(tool: Column) -> Column:
    """Up to two topic words of a tool, in order; else its name."""
    words = F.array_sort(ex.topics(F.coalesce(F.nullif(tool["description"], F.lit("")), tool["name"])))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 2), " ")).otherwise(tool["name"])


def ambiguous(seeds: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """A request that fits two tools alike: ask which."""
    two = with_drawn(seeds.select("ex_id"), pool, _numbers("ambiguous", n_pool, 3), "_tools").where(F.size("_tools") > 1).withColumn("_a", F.element_at("_tools", 1)).withColumn("_b", F.element_at("_tools", 2))
    query = F.concat(F.lit("Could you "), _one("verb", VERBS), F.lit(" the "), hint(F.col("_a")), F.lit(" matter? Any fitting tool will do."))
    content = F.concat(F.lit("Both `"), F.col("_a.name"), F.lit("` and `"), F.col("_b.name"), F.lit("` could apply. Which one, and with what details?"))
    return _made(two, F.array("_a", "_b"), query, "clarify", None, content, source="hard_negative", hn_kind="ambiguous")


def by_weight(seeds: DataFrame, weights: dict[str, float], seed: str) -> Column:
    """A kind for each row, drawn by weight."""
    total, upto, out = sum(weights.values()), 0.0, None
    at = draw(seed, seeds["ex_id"]) / F.lit(4294967296.0)
    for name, w in weights.items():
        upto += w / total
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out.otherwise(list(weights)[-1])


def _mixed(spark, n: int, weights: dict[str, float], seed: str, makers: dict) -> DataFrame:
    """n rows of several kinds: more attempts than asked for, each of a drawn kind; those that fail are gone, the first n stay."""
    seeds = spark.range(n * ATTEMPTS).withColumnRenamed("id", "ex_id")
    kinds = seeds.withColumn("_kind", by_weight(seeds, weights, seed))
    made = [make(kinds.where(F.col("_kind") == name).select("ex_id")) for name, make in makers.items() if name in weights]
    return ordered(reduce(DataFrame.unionByName, made), [], ["ex_id"], "_place").where(F.col("_place") < n).drop("_place")


def hard_negatives(rows: DataFrame, pool: DataFrame, n: int, weights: dict[str, float]) -> DataFrame:
    """n hard negatives of the kinds that ``weights`` names; kinds made from positives take one drawn by number."""
    n_pool = pool.count()
    if n_pool < 2:
        raise ValueError("two different tools are needed")
    gold = rows.where((F.size(ex.called(F.col("answer"))) > 0) & (F.length("query") > 0))
    numbered = ordered(gold.select("ex_id", "tools", "query", "answer"), [], ["ex_id"], "_number")
    n_gold = numbered.count()
    pairs = partial_parallel(gold)
    pairs = ordered(pairs.select("ex_id", "tools", "query", "answer", "meta"), [], ["ex_id"], "_number")
    n_pairs = pairs.count()

    def from_(table: DataFrame, many: int, make):
        picked = lambda seeds: seeds.withColumn("_number", draw("positive", F.col("ex_id")) % many).join(table.drop("ex_id"), "_number").drop("_number")
        return lambda seeds: make(picked(seeds)) if many else seeds.sparkSession.createDataFrame([], ex.LAYOUT)

    def none(seeds: DataFrame) -> DataFrame:
        if not n_gold:
            return no_tool_off_domain(seeds, pool, n_pool)
        grounded = from_(numbered, n_gold, lambda r: no_tool(r, pool, n_pool))(seeds)
        return grounded.unionByName(no_tool_off_domain(seeds.join(grounded.select("ex_id"), "ex_id", "left_anti"), pool, n_pool))

    makers = {
        "no_tool": none, "over_refusal": from_(numbered, n_gold, over_refusal), "partial_parallel": from_(pairs, n_pairs, lambda r: r.select("ex_id", "tools", "query", "answer", F.lit(None).cast(ex.TURNS).alias("history"), "meta")),
        "missing_arg": lambda s: missing_arg(s, pool, n_pool), "ambiguous": lambda s: ambiguous(s, pool, n_pool),
    }
    return _mixed(rows.sparkSession, n, weights, "hn_kind", makers)


# Several turns


def miss_param(seeds: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """A task under way of which a required argument was never given: ask."""
    made = _own(seeds, pool, n_pool, "miss_param", 0).withColumn("_need", ex.required(F.col("_tool"))).where(F.size("_need") > 0)
    gone = F.element_at("_need", (F.pmod(draw("miss_which", F.col("ex_id")), F.size("_need")) + 1).cast("int"))
    history = _turns(("user", F.concat(F.lit("Hello, I want to "), F.lower(_plain(F.col("_tool"))), F.lit("."))), ("assistant", F.lit('{"action":"clarify","message":"Gladly, tell me more."}')))
    content = F.concat(F.lit("The required `"), gone, F.lit("` is missing for `"), F.col("_tool.name"), F.lit("`. What is it?"))
    return _made(made, F.array("_tool"), F.lit("Then do it, please."), "clarify", None, content, history, source="multiturn", mt_kind="miss_param", dropped=gone)


def miss_func(seeds: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """The tool was missing when it was asked for and is there now: call it."""
    made, seed = _own(seeds, pool, n_pool, "miss_func", 0), draw("miss_func_value", F.col("ex_id"))
    does = F.lower(_plain(F.col("_tool")))
    history = _turns(("user", F.concat(F.lit("Can you "), does, F.lit("?"))), ("assistant", F.lit('{"action":"refuse","message":"None of my tools does that."}')), ("user", F.concat(F.lit("You have `"), F.col("_tool.name"), F.lit("` from now on."))))
    return _made(made, F.array("_tool"), F.concat(F.lit("Now "), does, F.lit(".")), "tool_call", _call(F.col("_tool"), seed), None, history, source="multiturn", mt_kind="miss_func")


def long_context(seeds: DataFrame, pool: DataFrame, n_pool: int, others: int = 10) -> DataFrame:
    """The right tool among up to ten others, in an order of its own: call it."""
    made, seed = _own(seeds, pool, n_pool, "long_context", others), draw("long_value", F.col("ex_id"))
    every = F.concat(F.array("_tool"), "_others")
    turned = F.transform(F.array_sort(F.transform(every, lambda t, i: F.struct(F.md5(F.concat_ws("|", F.lit("turn"), F.col("ex_id").cast("string"), t["name"])).alias("d"), i.alias("i")))), lambda r: F.element_at(every, r["i"] + 1))
    history = _turns(("user", F.lit("You have many tools; use the right one.")), ("assistant", F.lit('{"action":"clarify","message":"What is the task?"}')))
    return _made(made, turned, F.concat(F.lit("Please "), F.lower(_plain(F.col("_tool"))), F.lit(".")), "tool_call", _call(F.col("_tool"), seed), None, history, source="multiturn", mt_kind="long_context")


def multi_turn(spark, pool: DataFrame, n: int, weights: dict[str, float]) -> DataFrame:
    """n examples of several turns by weight; miss_param draws from tools with required arguments only."""
    needing = ordered(pool.where(F.size(ex.required(F.col("tool"))) > 0).select("tool", F.col("tool.name").alias("name")), [], ["name"], "k").select("k", "tool")
    n_pool, n_needing = pool.count(), needing.count()
    makers = {"miss_param": lambda s: miss_param(s, needing, n_needing), "miss_func": lambda s: miss_func(s, pool, n_pool), "long_context": lambda s: long_context(s, pool, n_pool)}
    return _mixed(spark, n, {k: w for k, w in weights.items() if k != "miss_param" or n_needing}, "mt_kind", makers)


# Schema drift


def add_required(seeds: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """A new required property that the request knows nothing of: ask."""
    made, new = _own(seeds, pool, n_pool, "add_required", 0), _one("new_property", NEW_PROPERTIES)
    prop = F.struct(new.alias("name"), F.lit("string").alias("type"), F.lit(True).alias("required"), F.lit(None).cast("array<string>").alias("options"))
    tool = F.struct(F.col("_tool.name").alias("name"), F.col("_tool.description").alias("description"), F.concat(F.filter("_tool.props", lambda p: p["name"] != new), F.array(prop)).alias("props"))
    content = F.concat(F.lit("`"), F.col("_tool.name"), F.lit("` has come to need `"), new, F.lit("`. What is it?"))
    return _made(made, F.array(tool), F.concat(F.lit("Please "), F.lower(_plain(F.col("_tool"))), F.lit(".")), "clarify", None, content, source="schema_drift", sd_kind="add_required", field=new)


def retype_enum(seeds: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """A required text that has become a choice, and a request with a value outside it: ask."""
    made = _own(seeds, pool, n_pool, "retype", 0).withColumn("_texts", F.transform(F.filter("_tool.props", lambda p: p["required"] & (p["type"] == "string")), lambda p: p["name"])).where(F.size("_texts") > 0)
    made = made.withColumn("_field", F.element_at("_texts", (F.pmod(draw("retype_which", F.col("ex_id")), F.size("_texts")) + 1).cast("int")))
    sets = [F.array(*map(F.lit, v)) for v in OPTIONS.values()]
    drawn = F.element_at(F.array(*sets), (draw("retype_set", F.col("ex_id")) % len(sets) + 1).cast("int"))
    named = reduce(lambda out, kv: out.when(F.col("_field") == kv[0], F.array(*map(F.lit, kv[1]))), OPTIONS.items(), F.when(F.lit(False), drawn)).otherwise(drawn)
    prop = lambda p: F.when(p["name"] == F.col("_field"), F.struct(p["name"].alias("name"), F.lit("string").alias("type"), p["required"].alias("required"), F.col("_options").alias("options"))).otherwise(p)
    made = made.withColumn("_options", named)
    tool = F.struct(F.col("_tool.name").alias("name"), F.col("_tool.description").alias("description"), F.transform("_tool.props", prop).alias("props"))
    query = F.concat(_plain(F.col("_tool")), F.lit(" with "), F.col("_field"), F.lit(f' = "{NOT_AN_OPTION}".'))
    content = F.concat(F.lit("`"), F.col("_field"), F.lit("` is one of "), F.array_join("_options", ", "), F.lit(" now. Which one?"))
    return _made(made, F.array(tool), query, "clarify", None, content, source="schema_drift", sd_kind="retype_enum", field=F.col("_field"))


def rename(seeds: DataFrame, pool: DataFrame, n_pool: int) -> DataFrame:
    """A required property under a new name, last in the order; the request gives its value under the old one: call with the new."""
    made = _own(seeds, pool, n_pool, "rename", 0).withColumn("_need", ex.required(F.col("_tool"))).where(F.size("_need") > 0)
    made = made.withColumn("_old", F.element_at("_need", (F.pmod(draw("rename_which", F.col("ex_id")), F.size("_need")) + 1).cast("int")))
    made = made.withColumn("_new", F.concat("_old", F.when(F.endswith("_old", F.lit("_id")), "_value").otherwise("_id")))
    moved = F.transform(F.filter("_tool.props", lambda p: p["name"] == F.col("_old")), lambda p: F.struct(F.col("_new").alias("name"), p["type"].alias("type"), p["required"].alias("required"), p["options"].alias("options")))
    made = made.withColumn("_drifted", F.struct(F.col("_tool.name").alias("name"), F.col("_tool.description").alias("description"), F.concat(F.filter("_tool.props", lambda p: p["name"] != F.col("_old")), moved).alias("props")))
    seed = draw("rename_value", F.col("ex_id"))
    value = F.element_at(F.filter(_arguments(F.col("_drifted"), seed), lambda a: a["name"] == F.col("_new")), 1)["value"]
    query = F.concat(_plain(F.col("_tool")), F.lit("; the "), F.col("_old"), F.lit(" is "), F.replace(value, F.lit('"'), F.lit("")), F.lit("."))
    out = _made(made, F.array("_drifted"), query, "tool_call", _call(F.col("_drifted"), seed), None, source="schema_drift", sd_kind="rename", field=F.col("_new"))
    return ex.curated(out)


def schema_drift(spark, pool: DataFrame, n: int, weights: dict[str, float]) -> DataFrame:
    n_pool = pool.count()
    makers = {"add_required": lambda s: add_required(s, pool, n_pool), "retype_enum": lambda s: retype_enum(s, pool, n_pool), "rename": lambda s: rename(s, pool, n_pool)}
    return _mixed(spark, n, weights, "sd_kind", makers)


# Twins

FORMATS = ("python", "xml", "compact")


def _chosen(rows: DataFrame, n: int, seed: str, prefix: str, fit: Column) -> DataFrame:
    """The first n fitting rows in the order of a draw, with the id of their pair.

    Rows are written once, and only ids are dealt and numbered: the ranges of an order are sampled, which would make
    every row twice, and tools and answers wouldn't travel to be sorted. Rows of one id are numbered apart by ``_row``.
    """
    held = Scratch(rows.sparkSession).cut(rows.where(fit).withColumn("_row", F.monotonically_increasing_id()))
    ids = held.select("ex_id", "_row", draw(seed, F.col("ex_id")).alias("_d"))
    placed = ordered(ids, [], ["_d", "ex_id", "_row"], "_place").where(F.col("_place") < n)
    pairs = placed.select("_row", F.concat(F.lit(prefix), F.col("_place").cast("string")).alias("_pair"))
    return held.join(pairs, "_row").select(*rows.columns, "_pair")


def _with_meta(meta: Column, **entries: Column | str) -> Column:
    fresh = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).cast("string").alias("value")) for k, v in entries.items()]))
    return F.map_concat(F.map_filter(meta, lambda k, _: ~k.isin(*entries)), fresh)


def _paired(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` with the pair id of those that have a twin."""
    ids = chosen.select("ex_id", "_pair").dropDuplicates(["ex_id"])
    return rows.join(ids, "ex_id", "left").withColumn("meta", F.when(F.col("_pair").isNotNull(), _with_meta(F.col("meta"), pair_id=F.col("_pair"))).otherwise(F.col("meta"))).drop("_pair").select(*ex.COLUMNS)


def format_twins(rows: DataFrame, n: int, per_source: int = 2) -> tuple[DataFrame, DataFrame]:
    """(twins, rows): n sources get twins that differ in how their tools are written; sources get the pair's id."""
    chosen = _chosen(rows, n, "fmt", "fmt-", ex.twinnable(rows))
    turned = F.array_sort(F.array(*[F.struct(draw("fmt_order", F.col("ex_id"), i).alias("d"), F.lit(f).alias("f")) for i, f in enumerate(FORMATS)]))
    each = chosen.withColumn("_f", F.explode_outer(F.slice(turned, 1, per_source)))
    meta = _with_meta(F.col("meta"), source="format_twin", doc_format=F.col("_f.f"), pair_id=F.col("_pair"), fmt_of=F.col("meta")["source"])
    return each.withColumn("meta", meta).select(*ex.COLUMNS), _paired(rows, chosen)


def masked(tools: Column, answer: Column) -> tuple[Column, Column]:
    """Tools and answer with neutral names: tools by position, properties by position in their tool; descriptions stay."""
    tool = lambda t, i: F.struct(
        F.concat(F.lit("func_"), i.cast("string")).alias("name"), t["description"].alias("description"),
        F.transform(t["props"], lambda p, j: F.struct(F.concat(F.lit("arg_"), j.cast("string")).alias("name"), p["type"].alias("type"), p["required"].alias("required"), p["options"].alias("options"))).alias("props"),
    )
    place = lambda items, name: F.array_position(F.transform(items, lambda x: x["name"]), name) - 1

    def call(c: Column) -> Column:
        owner = ex.by_name(tools, c["name"])
        arg = lambda a: F.struct(F.when(place(owner["props"], a["name"]) >= 0, F.concat(F.lit("arg_"), place(owner["props"], a["name"]).cast("string"))).otherwise(a["name"]).alias("name"), a["value"].alias("value"))
        return F.struct(F.when(place(tools, c["name"]) >= 0, F.concat(F.lit("func_"), place(tools, c["name"]).cast("string"))).otherwise(c["name"]).alias("name"), F.transform(c["args"], arg).alias("args"))

    return F.transform(tools, tool), F.struct(answer["type"].alias("type"), F.transform(answer["calls"], call).alias("calls"), answer["content"].alias("content"))


def masked_twins(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(twins, rows): n sources of one turn get a twin with neutral names whose answer still fits its schemas."""
    tools, answer = masked(F.col("_source_tools"), F.col("_source_answer"))
    fit = rows.where(ex.twinnable(rows, single_turn=True)).withColumn("_source_tools", F.col("tools")).withColumn("_source_answer", F.col("answer"))
    hidden = fit.withColumn("tools", tools).withColumn("answer", answer)
    good = kept(hidden, ex.valid(hidden)).drop("_source_tools", "_source_answer")
    chosen = _chosen(good, n, "mask", "mask-", F.lit(True))
    meta = _with_meta(F.col("meta"), source="masked_twin", pair_id=F.col("_pair"), mask_of=F.col("meta")["source"])
    return chosen.withColumn("meta", meta).select(*ex.COLUMNS), _paired(rows, chosen)


def multilingual(spark, templates: DataFrame, n: int) -> DataFrame:
    """n examples, whole pairs: a drawn template (number, kind, tools, answer, queries by language) in every language, one pair id.

    ``templates`` are numbered from 0 within their kind; calls are drawn twice as often as refusals and questions.
    """
    langs = templates.select(F.size("queries").alias("n")).first()["n"]
    pairs = spark.range(1, -(-n // langs) + 1).withColumnRenamed("id", "ex_id")
    kind = F.element_at(F.array(*map(F.lit, ("call", "call", "refuse", "clarify"))), (draw("ml_kind", F.col("ex_id")) % 4 + 1).cast("int"))
    sizes = templates.groupBy("kind").agg(F.count("*").alias("many"))
    drawn = pairs.withColumn("kind", kind).join(F.broadcast(sizes), "kind").withColumn("number", draw("ml_template", F.col("ex_id")) % F.col("many"))  # three kinds
    met = drawn.join(small(templates), ["kind", "number"]).select("ex_id", "kind", "tools", "answer", F.explode_outer("queries").alias("lang", "query"))
    meta = F.map_from_arrays(F.array(*map(F.lit, ("source", "lang", "pair_id", "ml_kind"))), F.array(F.lit("multilingual"), F.col("lang"), F.col("ex_id").cast("string"), F.col("kind")))
    return met.select("ex_id", "tools", "query", "answer", F.lit(None).cast(ex.TURNS).alias("history"), meta.alias("meta"))

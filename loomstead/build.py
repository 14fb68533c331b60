"""From sources to written splits: curate, carve out, generate, deduplicate, twin, decontaminate, guard, split, count."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .functions.text import draw, tokens
from .operators import examples as ex, generators as gen, preference, shaping, similarity, vectors
from .operators.ordering import ordered
from .sources.scratch import Scratch

#: What a build does where its configuration says nothing.
DEFAULTS: dict[str, Any] = {
    "seed": 42, "target_positive": None, "quality_keep_frac": 1.0, "novel_tool_frac": 0.0, "hard_negative_ratio": 0.22, "multiturn_ratio": 0.10, "schema_drift_ratio": 0.08,
    "kinds": {
        "hard_negative": {"no_tool": 0.4, "over_refusal": 0.2, "partial_parallel": 0.1, "missing_arg": 0.2, "ambiguous": 0.1},
        "multiturn": {"miss_param": 0.4, "miss_func": 0.3, "long_context": 0.3}, "schema_drift": {"add_required": 0.34, "retype_enum": 0.33, "rename": 0.33},
    },
    "near_threshold": 0.85, "semantic_threshold": 0.9, "format_twin_sources": 0, "masked_twin_examples": 0, "multilingual_examples": 0, "decontam_threshold": 0.6, "decontam_cosine": 0.92, "splits": {"train": 0.8, "val": 0.1}, "leak_threshold": 0.9,
}
#: Dropped rows that a report names.
SHOWN = 50
#: Shares between which the share of no_tool rows should lie, and how many miss_param rows there should be.
NO_TOOL_SHARE, LEAST_MISS_PARAM = (0.06, 0.14), 10


def configured(path: str | None = None, **given: Any) -> dict[str, Any]:
    """The defaults, under a YAML or JSON file's ``dataset`` section (or the whole file), under what is given."""
    found: dict[str, Any] = {}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            found = json.loads(text)
        else:
            import yaml

            found = yaml.safe_load(text) or {}
        found = {k: v for k, v in found.items() if k != "dataset"} | found.get("dataset", {})
    return DEFAULTS | found | {k: v for k, v in given.items() if v is not None}


def quality(rows: DataFrame) -> Column:
    """Heuristic quality of an example, from its request, its arguments and what the request says of its tools."""
    values = F.flatten(F.transform("answer.calls", lambda c: F.transform(c["args"], lambda a: F.replace(a["value"], F.lit('"'), F.lit("")))))
    real = F.forall(values, lambda v: shaping.real_value(v))
    said = F.array_distinct(tokens(F.col("query")))
    grounding = F.aggregate("answer.calls", F.lit(0), lambda n, c: n + F.size(F.array_intersect(said, tokens(F.concat_ws(" ", F.replace(c["name"], F.lit("_"), F.lit(" ")), ex.by_name(F.col("tools"), c["name"])["description"])))))
    return shaping.quality(F.size(tokens(F.col("query"))), F.size(values), real, grounding, F.col("_valid"))


@dataclass
class Built:
    """Splits as one table with a ``split`` column, rows of tools never trained on, and counts."""

    rows: DataFrame
    novel: DataFrame
    stats: dict[str, Any] = field(default_factory=dict)


def _union(parts: list[DataFrame]) -> DataFrame:
    """Slices one after another, their ids made anew so that none occurs twice."""
    marked = [p.select(*ex.COLUMNS).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = marked[0]
    for p in marked[1:]:
        every = every.unionByName(p)
    keyed = every.withColumn("_h", F.xxhash64("query", F.to_json("meta")))
    return ordered(keyed, [], ["_part", "ex_id", "_h"], "_place").withColumn("ex_id", F.col("_place")).select(*ex.COLUMNS)


def build(positives: DataFrame, config: dict[str, Any] | None = None, probes: DataFrame | None = None, templates: DataFrame | None = None) -> Built:
    """Typed examples to splits. ``probes`` (probe, text) are held-out requests; ``templates`` feed the multilingual slice."""
    cfg = DEFAULTS | (config or {})
    spark, scratch = positives.sparkSession, Scratch(positives.sparkSession)
    stats: dict[str, Any] = {"read": positives.count()}
    rows = scratch.cut(ex.curated(positives.select(*ex.COLUMNS)))
    stats["valid"] = rows.count()
    if cfg["target_positive"]:
        placed = ordered(rows.withColumn("_d", draw(f"cap{cfg['seed']}", F.col("ex_id"))), [], ["_d", "ex_id"], "_place")
        rows = scratch.cut(placed.where(F.col("_place") < cfg["target_positive"]).select(*ex.COLUMNS))
    if cfg["quality_keep_frac"] < 1:
        scored = rows.withColumn("_valid", F.lit(True))
        scored = scratch.cut(scored.withColumn("_score", quality(scored)).drop("_valid"))
        rows = scratch.cut(shaping.top_fraction(scored, cfg["quality_keep_frac"], "_score", "ex_id").select(*ex.COLUMNS))
    novel = rows.limit(0)
    if cfg["novel_tool_frac"] > 0:
        offered = rows.select(F.col("ex_id").alias("id"), F.explode_outer(ex.names(F.col("tools"))).alias("name")).distinct()
        routes = shaping.route_by_names(offered, offered.select("name"), cfg["novel_tool_frac"]).withColumnRenamed("id", "ex_id")
        routed = scratch.cut(rows.join(routes, "ex_id"))
        novel, rows = routed.where("route = 'test_novel'").drop("route"), routed.where("route = 'train'").drop("route")
        stats["novel"] = novel.count()
    base = rows.count()
    stats["positives"] = base
    pool = scratch.cut(gen.pool_of(rows))
    ratios = {"hard_negative": cfg["hard_negative_ratio"], "multiturn": cfg["multiturn_ratio"], "schema_drift": cfg["schema_drift_ratio"]}
    if sum(ratios.values()) >= 1:
        raise ValueError("slice ratios must sum to less than 1")
    sizes = {k: round(base / (1 - sum(ratios.values())) * r) for k, r in ratios.items()}
    parts = [rows]
    if sizes["hard_negative"]:
        parts.append(gen.hard_negatives(rows, pool, sizes["hard_negative"], cfg["kinds"]["hard_negative"]))
    if sizes["multiturn"]:
        parts.append(gen.multi_turn(spark, pool, sizes["multiturn"], cfg["kinds"]["multiturn"]))
    if sizes["schema_drift"]:
        parts.append(gen.schema_drift(spark, pool, sizes["schema_drift"], cfg["kinds"]["schema_drift"]))
    combined = scratch.cut(_union(parts))
    stats["combined"] = combined.count()
    for name, threshold, gone_of in (("minhash", "near_threshold", similarity.near_gone), ("semantic", "semantic_threshold", lambda texts, at: vectors.keep_first(vectors.text_vectors(texts), at))):
        signed = combined.select(F.col("ex_id").alias("id"), ex.group_of(F.col("meta")).alias("grp"), ex.signature(F.col("tools"), F.col("query"), F.col("answer"), F.col("meta")).alias("text"))
        gone = scratch.cut(gone_of(signed, cfg[threshold]))
        combined = scratch.cut(combined.join(gone.select(F.col("id").alias("ex_id")), "ex_id", "left_anti"))
        stats[f"{name}_dropped"] = gone.count()
        stats[f"{name}_drops"] = [[r["id"], r["partner"]] for r in gone.orderBy("id").limit(SHOWN).collect()]
    stats["deduplicated"] = combined.count()
    # Twins share their source's request, so they come after deduplication.
    later = []
    if cfg["multilingual_examples"] and templates is not None:
        later.append(gen.multilingual(spark, templates, cfg["multilingual_examples"]))
    for name, maker in (("format_twin_sources", gen.format_twins), ("masked_twin_examples", gen.masked_twins)):
        if cfg[name]:
            twins, sources = maker(combined, cfg[name])
            later.append(scratch.cut(twins))
            combined = scratch.cut(sources)
    combined = scratch.cut(_union([combined, *later]))
    if probes is not None:
        asked, held = combined.select(F.col("ex_id").alias("id"), F.col("query").alias("text")), probes.select(F.col("probe").alias("id"), "text")
        scored = scratch.cut(vectors.decontaminate(asked, held, cfg["decontam_threshold"], cfg["decontam_cosine"]))
        before = combined.count()
        combined = scratch.cut(combined.join(scored.where("NOT dropped").select(F.col("id").alias("ex_id")), "ex_id"))
        shown = scored.where("dropped").orderBy("id").limit(SHOWN).collect()
        stats["contamination"] = {
            "before": before, "after": combined.count(), "threshold": cfg["decontam_threshold"], "cosine": cfg["decontam_cosine"],
            "dropped": [{"ex_id": r["id"], "ngram": round(r["score"], 3), "cos": round(r["cosine"], 3), "probe": r["probe"], "near": r["near"]} for r in shown],
        }
    before = combined.count()
    combined = scratch.cut(ex.guarded(combined)[0])
    stats["schema_invalid_dropped"] = before - combined.count()
    keyed = combined.withColumn("_key", ex.split_key(F.col("ex_id"), F.col("meta")))
    split = shaping.group_split(keyed.select("_key"), "_key", (cfg["splits"]["train"], cfg["splits"]["val"]), f"split{cfg['seed']}")
    divided = scratch.cut(keyed.join(split, "_key").drop("_key"))
    near = similarity.near_classes(divided.select(F.col("ex_id").alias("id"), F.lit(0).alias("grp"), F.col("query").alias("text")), cfg["leak_threshold"])
    side = divided.select(F.col("ex_id").alias("id"), "split")
    asked = vectors.text_vectors(divided.select(F.col("ex_id").alias("id"), F.col("query").alias("text"), (F.col("split") != "train").alias("held")))
    leaks = _leaks(near, side).unionByName(vectors.near_held(asked, cfg["leak_threshold"])).distinct()
    out = scratch.cut(divided.join(leaks.withColumnRenamed("id", "ex_id"), "ex_id", "left_anti"))
    stats["leaks_dropped"] = divided.count() - out.count()
    stats |= counts(out)
    return Built(out, novel, stats)


def _leaks(near: tuple[DataFrame, DataFrame], side: DataFrame) -> DataFrame:
    """(id) of train rows with a near-duplicate among the other splits; whole classes at a time, never pairs of rows."""
    members, pairs = near
    held = members.join(side, "id").groupBy("rep").agg(F.max((F.col("split") != "train").cast("int")).alias("held"))
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    touched = both.join(held.where("held = 1").select(F.col("rep").alias("j")), "j").select(F.col("i").alias("rep")).unionByName(held.where("held = 1").select("rep")).distinct()
    return members.join(touched, "rep").join(side.where("split = 'train'"), "id").select("id").distinct()


def counts(rows: DataFrame) -> dict[str, Any]:
    """Rows by split, source, kind and language, realised shares, and whether the mix is inside its guard."""
    meta = lambda k: F.col("meta")[k].alias(k)
    flat = rows.select("split", meta("source"), meta("hn_kind"), meta("mt_kind"), meta("sd_kind"), F.coalesce(F.col("meta")["lang"], F.lit("en")).alias("lang"))
    names = ["source", "hn_kind", "mt_kind", "sd_kind", "lang"]
    table = flat.groupingSets([["split", n] for n in names], "split", *names).agg(F.count("*").alias("n")).collect()  # splits by a few kinds
    by: dict[str, dict[str, dict[str, int]]] = {}
    for r in table:
        for n in names:
            if r[n] is not None:
                by.setdefault(r["split"], {}).setdefault(f"by_{n}", {})[r[n]] = r["n"]
    total = lambda name: {k: sum(s.get(f"by_{name}", {}).get(k, 0) for s in by.values()) for s in by.values() for k in s.get(f"by_{name}", {})}
    everything = sum(total("lang").values())
    no_tool, miss = total("hn_kind").get("no_tool", 0), total("mt_kind").get("miss_param", 0)
    share = round(no_tool / max(everything, 1), 4)
    realized = {k: round(v / max(everything, 1), 4) for k, v in total("source").items()}
    return {"total": everything, "mix": {"realized_shares": realized, "no_tool_share": share, "miss_param": miss, "ok": NO_TOOL_SHARE[0] <= share <= NO_TOOL_SHARE[1] and miss >= LEAST_MISS_PARAM}, "splits": by}


def completions(rows: DataFrame) -> DataFrame:
    """(ex_id, prompt, completion): what a model is trained on; a history stands before the request."""
    from .functions.rendering import history

    before = F.when(F.size("history") > 0, F.concat(F.lit("\n\n"), history(F.col("history")))).otherwise(F.lit(""))
    prompt = F.concat(F.lit("Tools:\n"), ex.tools_json(F.col("tools")), before, F.lit("\n\nUser request:\n"), F.col("query"))
    return rows.select("ex_id", prompt.alias("prompt"), ex.envelope(F.col("answer.type"), F.col("answer.calls"), F.col("answer.content")).alias("completion"))


def write(built: Built, folder: str) -> None:
    """Splits as JSON lines (one folder each), training rows as prompt and completion, preference pairs, and counts."""
    for split in ("train", "val", "test"):
        built.rows.where(F.col("split") == split).drop("split").write.mode("overwrite").json(f"{folder}/{split}.jsonl")
    built.novel.write.mode("overwrite").json(f"{folder}/test_novel.jsonl")
    train = built.rows.where("split = 'train'")
    completions(train).write.mode("overwrite").json(f"{folder}/train_pc.jsonl")
    preference.merged(preference.pairs(train), preference.axis_pairs(train)).write.mode("overwrite").json(f"{folder}/pref.jsonl")
    lines = built.rows.sparkSession.createDataFrame([(json.dumps(built.stats, sort_keys=True),)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{folder}/stats.json")

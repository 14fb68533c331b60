"""Command line: ``python -m loomstead.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import build as builder, release, report
from .functions import parsing
from .operators import evaluations, examples as ex, preference, probes, statistics
from .sources import readers, writers


def _session() -> SparkSession:
    return SparkSession.builder.appName("loomstead").getOrCreate()


def _examples(spark: SparkSession, path: str) -> DataFrame:
    """Typed examples from JSON lines of the readers' layout or of an earlier build; ids by content, so reruns agree."""
    raw = spark.read.json(path)
    if isinstance(dict(raw.dtypes).get("tools"), str) and dict(raw.dtypes)["tools"] == "string":
        rows = readers.json_lines(spark, path, readers.EXAMPLE)
        return ex.typed(rows.withColumn("ex_id", F.xxhash64("query", "tools", F.to_json("answer"))))
    return readers.json_lines(spark, path, ex.LAYOUT)


def _graded(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts of JSON lines with answer, tools and output, all JSON text; other columns stay."""
    rows = spark.read.json(path)
    return rows.withColumn("v", parsing.verdicts("answer", "tools", "output"))


def build(a: argparse.Namespace) -> int:
    spark = _session()
    # "default" stands for the library's own probes.
    path = None if a.probes == "default" else a.probes
    probed = readers.probes(spark, path).select(F.xxhash64("text").alias("probe"), "text") if a.probes else None
    built = builder.build(_examples(spark, a.input), builder.configured(a.config), probed)
    builder.write(built, a.out)
    print(json.dumps(built.stats, indent=2, sort_keys=True))
    return 0


def preferences(a: argparse.Namespace) -> int:
    rows = _examples(_session(), a.input)
    preference.merged(preference.pairs(rows), preference.axis_pairs(rows)).write.mode("overwrite").json(a.out)
    return 0


def evaluate(a: argparse.Namespace) -> int:
    rows = _graded(_session(), a.input)
    by = [a.by] if a.by else []
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    table = rows.groupBy(*by).agg(F.count("*").alias("n"), share("v.correct").alias("accuracy"), share("v.hallucinated_call").alias("hallucination"), (1 - share("v.parsed_ok")).alias("parse_failure"))
    print(report.markdown(table.orderBy(*by) if by else table))
    return 0


#: Resamples behind the intervals that are printed.
ROUNDS = 1000


def decompose(a: argparse.Namespace) -> int:
    spark = _session()
    base, tuned = (_graded(spark, p).select("id", "category", F.col("v.correct").cast("int").alias(n)) for p, n in ((a.base, "base"), (a.tuned, "tuned")))
    both = base.join(tuned.select("id", "tuned"), "id")
    by = both.groupBy("category").agg(F.count("*").alias("n"), F.avg("base").alias("base"), F.avg("tuned").alias("tuned"))
    print(report.markdown(by.withColumn("gap", F.round(F.col("tuned") - F.col("base"), 6)).orderBy(*evaluations.display_order(F.col("category")))))
    print(_significance(both))
    return 0


def _significance(both: DataFrame) -> str:
    """The line that compares two systems' bits (base, tuned) on the same rows."""
    every = both.select(F.lit(0).alias("g"), "base", "tuned")
    one, two = (evaluations.shares(every, "g", c, ROUNDS, c).select("g", *[F.col(x).alias(f"{c}_{x}") for x in ("accuracy", "lo", "hi")]) for c in ("base", "tuned"))
    means = statistics.resampled(every, "g", ["base", "tuned"], ROUNDS, "pair").withColumn("gap", F.col("tuned") - F.col("base"))
    gap = statistics.interval(means, "g", "gap", ROUNDS).select("g", "lo", "hi", "p")
    lost = every.groupBy("g").agg(F.count_if((F.col("base") == 1) & (F.col("tuned") == 0)).alias("b"), F.count_if((F.col("base") == 0) & (F.col("tuned") == 1)).alias("c"))
    row = one.join(two, "g").join(gap, "g").join(lost, "g")
    shown = [F.col(f"{c}_{x}") for c in ("base", "tuned") for x in ("accuracy", "lo", "hi")]
    found = row.select(evaluations.significance(*shown, F.col("tuned_accuracy") - F.col("base_accuracy"), F.col("lo"), F.col("hi"), F.col("p"), statistics.exact_mcnemar(F.col("b"), F.col("c"))).alias("line")).first()
    return found["line"] if found else "no rows in common"


def multilingual(a: argparse.Namespace) -> int:
    rows = _graded(_session(), a.input).where("pair_id IS NOT NULL AND lang IS NOT NULL")
    order = ["id"] if "id" in rows.columns else ["output"]
    bits = evaluations.last_bits(rows.select("pair_id", "lang", F.col("v.correct").cast("int").alias("ok"), *order), order)
    print(report.markdown(evaluations.shares(bits, "lang", "ok", ROUNDS, "lang").orderBy("lang"), "Languages"))
    print(report.markdown(evaluations.matched_deltas(bits, ROUNDS, "delta").orderBy("lang"), "Against English, matched pairs"))
    return 0


def make_report(a: argparse.Namespace) -> int:
    rows = _graded(_session(), a.input)
    share = F.round(F.avg(F.col("v.correct").cast("int")), 4).alias("accuracy")
    kinds = rows.groupBy(F.get_json_object("answer", "$.type").alias("gold"), F.coalesce("v.pred_action", F.lit("none")).alias("predicted")).agg(F.count("*").alias("n"))
    Path(a.out).write_text(report.page({"Accuracy": rows.agg(F.count("*").alias("n"), share), "Predictions": kinds.orderBy("gold", "predicted")}), encoding="utf-8")
    return 0


def probe(a: argparse.Namespace) -> int:
    spark = _session()
    cases = probes.cases(spark)
    told = cases.withColumn("output", F.col("gold")) if a.self_check else cases.join(spark.read.json(a.outputs).select("probe_id", "output"), "probe_id", "left")
    table = probes.score(told)
    print(report.markdown(table))
    return int(a.self_check and table.where("NOT passed").count() > 0)


def check(a: argparse.Namespace) -> int:
    kept = json.loads(Path(a.manifest).read_text()) if a.manifest and Path(a.manifest).is_file() else None
    problems = release.preflight(a.folder, a.cards, a.licence, kept)
    print("\n".join(problems) or "ready")
    return int(bool(problems))


def stamp(a: argparse.Namespace) -> int:
    Path(a.out).write_text(json.dumps(writers.manifest(a.folder, a.seed, builder.configured(a.config)), indent=2))
    return 0


def fill_card(a: argparse.Namespace) -> int:
    load = lambda p: json.loads(Path(p).read_text()) if p and Path(p).is_file() else {}
    base, tuned = load(a.base), load(a.tuned)
    Path(a.out).write_text(release.fill(Path(a.template).read_text(encoding="utf-8"), release.metrics(base, tuned), a.user, tuned.get("accuracy")), encoding="utf-8")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomstead")
    commands = parser.add_subparsers(required=True)

    def add(name: str, run, what: str, *options: tuple) -> None:
        sub = commands.add_parser(name, help=what)
        for flag, extra in options:
            sub.add_argument(flag, **extra)
        sub.set_defaults(run=run)

    need, path = {"required": True}, {"default": None}
    add("build", build, "examples to splits", ("--input", need), ("--out", need), ("--config", path), ("--probes", path))
    add("preference", preferences, "preference pairs", ("--input", need), ("--out", need))
    add("eval", evaluate, "grade outputs", ("--input", need), ("--by", path))
    add("baseline", evaluate, "grade a baseline's outputs", ("--input", need), ("--by", path))
    add("eval-multilingual", multilingual, "matched pairs against English", ("--input", need))
    add("decompose", decompose, "gap between two systems by category", ("--base", need), ("--tuned", need))
    add("report", make_report, "HTML report", ("--input", need), ("--out", need))
    add("probe", probe, "fixed reliability cases", ("--outputs", path), ("--self-check", {"action": "store_true"}))
    add("release", check, "what forbids a release", ("--folder", need), ("--licence", {"default": "LICENSE"}), ("--manifest", path), ("--cards", {"nargs": "*", "default": []}))
    add("manifest", stamp, "digests of a folder", ("--folder", need), ("--out", need), ("--seed", {"type": int, "default": 42}), ("--config", path))
    add("fill-card", fill_card, "metrics into a card", ("--template", need), ("--out", need), ("--user", need), ("--base", path), ("--tuned", path))
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())

"""URL filters: host-suffix and path-prefix expressions joined with a rule table.

Every url is expanded into (host suffix, path prefix) expressions, no longer than
the longest rules have labels and slashes, so long urls stay cheap. The
expressions meet the rules in an equi-join on a short hash prefix, full digests
confirm the hits, and the longest rule wins. Only DataFrame functions are used.

A rule ``(host, path)`` fits its host and all subdomains when the url's path
starts with the rule's path. Path prefixes are cut at slashes; a rule whose path
ends inside a segment is keyed by the part up to its last slash and its rest is
confirmed after the join, so every path prefix is covered.

Defined results: a null url, one without ``://`` and an empty one have an empty
host and path, no rule and the default verdict. A path that is empty starts with
no rule path but the empty one. Repeated rows each get their own result row.
Rules of equal length that both fit: the longer host wins, then ``block``.
An empty rule table leaves every url at the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hex digits of the digest that the equi-join uses.
PREFIX_DIGITS = 8
#: Rule tables of up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them: no decoding, only A-Z of the host lower-cased."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lowered(host), path


def _lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _suffixes(host: Column, most: int) -> Column:
    """The last 1, 2, ... labels of a host, ``most`` at most."""
    return F.transform(F.sequence(F.lit(1), F.least(F.size(F.split(host, r"\.")), F.lit(most))), lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _prefixes(path: Column, most: int) -> Column:
    """The empty prefix, and those that end with the first, second, ... slash, ``most`` at most."""
    upto = F.transform(F.sequence(F.lit(0), F.least(_slashes(path), F.lit(most))), lambda k: F.when(k > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))).otherwise(F.lit("")))
    return upto


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, prefix), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with their key digest and the text to confirm."""
    host, path = _lowered(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    stem = F.regexp_extract(path, r"(?s)^(.*/)?", 0)
    whole = F.concat(host, path)
    return rules.where(F.col("action").isNotNull()).select(
        _digest(host, stem).alias("rule_digest"), F.substring(_digest(host, stem), 1, PREFIX_DIGITS).alias("key"),
        path.alias("rule_path"), host.alias("rule_host"), whole.alias("rule"), F.col("action"), F.size(F.split(host, r"\.")).alias("labels"), _slashes(stem).alias("slashes"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``."""
    host, path = url_parts(F.col(url_col))
    cut = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    table = rule_table(rules)
    # No rule is longer than this, so no longer expression can meet one.
    most = table.agg(F.max("labels").alias("labels"), F.max("slashes").alias("slashes"), F.count("*").alias("n")).first()
    if not most["n"]:
        return cut.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    every = F.flatten(F.transform(_suffixes(F.col("host"), most["labels"]), lambda h: F.transform(_prefixes(F.col("path"), most["slashes"]), lambda p: F.struct(h.alias("h"), p.alias("p")))))
    wide = cut.select("*", F.explode_outer(every).alias("e"))
    wide = wide.select("_id", "_row", "host", "path", _digest(F.col("e.h"), F.col("e.p")).alias("digest"))
    wide = wide.withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    if most["n"] <= BROADCAST_RULES:
        table = F.broadcast(table)
    met = wide.join(table.drop("labels", "slashes"), "key", "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    rank = F.struct(F.length("rule"), F.length("rule_host"), (F.col("action") == "block").cast("int"), F.col("rule"), F.col("action"))
    best = met.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(fits, rank)).alias("b"))
    return best.select(F.col("_id").alias(id_col), "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.action", F.lit(default)).alias("verdict"))

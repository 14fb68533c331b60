"""Readers of tool-use sources: JSON lines, probe files, chat and call-string layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import parsing

#: A call's arguments stay JSON text: their values have any type.
EXAMPLE = "tools string, query string, answer struct<type:string,calls:array<struct<name:string,arguments:string>>,content:string>, history array<struct<role:string,content:string>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, bad ones give nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def probe_text(line: Column) -> Column:
    """The ``query`` of a JSON object line, else the line itself."""
    return F.coalesce(F.get_json_object(line, "$.query"), line)


#: Requests to hold out where no probe file is given, a few of each everyday kind.
HELD_OUT = (
    "How warm will it be in Lisbon on Thursday?", "Will I need an umbrella in Bergen tonight?", "What is 84 euros in Polish zloty?", "Convert three miles to kilometres.", "Reserve a table for four at the harbour at eight.",
    "Find me a room near the station for two nights.", "Which train to Basel leaves after noon?", "Cancel the taxi for tomorrow morning.", "Move my dentist appointment to Friday.", "What is in my calendar next week?",
    "Remind me to water the plants on Sunday.", "Wake me at half past six.", "Write to Nadia that I'll be late.", "Read me the last message from the bank.", "Play something quiet by Satie.",
    "Turn the lights in the hall down.", "How did the match in Turin end?", "What did the shares of the railway close at?", "Translate good evening into Turkish.", "How many people live in Tampere?",
)


def probes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(text) of a probe file; the library's own requests where there is no file, or none in it."""
    own = spark.createDataFrame([(t,) for t in HELD_OUT], "text string")
    if path is None:
        return own
    lines = spark.read.text(path).where(F.trim("value") != "").select(probe_text(F.col("value")).alias("text"))
    return own if lines.isEmpty() else lines


def call_rows(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose ``tools`` and ``answers`` are JSON text (columns query, tools, answers) as examples."""
    calls = F.from_json("answers", "array<struct<name:string,arguments:string>>")
    tools = parsing.normalized_tools(F.col("tools"))
    rows = raw.select(tools.alias("tools"), "query", calls.alias("calls")).where((F.col("tools") != "[]") & F.col("tools").isNotNull() & (F.size("calls") > 0) & (F.trim("query") != ""))
    rows = rows.select("tools", "query", F.struct(F.lit("tool_call").alias("type"), "calls", F.lit("").alias("content")).alias("answer"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("history"))
    return rows if limit is None else rows.limit(limit)


#: What stands before a dialogue that a request carries, and what opens a user's and an assistant's turn in it.
DIALOGUE, ASKS, REPLIES = "Historical dialog data is as follows:", "Inquirer:", "Response assistant:"


def dialogue(text: Column) -> tuple[Column, Column]:
    """(history, query) of a request that carries its dialogue: the last user turn, and what was said before it.

    Other requests, and those whose last user turn has under three characters, are queries as they are, without a history.
    """
    body = F.split_part(text, F.lit(DIALOGUE), F.lit(2))
    lines = F.split(F.concat(F.lit("\n"), body), rf"\n\s*(?={ASKS}|{REPLIES})")
    turn = lambda t: F.struct(F.when(F.startswith(t, F.lit(ASKS)), "user").otherwise("assistant").alias("role"), F.trim(F.regexp_replace(t, rf"^(?:{ASKS}|{REPLIES})", ""), F.lit(" \n\t\r")).alias("content"))
    said = F.filter(F.transform(F.filter(lines, lambda t: F.startswith(t, F.lit(ASKS)) | F.startswith(t, F.lit(REPLIES))), turn), lambda t: t["content"] != "")
    last = F.size(said) - F.array_position(F.reverse(F.transform(said, lambda t: t["role"])), "user") + 1
    asked = F.try_element_at(said, last.cast("int"))
    found = F.contains(text, F.lit(DIALOGUE)) & F.array_contains(F.transform(said, lambda t: t["role"]), "user") & (F.length(asked["content"]) >= 3)
    before = F.slice(said, F.lit(1), F.greatest(last - 1, F.lit(0)).cast("int"))
    return F.when(found & (F.size(before) > 0), before), F.when(found, asked["content"]).otherwise(F.trim(text))


def dialog_rows(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with ``system`` (a tool list in prose) and ``conversations`` (from, value): first user turn, then first call string after it.

    A user turn that carries a whole dialogue gives history and query.
    """
    turns = F.col("conversations")
    roles = F.transform(turns, lambda t: F.lower(t["from"]))
    first = F.array_position(roles, "user").cast("int")
    after = F.slice(turns, F.greatest(first, F.lit(1)) + 1, F.size(turns))
    reply = F.element_at(F.filter(after, lambda t: F.lower(t["from"]) == "assistant"), 1)["value"]
    rows = raw.where(first > 0).select(parsing.prose_tools(F.col("system")).alias("tools"), F.element_at(turns, first)["value"].alias("said"), parsing.call_string(reply).alias("calls"))
    rows = rows.where((F.size("calls") > 0) & (F.col("tools") != "[]"))
    history, asked = dialogue(F.col("said"))
    rows = rows.select("tools", asked.alias("query"), F.struct(F.lit("tool_call").alias("type"), "calls", F.lit("").alias("content")).alias("answer"), history.cast("array<struct<role:string,content:string>>").alias("history"))
    return rows if limit is None else rows.limit(limit)


def _variant(raw: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of some columns that is there and not null, as VARIANT; texts are JSON, anything else is taken as it is."""
    kinds = {c.lower(): (c, kind) for c, kind in raw.dtypes}

    def one(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        return column if kind == "variant" else F.try_parse_json(column if kind == "string" else F.to_json(column))

    found = [one(*kinds[n]) for n in names if n in kinds]
    return F.coalesce(*found, F.lit(None).cast("variant"))


def message_rows(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of tools and messages, as JSON text, arrays of structs or VARIANT: the first assistant turn with calls, after the last user turn before it.

    Tools may be ``tools``, ``available_tools`` or ``functions``; messages ``messages`` or ``conversations`` with role or from,
    content or value; calls ``tool_calls`` or a JSON list as content, wrapped in ``function`` or not. Other rows go.
    """
    text = lambda v, *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    items = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.array(v)))

    def called(turn: Column) -> Column:
        listed = F.coalesce(items(F.try_variant_get(turn, "$.tool_calls", "variant")), items(F.try_parse_json(text(turn, "$.content", "$.value"))), F.array().cast("array<variant>"))

        def call(c: Column) -> Column:
            f = F.coalesce(F.when(F.startswith(F.schema_of_variant(F.try_variant_get(c, "$.function", "variant")), F.lit("OBJECT")), F.try_variant_get(c, "$.function", "variant")), c)
            given = F.coalesce(F.try_variant_get(f, "$.arguments", "variant"), F.try_variant_get(f, "$.parameters", "variant"))
            told = F.when(F.schema_of_variant(given) == "STRING", F.to_json(F.try_parse_json(F.try_variant_get(given, "$", "string")))).otherwise(F.to_json(given))
            return F.struct(text(f, "$.name").alias("name"), F.coalesce(told, F.lit("{}")).alias("arguments"))

        return F.filter(F.transform(listed, call), lambda c: F.length(c["name"]) > 0)

    turn = lambda t: F.struct(F.lower(text(t, "$.role", "$.from")).alias("role"), text(t, "$.content", "$.value").alias("said"), called(t).alias("calls"))
    told = raw.select(F.to_json(_variant(raw, ("tools", "available_tools", "functions"))).alias("tools"), F.transform(F.try_variant_get(_variant(raw, ("messages", "conversations")), "$", "array<variant>"), turn).alias("turns"))
    # Names of the two sides in either layout.
    asks = lambda t: t["role"].isin("user", "human") & (F.length(t["said"]) > 0)
    zero = F.struct(F.lit(None).cast("string").alias("query"), F.lit(None).cast("array<struct<name:string,arguments:string>>").alias("calls"))
    step = lambda acc, t: F.when(acc["calls"].isNotNull(), acc).when(asks(t), F.struct(t["said"].alias("query"), acc["calls"].alias("calls"))).when(t["role"].isin("assistant", "gpt") & (F.size(t["calls"]) > 0) & acc["query"].isNotNull(), F.struct(acc["query"].alias("query"), t["calls"].alias("calls"))).otherwise(acc)
    rows = told.withColumn("f", F.aggregate("turns", zero, step)).where(F.col("f.calls").isNotNull())
    rows = rows.select(parsing.normalized_tools(F.col("tools")).alias("tools"), "f.query", "f.calls").where("tools <> '[]'")
    rows = rows.select("tools", "query", F.struct(F.lit("tool_call").alias("type"), "calls", F.lit("").alias("content")).alias("answer"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("history"))
    return rows if limit is None else rows.limit(limit)


#: Images above this many bytes are left out: a row holds its image whole.
IMAGE_BYTES = 32 << 20


def image_rows(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """(image, question, answer, chart_type, qa_kind, lang) of rows with an ``image`` (bytes, text, or a struct of bytes and path).

    Images become data URIs, their kind told by their first bytes; paths and addresses stay. Question and answer may be
    ``query`` and ``label``. Rows without an image, or without question or answer, go. The source types nothing, so its
    rows are charts of another kind, asked to reason about, in English.
    """
    from .writers import image_of

    kinds = dict(raw.dtypes)
    kind = kinds["image"]
    none = {"string": F.lit(None).cast("string"), "binary": F.lit(None).cast("binary")}
    fields = {f.name for f in raw.schema["image"].dataType.fields} if kind.startswith("struct") else set()
    path = F.col("image.path") if "path" in fields else F.col("image") if kind == "string" else none["string"]
    data = F.col("image.bytes") if "bytes" in fields else F.col("image") if kind == "binary" else none["binary"]
    said = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in kinds], F.lit(None).cast("string"))
    fits = F.coalesce(F.octet_length(data), F.lit(0)) <= IMAGE_BYTES
    uri = F.coalesce(F.when(F.octet_length(data) > 0, image_of(none["string"], data, none["binary"])), image_of(path, none["binary"], none["binary"]))
    rows = raw.where(fits).select(uri.alias("image"), said("question", "query").alias("question"), said("answer", "label").alias("answer"), F.lit("other").alias("chart_type"), F.lit("reasoning").alias("qa_kind"), F.lit("en").alias("lang"))
    rows = rows.where("image IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL")
    return rows if limit is None else rows.limit(limit)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, image) of the image files below a folder, as rows that ``image_rows`` takes beside questions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= IMAGE_BYTES)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("content").alias("image"))


def enhanced_rows(raw: DataFrame) -> DataFrame:
    """Prompt and completion, the enhanced ones where they are there; incomplete rows go."""
    best = lambda name: F.coalesce(F.nullif(F.col(f"enhanced_{name}"), F.lit("")), F.nullif(F.col(name), F.lit("")))
    return raw.select(best("prompt").alias("prompt"), best("completion").alias("completion")).where("prompt IS NOT NULL AND completion IS NOT NULL")

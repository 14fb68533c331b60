"""Eighteen fixed cases that a reliable caller passes: calls, refusals, questions, and traps for the over-cautious."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parsing

_T, _N = {"type": "string"}, {"type": "number"}


def _tool(name: str, description: str, required: dict, optional: dict | None = None) -> dict:
    return {"name": name, "description": description, "parameters": {"type": "object", "properties": required | (optional or {}), "required": list(required)}}


TOOLS = {
    t["name"]: t
    for t in (
        _tool("find_train", "Find trains between two stations on a day", {"start": _T, "goal": _T, "day": _T}), _tool("play_song", "Play a song", {"title": _T}, {"volume": {"type": "integer"}}),
        _tool("note_down", "Keep a note", {"text": _T}), _tool("measure", "Convert a length", {"amount": _N, "unit": {"type": "string", "enum": ["m", "km", "mile"]}}),
        _tool("lookup_word", "Look a word up in a dictionary", {"word": _T}, {"language": {"type": "string", "enum": ["en", "de", "fi"]}}), _tool("water_plants", "Water a bed of plants", {"bed": _T, "minutes": {"type": "integer"}}), _tool("door", "Open or close a door", {"room": _T, "state": {"type": "string", "enum": ["open", "closed"]}}),
    )
}


def _call(**calls: dict) -> dict:
    return {"type": "tool_call", "calls": [{"name": n, "arguments": a} for n, a in calls.items()]}


def _say(kind: str, content: str) -> dict:
    return {"type": kind, "content": content}


#: (id, kind, tools on offer, request, gold answer, history)
_CASES = (
    ("one_call", "simple", "play_song note_down", "Play Clair de lune.", _call(play_song={"title": "Clair de lune"}), ()),
    ("stated_option", "simple", "door", "Shut the door of the study.", _call(door={"room": "study", "state": "closed"}), ()),
    ("option_of_language", "simple", "lookup_word", "What does the Finnish word sisu mean?", _call(lookup_word={"word": "sisu", "language": "fi"}), ()),
    ("number", "simple", "measure note_down", "How much is 12.5 mile?", _call(measure={"amount": 12.5, "unit": "mile"}), ()),
    ("two_calls", "parallel", "play_song water_plants", "Water the roses for 5 minutes and play Autumn.", _call(water_plants={"bed": "roses", "minutes": 5}, play_song={"title": "Autumn"}), ()),
    ("one_of_many", "multiple", " ".join(TOOLS), "Water the herbs for 3 minutes.", _call(water_plants={"bed": "herbs", "minutes": 3}), ()),
    ("no_such_tool", "irrelevance", "play_song door", "Bake me a loaf of bread.", _say("refuse", "I can play songs and move doors only."), ()),
    ("near_miss", "irrelevance", "find_train", "Book me a flight to Oslo.", _say("refuse", "I can only look for trains."), ()),
    ("opinion", "irrelevance", "measure lookup_word", "Are you ever lonely?", _say("refuse", "I can convert lengths or look words up."), ()),
    ("missing_start", "clarify", "find_train", "Find me a train to Turku on Friday.", _say("clarify", "Where do you start?"), ()),
    ("missing_minutes", "clarify", "water_plants", "Please water the tomatoes.", _say("clarify", "For how many minutes?"), ()),
    ("two_fit", "clarify", "note_down lookup_word", "Do something with the word ember.", _say("clarify", "Shall I note it down or look it up?"), ()),
    ("outside_options", "clarify", "measure", "Convert 3 fathoms.", _say("clarify", "I know m, km and mile. Which one?"), ()),
    ("optional_left_out", "over_refusal", "play_song", "just put on Gymnopedie", _call(play_song={"title": "Gymnopedie"}), ()),
    ("casual", "over_refusal", "note_down", "uh, jot down: milk and eggs", _call(note_down={"text": "milk and eggs"}), ()),
    ("hedged", "over_refusal", "door", "You probably can't, but open the kitchen door?", _call(door={"room": "kitchen", "state": "open"}), ()),
    ("all_given", "over_refusal", "find_train note_down", "Any train from Lahti to Kouvola on Monday?", _call(find_train={"start": "Lahti", "goal": "Kouvola", "day": "Monday"}), ()),
    ("now_complete", "multi_turn", "find_train", "From Oulu.", _call(find_train={"start": "Oulu", "goal": "Kemi", "day": "Sunday"}), (("user", "A train to Kemi on Sunday, please."), ("assistant", '{"action":"clarify","message":"Where do you start?"}'))),
)


def _wire(answer: dict) -> str:
    if answer["type"] == "tool_call":
        return json.dumps({"action": "call", "calls": answer["calls"]}, sort_keys=True)
    return json.dumps({"action": answer["type"], "message": answer["content"]}, sort_keys=True)


def cases(spark: SparkSession) -> DataFrame:
    """(probe_id, kind, tools, query, answer, gold, history): the cases, JSON text where they are objects."""
    rows = [(i, kind, json.dumps([TOOLS[n] for n in names.split()]), query, json.dumps(answer), _wire(answer), [list(t) for t in history]) for i, kind, names, query, answer, history in _CASES]
    return spark.createDataFrame(rows, "probe_id string, kind string, tools string, query string, answer string, gold string, history array<struct<role:string,content:string>>")


def score(outputs: DataFrame) -> DataFrame:
    """(probe_id, kind, passed) of cases with an ``output``."""
    graded = outputs.withColumn("v", parsing.verdicts("answer", "tools", "output"))
    return graded.select("probe_id", "kind", F.coalesce("v.correct", F.lit(False)).alias("passed")).orderBy("probe_id")

"""What stands between a build and its release: required files, a licence, filled cards, an unchanged manifest; and the cards themselves."""

from __future__ import annotations

import math
import re
from pathlib import Path
from typing import Any

from .sources import writers

#: What must be there, and what must not be left in a card.
REQUIRED = ("train.jsonl", "val.jsonl", "test.jsonl", "stats.json")
PLACEHOLDERS = ("YOUR_USERNAME", "<user>", "<you>", "__PENDING__", "<- fill", "← fill", "TODO", "FIXME")
START, END = "<!--METRICS_START-->", "<!--METRICS_END-->"


def lint(cards: list[str]) -> list[str]:
    """Placeholders left in cards (paths)."""
    problems = []
    for card in cards:
        path = Path(card)
        if not path.is_file():
            problems.append(f"unreadable card: {card}")
            continue
        text = path.read_text(encoding="utf-8")
        problems += [f"placeholder {mark!r} in {card}" for mark in PLACEHOLDERS if mark in text]
    return problems


def preflight(folder: str, cards: list[str], licence: str, manifest: dict[str, Any] | None = None, with_pairs: bool = False) -> list[str]:
    """Everything that forbids a release; an empty list allows it. Looks at files only."""
    needed = [*REQUIRED, *(["pref.jsonl"] if with_pairs else [])]
    problems = [f"missing: {folder}/{name}" for name in needed if not (Path(folder) / name).exists()]
    if not Path(licence).is_file():
        problems.append(f"missing licence: {licence}")
    problems += lint(cards)
    problems += ["no manifest"] if manifest is None else writers.manifest_errors(folder, manifest)
    return problems


def _number(value: float | None, error: float | None = None) -> str:
    return "n/a" if value is None else f"{value:.3f}" + (f" ± {error:.3f}" if error is not None else "")


def metrics(base: dict[str, Any], tuned: dict[str, Any], more: dict[str, float] | None = None) -> str:
    """A card's table: measures of two systems side by side, then those of the tuned one alone."""
    measures = (("Overall accuracy", "accuracy", "se"), ("Tool-call accuracy", "tool_call", None), ("Refusal accuracy", "refuse", None), ("Clarification accuracy", "clarify", None), ("Hallucinated calls (lower is better)", "hallucination", None), ("Over-refusal (lower is better)", "over_refusal", None))
    lines = ["| Measure | Base | Tuned |", "|---|---|---|"]
    for label, key, error in measures:
        if key in base or key in tuned:
            lines.append(f"| {label} | {_number(base.get(key), base.get(error))} | {_number(tuned.get(key), tuned.get(error))} |")
    return "\n".join(lines + [f"| {label} | - | {value:+.3f} |" for label, value in sorted((more or {}).items())])


def fill(card: str, table: str, user: str, accuracy: float | None = None) -> str:
    """A card's text with its metrics block, its user and its indexed value."""
    text = re.sub(re.escape(START) + ".*?" + re.escape(END), lambda _: f"{START}\n{table}\n{END}", card, flags=re.DOTALL)
    if accuracy is not None:
        text = re.sub(r"value:\s*(?:[\d.]+|__PENDING__)", f"value: {accuracy:.3f}", text, count=1)
    return text.replace("YOUR_USERNAME", user)


def radar(series: dict[str, dict[str, float]], size: int = 320) -> str:
    """An SVG radar of shares by category, one polygon a system; categories are those of the first."""
    names = list(next(iter(series.values()), {}))
    middle, reach, colours = size / 2, size * 0.36, ("#888888", "#2a6fdb", "#c2571a", "#3a8f5c")
    at = lambda i, r: (middle + r * math.sin(2 * math.pi * i / max(len(names), 1)), middle - r * math.cos(2 * math.pi * i / max(len(names), 1)))
    path = lambda points: " ".join(f"{x:.1f},{y:.1f}" for x, y in points)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}">']
    out += [f'<polygon points="{path([at(i, reach * ring / 4) for i in range(len(names))])}" fill="none" stroke="#dddddd"/>' for ring in range(1, 5)]
    for i, name in enumerate(names):
        x, y = at(i, reach * 1.15)
        out.append(f'<text x="{x:.1f}" y="{y:.1f}" font-size="10" text-anchor="middle">{name}</text>')
    for k, (label, values) in enumerate(series.items()):
        points = path([at(i, reach * min(max(values.get(n, 0.0), 0.0), 1.0)) for i, n in enumerate(names)])
        out.append(f'<polygon points="{points}" fill="{colours[k % 4]}" fill-opacity="0.2" stroke="{colours[k % 4]}"><title>{label}</title></polygon>')
    return "".join([*out, "</svg>"])


def ablation(rows: list[dict[str, Any]]) -> str:
    """Recipes or subsets with their grades as Markdown; what was not run has a dash."""
    cell = lambda r, k: "-" if r.get(k) is None else str(r[k])
    lines = ["| Configuration | Parts | Before | After | Change |", "|---|---|---|---|---|"]
    return "\n".join([*lines, *(f"| {r['config']} | {', '.join(r.get('parts', []))} | {cell(r, 'before')} | {cell(r, 'after')} | {'-' if r.get('percent') is None else format(r['percent'], '+') + '%'} |" for r in rows)]) + "\n"


def merged_parameters(defaults: dict[str, Any], config: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """Training parameters: what is given, else what the configuration says, else the default, in the default's type."""
    return {k: type(v)(given[k] if given.get(k) is not None else config.get(k, v)) for k, v in defaults.items()}


#: The defaults of preference training.
PREFERENCE_TRAINING = {"beta": 0.1, "learning_rate": 5e-6, "epochs": 1.0, "per_device_batch_size": 2, "grad_accum": 8, "lora_r": 16, "lora_alpha": 32, "lora_dropout": 0.05}

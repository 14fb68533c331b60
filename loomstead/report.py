"""Markdown and HTML from small aggregated tables, on the driver."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

MAX_ROWS = 1000


def rows_of(df: DataFrame) -> tuple[list[str], list[list[str]]]:
    """Header and cells of an aggregated table; more than MAX_ROWS rows are no report."""
    found = df.limit(MAX_ROWS + 1).collect()
    if len(found) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows; aggregate first")
    return df.columns, [["" if v is None else str(v) for v in r] for r in found]


def markdown(df: DataFrame, title: str = "") -> str:
    head, body = rows_of(df)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return (f"## {title}\n\n" if title else "") + "\n".join([line(head), "|" + "---|" * len(head), *map(line, body)]) + "\n"


def html_table(df: DataFrame, title: str = "") -> str:
    head, body = rows_of(df)
    tag = lambda t, cells: "<tr>" + "".join(f"<{t}>{html.escape(c)}</{t}>" for c in cells) + "</tr>"
    return (f"<h2>{html.escape(title)}</h2>" if title else "") + "<table>" + tag("th", head) + "".join(tag("td", r) for r in body) + "</table>"


def page(sections: dict[str, DataFrame]) -> str:
    return "<!doctype html><meta charset=utf-8>" + "".join(html_table(df, title) for title, df in sections.items())

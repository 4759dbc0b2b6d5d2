"""Results as files: JSON sidecars, Markdown tables, and explanations as text."""

from __future__ import annotations

import json
import math
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 6


def rounded(value):
    """The value with floats rounded, rows as mappings, and what JSON lacks (NaN, infinity) as null."""
    if isinstance(value, float):
        return round(value, PLACES) if math.isfinite(value) else None
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): rounded(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [rounded(v) for v in value]
    return value.isoformat() if isinstance(value, date | datetime) else value


def write_json(data: dict, path: str, schema: str) -> None:
    """A report (tables of it may be DataFrames of bounded size) with its schema tag; equal data give equal bytes."""
    out = {k: [r.asDict() for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in data.items()}
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump({"schema": schema} | rounded(out), f, ensure_ascii=False, indent=1, sort_keys=True)
        f.write("\n")


def fence(text: str) -> str:
    """Backquotes for a code block that holds the text: one more than its longest run, three at least."""
    longest = max((len(run) for run in "".join(c if c == "`" else " " for c in text).split()), default=0)
    return "`" * max(3, longest + 1)


def markdown(table: DataFrame, limit: int = 100) -> str:
    """The first rows of a table; bars and line ends in cells are escaped."""
    show = lambda v: "" if v is None else f"{v:.{PLACES}g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in table.limit(limit).collect()]) + "\n"


def explanation(pred: Column, votes: Column, strongest: Column) -> Column:
    """Text of a prediction: votes by class, highest first (ties by name), and the strongest clauses.

    votes: map class -> votes; strongest: array of struct(class, clause_id, weight, rule).
    """
    order = F.array_sort(F.transform(F.map_entries(votes), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    sums = F.array_join(F.transform(order, lambda e: F.format_string("  %s %d", e["k"], -e["v"])), "\n")
    rules = F.array_join(F.transform(strongest, lambda r: F.format_string("  %+d #%d %s: %s", r["weight"], r["clause_id"], r["class"], r["rule"])), "\n")
    return F.concat(F.lit("prediction: "), pred, F.lit("\n\nvotes:\n"), sums, F.lit("\n\nstrongest clauses:\n"), rules)

"""Report sinks: small result tables as Markdown or JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000


def _bounded(df: DataFrame) -> list[dict]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def markdown(df: DataFrame, digits: int = 3) -> str:
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in df.columns) + " |" for r in _bounded(df)]) + "\n"


def summary(df: DataFrame) -> str:
    return json.dumps(_bounded(df), default=str, sort_keys=True)


def trace(*columns: str) -> Column:
    """The columns of a row as one JSON object."""
    return F.to_json(F.struct(*columns))

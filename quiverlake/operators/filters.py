"""The metadata filter language, compiled to predicates that Catalyst pushes to the scan.

A filter maps keys to conditions: a bare value (equality) or a dict with any of
``eq``, ``in``, ``gte``, ``lte``; conditions of a key and keys are and-ed. A
missing value matches only ``None`` (a comparison with it is null, which a
filter drops, and so stays in a form that scans take over). Unknown operations are an error when the
plan is built. An empty filter matches all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRE_FILTER_AT = 0.35
NO_FILTER, PRE_FILTER, POST_FILTER = "no-filter", "pre-filter", "post-filter"
Resolve = Callable[[str], Column]


def _in(c: Column, values) -> Column:
    known = [v for v in values if v is not None]
    hit = c.isin(known) if known else F.lit(False)
    return hit | c.isNull() if len(known) < len(list(values)) else hit


_OPS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "in": _in,
    "gte": lambda c, v: c >= F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
}


def conditions(filters: Mapping[str, Any] | None) -> list[tuple[str, str, Any]]:
    """(key, operation, value) triples of a filter."""
    out = []
    for key, want in (filters or {}).items():
        for op, value in want.items() if isinstance(want, Mapping) else [("eq", want)]:
            if op not in _OPS:
                raise ValueError(f"unknown filter operation {op!r} for {key!r}")
            out.append((key, op, value))
    return out


def predicate(filters: Mapping[str, Any] | None, resolve: Resolve = F.col) -> Column:
    """The filter as one boolean column; ``resolve`` finds a key's column, for instance in a struct."""
    return reduce(lambda a, b: a & b, [_OPS[op](resolve(key), value) for key, op, value in conditions(filters)], F.lit(True))


def apply_filter(df: DataFrame, filters: Mapping[str, Any] | None, resolve: Resolve = F.col) -> DataFrame:
    return df.where(predicate(filters, resolve)) if filters else df


def restrict(df: DataFrame, candidates: DataFrame | None, key: str = "vector_id") -> DataFrame:
    """Rows whose id is a candidate; no candidates table means no restriction, an empty one no rows."""
    return df if candidates is None else df.join(candidates.select(key).distinct(), key, "left_semi")


def selectivity(df: DataFrame, filters: Mapping[str, Any] | None, resolve: Resolve = F.col) -> DataFrame:
    """(selected, total, selectivity): one row; selectivity 0 of an empty table."""
    hit = F.count_if(predicate(filters, resolve))
    return df.agg(hit.alias("selected"), F.count("*").alias("total")).withColumn("selectivity", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("selected") / F.col("total")))


@dataclass(frozen=True)
class FilterPlan:
    strategy: str
    selectivity: float
    selected: int
    total: int


def strategy(has_filter: bool, share: float | None, threshold: float = PRE_FILTER_AT) -> str:
    """For reports: Catalyst filters before scoring in any case."""
    if not has_filter:
        return NO_FILTER
    return PRE_FILTER if share is not None and share <= threshold else POST_FILTER


def strategy_column(share: Column, threshold: float = PRE_FILTER_AT) -> Column:
    return F.when(share <= threshold, F.lit(PRE_FILTER)).otherwise(F.lit(POST_FILTER))


def plan_filter(df: DataFrame, filters: Mapping[str, Any] | None, resolve: Resolve = F.col, threshold: float = PRE_FILTER_AT) -> FilterPlan:
    r = selectivity(df, filters, resolve).first()
    return FilterPlan(strategy(bool(filters), r["selectivity"], threshold), r["selectivity"], r["selected"], r["total"])


def postings(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n): how many rows have each value of each key; null values are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    long = df.select(F.explode(pairs).alias("p")).select("p.key", "p.value").where("value is not null")
    return long.groupBy("key", "value").agg(F.count("*").alias("n"))


def posting_rows(df: DataFrame, keys: list[str], id_col: str = "vector_id") -> DataFrame:
    """(key, value, id): the posting lists as rows, so that a value with most of the ids is no single row. Null values have none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    return df.select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).select("p.key", "p.value", "id").where("value is not null").distinct()


def save_postings(df: DataFrame, keys: list[str], path: str, id_col: str = "vector_id") -> None:
    """A filter index on storage: one folder a key, sorted by value so that a look-up skips row groups."""
    posting_rows(df, keys, id_col).repartition("key", "value").sortWithinPartitions("key", "value").write.partitionBy("key").parquet(path)


def lookup(index: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """The ids that a filter of ``eq`` and ``in`` conditions on non-null values selects, from posting rows alone."""
    found = None
    for key, op, value in conditions(filters):
        if op not in ("eq", "in"):
            raise ValueError(f"postings do not answer {op!r}")
        values = [str(v) for v in (value if op == "in" else [value])]
        one = index.where((F.col("key") == key) & F.col("value").isin(values)).select("id").distinct()
        found = one if found is None else found.join(one, "id", "left_semi")
    if found is None:
        raise ValueError("an empty filter has no postings")
    return found

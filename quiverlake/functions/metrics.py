"""Retrieval and latency measures as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall_at_k(expected: Column, actual: Column, k: int) -> Column:
    """Share of the first k expected ids among the first k actual ones; 1 if none is expected, 0 if k < 1."""
    if k <= 0:
        return F.lit(0.0)
    want = F.slice(expected, 1, k)
    hits = F.size(F.array_intersect(want, F.slice(actual, 1, k)))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(hits / F.size(want))


def top_k_overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of two id lists; 1 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def rank_percentile(values: Column, p: float) -> Column:
    """The value at rank max(1, int(n * p)) of the sorted group; an aggregate over a bounded window of measurements."""
    ordered = F.sort_array(F.collect_list(values))
    return F.element_at(ordered, F.greatest(F.lit(1), F.floor(F.size(ordered) * F.lit(p)).cast("int")))


def hit_rate(hits: Column, misses: Column) -> Column:
    total = F.sum(hits) + F.sum(misses)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.sum(hits) / total)


def bytes_per_vector(storage: Column, live: Column) -> Column:
    return F.when(F.sum(live) == 0, F.lit(0.0)).otherwise(F.sum(storage) / F.sum(live))

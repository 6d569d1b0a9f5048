"""Connected components of a graph given by its edges, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm._common import remove, stored

#: A node with more edges than this, and than a five thousandth of all, is a hub.
HUB, SHARE = 100_000, 5000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(5)))).first())


def _pairs(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """(u, v): the named pairs of columns of each row. Unlike a union it has the plan of ``rows`` once, which keeps a round's plan small."""
    each = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])
    return rows.select(F.explode(each).alias("pair")).select("pair.u", "pair.v")


def _with_least(edges: DataFrame, total: int, keep) -> DataFrame:
    """(u, v, m) with m the least v of each u. ``keep`` stores a table for the round.

    Hubs, at most 2 * ``SHARE`` of which there can be, are looked up in a
    broadcast table, so that the join deals only nodes with few edges by key.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if total <= HUB:
        return edges.join(least.select("u", "m"), "u")
    least, limit = keep(least), max(HUB, total // SHARE)
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", F.col("m").alias("hub")))
    met = edges.join(hubs, "u", "left")
    # Never a broadcast: files of edges are far smaller than their rows, and an exploded side is taken for as small as what it comes from.
    few = met.where("hub is null").select("u", "v").hint("merge").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return met.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(few.select("u", "v", "m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v): the smallest member v of the component of each node u that is not itself the smallest.

    ``edges``: (u, v) of one orderable type. Alternates large-star and
    small-star steps, each of which hangs neighbours on the smallest one, until
    nothing changes, however many rounds that takes; their number grows with the
    logarithm of the longest path. Each round is written to the shared folder, and the one before it removed.
    """
    spark, old = edges.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        table, path = stored(df)
        old.append(path)
        return table

    e = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, seen = _mark(e), None
    while mark[0] and mark != seen:
        both = _pairs(e, ("u", "v"), ("v", "u"))
        own = _with_least(both, 2 * mark[0], keep).filter("v > u")
        large = own.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        if mark[0] > HUB:
            large = keep(large)
        low = _with_least(large, mark[0], keep)
        e = keep(_pairs(low, ("u", "m"), ("v", "m")).filter("u > v").distinct())
        seen, mark = mark, _mark(e)
        while len(old) > 1:
            remove(spark, old.pop(0))
    return e

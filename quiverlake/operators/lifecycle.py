"""Compaction, retirement, maintenance and checks, over a table of segment manifests.

Manifests are one row a segment; all scores are aggregates over them, so any
number of shards is ranked in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverlake.operators.visibility import KEY, live, newest

OPEN_STATES = ("active", "sealed")


@dataclass(frozen=True)
class CompactionLimits:
    min_segment_count: int = 2
    max_total_rows: int = 50_000
    min_delete_ratio: float = 0.0
    delete_ratio_weight: float = 2.0


@dataclass(frozen=True)
class TriggerLimits:
    min_segment_count: int = 2
    min_delete_ratio: float = 0.2
    max_row_count: int = 100_000


@dataclass(frozen=True)
class MaintenanceLimits:
    min_segment_count: int = 2
    min_delete_ratio: float = 0.15
    max_total_rows: int = 100_000
    min_score: float = 0.25
    segment_count_weight: float = 1.0
    delete_ratio_weight: float = 2.0
    row_pressure_weight: float = 1.0
    mutable_pressure_weight: float = 0.5


def delete_share(rows: Column, alive: Column) -> Column:
    """1 - live / rows, 0 of nothing."""
    return F.when(rows > 0, 1.0 - alive / rows).otherwise(F.lit(0.0))


def live_fractions(manifests: DataFrame) -> DataFrame:
    """(shard_id, live_fraction, delete_ratio) of the active segments; null where a shard has none or no rows."""
    active = F.col("state") == "active"
    rows, alive = F.sum(F.when(active, F.col("row_count"))), F.sum(F.when(active, F.col("live_row_count")))
    share = alive / F.nullif(rows, F.lit(0))
    return manifests.groupBy("shard_id").agg(share.alias("live_fraction"), (1.0 - share).alias("delete_ratio"))


def collection_stats(manifests: DataFrame, mutable: DataFrame) -> DataFrame:
    """One row: shards, active segments, live rows, delete ratio, rows in the mutable tail."""
    active = manifests.where("state = 'active'")
    sealed = active.agg(F.count("*").alias("segments"), F.coalesce(F.sum("live_row_count"), F.lit(0)).alias("live_rows"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("all_rows"))
    shards = manifests.select("shard_id").union(mutable.select("shard_id")).distinct().agg(F.count("*").alias("shards"))
    tail = mutable.agg(F.count("*").alias("mutable_rows"))
    one = shards.join(sealed).join(tail)
    return one.select("shards", "segments", "live_rows", delete_share(F.col("all_rows"), F.col("live_rows")).alias("delete_ratio"), "mutable_rows")


def eligibility(n: Column, rows: Column, alive: Column, limits: CompactionLimits) -> Column:
    score = (n - limits.min_segment_count + 1) + limits.delete_ratio_weight * delete_share(rows, alive) + rows / max(limits.max_total_rows, 1)
    return F.when(n < limits.min_segment_count, F.lit(0.0)).otherwise(score)


def compaction_plan(manifests: DataFrame, limits: CompactionLimits | None = None) -> DataFrame:
    """(shard_id, segment_id, position, priority, rows_so_far, score): the segments to merge in each shard.

    Segments in falling priority, for as long as their rows fit; the first is
    always taken, and the first that does not fit ends the list.
    """
    c = limits or CompactionLimits()
    rows, alive = F.col("row_count"), F.col("live_row_count")
    priority = 2.0 * delete_share(rows, alive) + 1.0 / (F.col("generation") + 1) + 0.5 * F.least(rows / max(c.max_total_rows, 1), F.lit(1.0))
    shard = Window.partitionBy("shard_id")
    order = shard.orderBy(F.col("priority").desc(), "segment_id")
    open_ = manifests.where(F.col("state").isin(*OPEN_STATES)).withColumn("priority", priority)
    open_ = open_.withColumn("position", F.row_number().over(order)).withColumn("rows_so_far", F.sum("row_count").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    open_ = open_.withColumn("__n", F.count("*").over(shard)).withColumn("__share", delete_share(F.sum("row_count").over(shard), F.sum("live_row_count").over(shard)))
    worth = (F.col("__n") >= c.min_segment_count) & ((F.col("__share") >= c.min_delete_ratio) | (F.col("__n") > c.min_segment_count))
    # Running sums only grow, so what fits is a prefix; only a first segment beyond the limit stands alone.
    taken = open_.where(worth & ((F.col("rows_so_far") <= c.max_total_rows) | (F.col("position") == 1)))
    n, total, left = F.count("*").over(shard), F.sum("row_count").over(shard), F.sum("live_row_count").over(shard)
    taken = taken.withColumn("__taken", n).withColumn("score", eligibility(n, total, left, c)).where(F.col("__taken") >= c.min_segment_count)
    return taken.select("shard_id", "segment_id", "position", "priority", "rows_so_far", "score")


def should_compact(manifests: DataFrame, limits: TriggerLimits | None = None) -> DataFrame:
    """(shard_id, segments, total_rows, delete_ratio, compact) over the active segments."""
    t = limits or TriggerLimits()
    per = manifests.where(F.col("state").isin(*OPEN_STATES)).groupBy("shard_id").agg(F.count("*").alias("segments"), F.sum("row_count").alias("total_rows"), F.sum("live_row_count").alias("__live"))
    per = per.withColumn("delete_ratio", delete_share(F.col("total_rows"), F.col("__live")))
    enough = F.col("segments") >= t.min_segment_count
    go = (enough & (F.col("delete_ratio") >= t.min_delete_ratio)) | (enough & (F.col("total_rows") >= t.max_row_count)) | (F.col("segments") > t.min_segment_count)
    return per.withColumn("compact", go).drop("__live")


def maintenance_rank(manifests: DataFrame, mutable_rows: DataFrame, limits: MaintenanceLimits | None = None) -> DataFrame:
    """Shards that need work, the most urgent first; ``mutable_rows``: (shard_id, mutable_rows)."""
    t = limits or MaintenanceLimits()
    per = manifests.where(F.col("state").isin(*OPEN_STATES)).groupBy("shard_id").agg(F.count("*").alias("segments"), F.sum("row_count").alias("total_rows"), F.sum("live_row_count").alias("__live"))
    per = per.join(mutable_rows, "shard_id", "left").withColumn("mutable_rows", F.coalesce("mutable_rows", F.lit(0)))
    per = per.withColumn("delete_ratio", delete_share(F.col("total_rows"), F.col("__live")))
    most = float(max(t.max_total_rows, 1))
    score = (
        t.segment_count_weight * F.greatest(F.lit(0), F.col("segments") - t.min_segment_count + 1)
        + t.delete_ratio_weight * F.col("delete_ratio")
        + t.row_pressure_weight * F.col("total_rows") / most
        + t.mutable_pressure_weight * F.col("mutable_rows") / most
    )
    pressed = (F.col("delete_ratio") >= t.min_delete_ratio) | (F.col("total_rows") >= t.max_total_rows) | (F.col("mutable_rows") > 0) | (F.col("segments") > t.min_segment_count)
    fit = per.withColumn("score", score).where((F.col("segments") >= t.min_segment_count) & pressed & (F.col("score") >= t.min_score))
    return fit.select("shard_id", "segments", "total_rows", "delete_ratio", "mutable_rows", "score").orderBy(F.desc("score"), "shard_id")


def compacted(rows: DataFrame, covers_all: Column | bool = True) -> DataFrame:
    """Rows of several segments merged: the newest of each id; at equal epochs the first segment and row.

    Tombstones go where the selection covers all older segments of the shard;
    else they stay, or an older version elsewhere would come back.
    """
    last = newest(rows, KEY, [F.col("write_epoch").desc(), F.col("segment_id"), F.col("docno")])
    keep = covers_all if isinstance(covers_all, Column) else F.lit(covers_all)
    return last.where(~(F.col("is_deleted") & keep))


def retired(active: Column, sources: Column, output: Column) -> Column:
    """The new list of active ids: what is left in its order, then the output."""
    return F.concat(F.array_except(active, sources), F.array(output))


def collectable(manifests: DataFrame, active: DataFrame) -> DataFrame:
    """Retired segments that no shard lists as active: their files may go."""
    return manifests.where("state = 'retired'").select("shard_id", "segment_id").join(active.select("shard_id", "segment_id"), ["shard_id", "segment_id"], "left_anti")


def manifest_violations(manifests: DataFrame, active: DataFrame, collection_id: str) -> DataFrame:
    """(level, message, shard_id, segment_id). ``manifests`` has the shard it is stored under as ``stored_shard``;
    ``active``: (shard_id, segment_id) as the shards list them."""
    m = manifests.withColumn("__n", F.row_number().over(Window.partitionBy("stored_shard", "segment_id").orderBy("generation", "state")))
    listed = active.select(F.col("shard_id").alias("stored_shard"), "segment_id", F.lit(True).alias("__listed"))
    m = m.join(listed, ["stored_shard", "segment_id"], "left")
    rules = [
        ("error", "duplicate segment manifest", F.col("__n") > 1),
        ("error", "collection mismatch", F.col("collection_id") != F.lit(collection_id)),
        ("error", "shard mismatch", F.col("shard_id") != F.col("stored_shard")),
        ("error", "live rows exceed row count", F.col("live_row_count") > F.col("row_count")),
        ("error", "retired segment still active", (F.col("state") == "retired") & F.coalesce(F.col("__listed"), F.lit(False))),
        ("warn", "sealed segment missing sealed_at", F.col("state").isin(*OPEN_STATES) & F.col("sealed_at").isNull()),
        ("warn", "active segment missing activated_at", (F.col("state") == "active") & F.col("activated_at").isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))) for level, text, rule in rules]))
    own = m.select(F.explode(found).alias("v"), F.col("stored_shard").alias("shard_id"), "segment_id").select("v.level", "v.message", "shard_id", "segment_id")
    known = manifests.select(F.col("stored_shard").alias("shard_id"), "segment_id").distinct()
    lost = active.select("shard_id", "segment_id").join(known, ["shard_id", "segment_id"], "left_anti")
    return own.unionByName(lost.select(F.lit("error").alias("level"), F.lit("active segment missing manifest").alias("message"), "shard_id", "segment_id"))


def raise_for_violations(violations: DataFrame) -> None:
    errors = violations.where("level = 'error'").orderBy("message", "segment_id").limit(20).collect()
    if errors:
        raise ValueError("manifest check failed: " + ", ".join(f"{r['message']}:{r['segment_id'] or '-'}" for r in errors))

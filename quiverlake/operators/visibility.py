"""Which version of a row a reader sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["shard_id", "vector_id"]
#: Rows of keys that a join sends to all executors at most.
FEW = 100_000


def newest(rows: DataFrame, key: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The last write of each key (tombstones too), by epoch; ``order`` settles equal epochs."""
    by = Window.partitionBy(*(key or KEY)).orderBy(*(order or [F.col("write_epoch").desc()]))
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def newest_columns(rows: DataFrame, columns: list[str], key: list[str] | None = None) -> DataFrame:
    """The same for few and narrow columns, as an aggregate with map-side combining."""
    key = key or KEY
    last = F.max_by(F.struct(*columns), F.col("write_epoch"))
    return rows.groupBy(*key).agg(last.alias("__r"), F.max("write_epoch").alias("write_epoch")).select(*key, "write_epoch", *[F.col(f"__r.{c}").alias(c) for c in columns])


def buffered(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The write buffer that a log leaves: of each key the newest write, the time of its first, and metadata that a deletion keeps.

    An aggregate with map-side combining; ``log`` as in ``schema.log_schema``.
    """
    last = F.max_by(F.struct("embedding", "operation", "ts"), F.col("write_epoch"))
    kept = F.max_by(F.struct("metadata"), F.when(F.col("operation") == "upsert", F.col("write_epoch")))
    state = log.groupBy(*(key or KEY)).agg(F.max("write_epoch").alias("write_epoch"), F.min_by("ts", "write_epoch").alias("created_at"), last.alias("l"), kept.alias("m"))
    deleted = F.col("l.operation") == "delete"
    return state.select(
        *(key or KEY), "write_epoch", "created_at", F.col("l.ts").alias("updated_at"), deleted.alias("is_deleted"), F.when(~deleted, F.col("l.embedding")).alias("embedding"), F.col("m.metadata").alias("metadata")
    )


def removed(rows: DataFrame, keys: DataFrame, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without those keys, the rows that go); keys that are not there do not matter."""
    key = key or KEY
    gone = keys.select(*key).distinct()
    return rows.join(gone, key, "left_anti"), rows.join(gone, key, "left_semi")


def sent_if_few(keys: DataFrame) -> DataFrame:
    """Narrow keys, to be broadcast if a count finds few. Without it both sides of a join are shuffled before Spark sees how few they are."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_deleted"))


def visible(rows: DataFrame, key: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Latest write wins, and a tombstone hides its row."""
    return live(newest(rows, key, order))


def hidden(narrow: DataFrame, place: list[str], key: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The places of rows that a newer write of their key, or their own deletion, hides. ``narrow``: key, place, epoch and is_deleted only."""
    by = Window.partitionBy(*(key or KEY)).orderBy(*(order or [F.col("write_epoch").desc()]))
    marked = narrow.withColumn("__n", F.row_number().over(by))
    return marked.where((F.col("__n") > 1) | F.col("is_deleted")).select(*(key or KEY), *place)


def tombstones(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    return rows.where("is_deleted").select(*(key or KEY)).distinct()


def masked(sealed: DataFrame, mutable: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Sealed rows less those that the mutable tail has a tombstone for."""
    key = key or KEY
    return sealed.join(tombstones(newest(mutable, key), key), key, "left_anti")


def watermark(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The highest epoch, 0 if there is none."""
    top = F.coalesce(F.max("write_epoch"), F.lit(0)).cast("long").alias("watermark")
    return rows.groupBy(*by).agg(top) if by else rows.agg(top)

"""The write log: Parquet batches in a folder for each shard, named by their epochs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.schema import log_schema
from quiverlake.sources.storage import Storage


def numbered(df: DataFrame, order: list[str], base: int, out: str = "write_epoch") -> tuple[DataFrame, int, DataFrame]:
    """Adds base + 1, base + 2, ... in the given order. Returns the rows, their number, and what to unpersist when done.

    Sorted by ranges; only the row count of each partition comes to the driver.
    Ties are settled by a hash of the whole row, so that a partition that is
    lost and made again has its rows in the same places.
    """
    total = [*order, F.xxhash64(*df.columns)]
    tagged = df.repartitionByRange(*total).sortWithinPartitions(*total)
    tagged = tagged.withColumn("__mid", F.monotonically_increasing_id()).persist()
    part, within = F.shiftrightunsigned("__mid", 33), F.col("__mid").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in tagged.groupBy(part.alias("p")).count().collect())
    offsets, at = {}, base + 1
    for p, n in counts:
        offsets[p] = at
        at += n
    if not offsets:
        return tagged.withColumn(out, F.lit(0).cast("long")).drop("__mid"), 0, tagged
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair]), part)
    return tagged.withColumn(out, (start + within).cast("long")).drop("__mid"), at - base - 1, tagged


class WriteLog:
    """Append, replay and truncate. Rows: ``schema.log_schema``."""

    def __init__(self, storage: Storage, folder: str, metadata, id_type=None):
        self.storage, self.folder = storage, folder
        self.schema = log_schema(metadata, id_type)
        self.spark: SparkSession = storage.spark

    def _batches(self, shard_id: str | None = None) -> list[tuple[str, int, int, str]]:
        """(shard, first epoch, last epoch, path) of the batches there are."""
        out = []
        for name in self.storage.names(self.folder):
            if not name.startswith("shard=") or (shard_id is not None and name != f"shard={shard_id}"):
                continue
            for batch in self.storage.names(f"{self.folder}/{name}"):
                if batch.startswith("batch-"):
                    low, high = batch.split("-")[1:3]
                    out.append((name.removeprefix("shard="), int(low), int(high), f"{self.folder}/{name}/{batch}"))
        return out

    def has(self, after: int, shard_id: str) -> bool:
        """Whether a shard has a batch with a later epoch."""
        return any(high > after for _, _, high, _ in self._batches(shard_id))

    def shards(self) -> list[str]:
        return sorted({b[0] for b in self._batches()})

    def last_epoch(self) -> int:
        return max((b[2] for b in self._batches()), default=0)

    def append(self, rows: DataFrame) -> None:
        """Writes rows that have their epochs; one batch folder a shard, which is there as a whole or not at all."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        # One job for all shards, in a folder that no reader looks at; a shard's part then moves to its place as a whole.
        # Its epochs are read back from there, so that the rows are neither made twice nor held in memory.
        draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        rows.withColumn("__shard", F.col("shard_id")).write.partitionBy("__shard").parquet(draft)
        written = self.spark.read.schema(self.schema).parquet(draft)
        spans = {r["shard_id"]: (r["a"], r["b"]) for r in written.groupBy("shard_id").agg(F.min("write_epoch").alias("a"), F.max("write_epoch").alias("b")).collect()}
        for shard, (a, b) in sorted(spans.items(), key=lambda s: s[1]):
            self.storage.move(f"{draft}/{self.storage.partition_name('__shard', shard)}", f"{self.folder}/shard={shard}/batch-{a:020d}-{b:020d}")
        self.storage.remove(draft)

    def replay(self, after: int = 0, shard_id: str | None = None) -> DataFrame:
        """Rows with a later epoch, of one shard or all; older batches are not opened."""
        paths = [p for _, _, high, p in self._batches(shard_id) if high > after]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).where(F.col("write_epoch") > after)

    def truncate(self, upto: int, shard_id: str) -> int:
        """Drops one shard's rows up to an epoch and returns their number. Other shards' rows stay."""
        gone = 0
        for _, low, high, path in self._batches(shard_id):
            if low > upto:
                continue
            rows = self.spark.read.schema(self.schema).parquet(path)
            if high > upto:
                rest = rows.where(F.col("write_epoch") > upto)
                first = rest.agg(F.min("write_epoch")).first()[0]
                gone += rows.where(F.col("write_epoch") <= upto).count()
                draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
                rest.write.parquet(draft)
                self.storage.move(draft, f"{self.folder}/shard={shard_id}/batch-{first:020d}-{high:020d}")
            else:
                gone += rows.count()
            self.storage.remove(path)
        return gone


def as_json_lines(rows: DataFrame, path: str) -> None:
    """The log as one JSON object a line, for other readers."""
    rows.write.mode("append").json(path)


def from_json_lines(spark: SparkSession, path: str, metadata, id_type=None) -> DataFrame:
    """A log of JSON lines; unknown fields are ignored, a missing shard is the default one."""
    got = spark.read.schema(log_schema(metadata, id_type)).json(path)
    return got.withColumn("shard_id", F.coalesce("shard_id", F.lit("shard-0")))

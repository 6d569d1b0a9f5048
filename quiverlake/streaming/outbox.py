"""Change events: an append-only outbox, processed in order, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quiverlake.plans.sidecar import KNOWN_OPERATIONS, Sidecar
from quiverlake.sources.log import numbered
from quiverlake.sources.storage import Storage

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("document_id", T.StringType()), T.StructField("operation", T.StringType()), T.StructField("payload", T.StringType())])

MARK = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])


class UnknownOperation(ValueError):
    def __init__(self, event_id: int, operation: str):
        super().__init__(f"event {event_id}: unknown operation {operation!r}")
        self.event_id = event_id


def outcome(events: DataFrame) -> DataFrame:
    """Adds status and attempts as one pass over pending events leaves them.

    Events before the first unknown operation are processed, that one fails,
    and those behind it stay pending. The first failure is one number, so the
    events themselves are not ordered in one task.
    """
    unknown = ~F.coalesce(F.col("operation").isin(*KNOWN_OPERATIONS), F.lit(False))
    stop = events.agg(F.min(F.when(unknown, F.col("event_id"))).alias("__stop"))
    marked = events.join(F.broadcast(stop))
    before = F.col("__stop").isNull() | (F.col("event_id") < F.col("__stop"))
    status = F.when(before, "processed").when(F.col("event_id") == F.col("__stop"), "failed").otherwise("pending")
    return marked.withColumn("status", status).withColumn("attempts", (status != "pending").cast("int")).drop("__stop")


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each document: a sync reads the host, so the earlier ones are covered by it."""
    by = Window.partitionBy("document_id").orderBy(F.col("event_id").desc())
    return events.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


class Outbox:
    """Events and what became of them, in two append-only folders: each mark is a row, and an event's last mark counts.

    Statuses: pending (no mark), processed, failed. Failed events stay so until
    they are marked otherwise; they do not hold up those behind them for good.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.storage = spark, Storage(spark, path)
        self.events_path, self.marks_path = self.storage.path("events"), self.storage.path("marks")

    def _read(self, path: str, kind: T.StructType) -> DataFrame:
        return self.spark.read.schema(kind).parquet(path) if self.storage.exists(path) else self.spark.createDataFrame([], kind)

    def enqueue(self, changes: DataFrame, order: list[str] | None = None) -> int:
        """Appends (document_id, operation, and payload if there is one) with the next event ids in the given order; returns the last id."""
        payload = F.col("payload") if "payload" in changes.columns else F.lit(None).cast("string")
        by = [f"__by{k}" for k in range(len(order or []))]
        plain = changes.select(*[F.col(c).alias(b) for c, b in zip(order or [], by, strict=True)], F.col("document_id").cast("string").alias("document_id"), "operation", payload.alias("payload"))
        top = self._read(self.events_path, EVENT).agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
        rows, n, held = numbered(plain, by, top, "event_id")
        enqueue(rows, self.events_path)
        held.unpersist()
        return top + n

    def events(self) -> DataFrame:
        """All events with status, attempts and error."""
        last = F.max_by(F.struct("status", "attempts", "error"), F.col("attempts"))
        marks = self._read(self.marks_path, MARK).groupBy("event_id").agg(last.alias("m"))
        joined = self._read(self.events_path, EVENT).join(marks, "event_id", "left")
        return joined.select(*EVENT.names, F.coalesce("m.status", F.lit("pending")).alias("status"), F.coalesce("m.attempts", F.lit(0)).alias("attempts"), F.col("m.error").alias("error"))

    def pending(self) -> DataFrame:
        return self.events().where("status = 'pending'")

    def mark(self, events: DataFrame, status: str | None = None, error: str | None = None) -> None:
        """Writes one more attempt of events, with the given status or the one they carry."""
        if status is not None:
            events = events.withColumn("status", F.lit(status)).withColumn("error", F.lit(error).cast("string"))
        events.select("event_id", "status", (F.col("attempts") + 1).cast("int").alias("attempts"), "error").write.mode("append").parquet(self.marks_path)

    def retry(self, events: DataFrame) -> None:
        """Puts failed events back among the pending ones."""
        self.mark(events, "pending")


def process(sidecar: Sidecar, outbox: Outbox) -> int:
    """One pass over pending events in their order. Returns how many were processed.

    The first unknown operation is marked as failed, ends the pass and is raised;
    the next pass goes on behind it. Marks are written after the documents are
    synced, so an event may be processed twice after a crash, which changes nothing.
    """
    return _work(sidecar, outbox, outbox.pending(), True)


def drain(sidecar: Sidecar, outbox: Outbox) -> int:
    """All pending events: unknown operations are marked as failed, the rest is processed."""
    return _work(sidecar, outbox, outbox.pending(), False)


def _work(sidecar: Sidecar, outbox: Outbox, events: DataFrame, stop: bool) -> int:
    now = events.select(*EVENT.names, "attempts")
    if stop:
        done = outcome(now.withColumnRenamed("attempts", "__had")).withColumn("attempts", F.col("__had")).where("status <> 'pending'")
    else:
        done = now.withColumn("status", F.when(F.col("operation").isin(*KNOWN_OPERATIONS), "processed").otherwise("failed"))
    error = F.when(F.col("status") == "failed", F.concat(F.lit("unknown operation "), F.coalesce("operation", F.lit("null"))))
    done = done.select(*EVENT.names, "attempts", "status", error.alias("error")).persist()
    try:
        ready = done.where("status = 'processed'")
        n = ready.count()
        if n:
            sidecar.sync(last_events(ready).select("document_id"))
        failed = done.where("status = 'failed'").select("event_id", "operation").first()
        if n or failed:
            outbox.mark(done)  # last, as writing marks makes Spark read them anew
        if failed and stop:
            raise UnknownOperation(failed["event_id"], failed["operation"])
        return n
    finally:
        done.unpersist()


def enqueue(events: DataFrame, path: str) -> None:
    events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT]).write.mode("append").parquet(path)


def write_with_event(sidecar: Sidecar, outbox: Outbox, documents: DataFrame) -> int:
    """Host documents are written, and an upsert event for each, whose payload says its status; the index follows when events are processed."""
    sidecar.write_source(documents)
    status = F.coalesce("status", F.lit("published")) if "status" in documents.columns else F.lit("published")
    return outbox.enqueue(documents.select("document_id", F.lit("upsert").alias("operation"), F.to_json(F.struct(status.alias("status"))).alias("payload")), ["document_id"])


def unpublish_with_event(sidecar: Sidecar, outbox: Outbox, ids: DataFrame) -> int:
    sidecar.host.set_status(ids, "unpublished")
    return outbox.enqueue(ids.select("document_id", F.lit("unpublish").alias("operation")), ["document_id"])


def start(sidecar: Sidecar, outbox: Outbox, checkpoint: str, once: bool = True, every: str = "1 second"):
    """Processes the outbox as a stream: each batch of new events drains what is pending. A failed event is marked, and the stream goes on."""
    events = sidecar.spark.readStream.schema(EVENT).parquet(outbox.events_path)
    writer = events.writeStream.foreachBatch(lambda batch, _: drain(sidecar, outbox) if not batch.isEmpty() else None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

"""Streams into the engine: writes with automatic flushes, and a rate limiter with state."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.plans.engine import Engine


class AutoFlush:
    """Flushes a shard when its tail has ``rows`` rows, or when the last flush is ``seconds`` ago."""

    def __init__(self, engine: Engine, rows: int | None = None, seconds: float | None = None, clock=time.monotonic):
        self.engine, self.rows, self.seconds, self.clock = engine, rows, seconds, clock
        self.last = clock()

    def poll(self) -> list[str]:
        late = self.seconds is not None and self.clock() - self.last >= self.seconds
        done = []
        for shard in self.engine.shards():
            if late or (self.rows is not None and self.engine.tail(shard).count() >= self.rows):
                m = self.engine.flush(shard, truncate_log=True)
                done += [m["segment_id"]] if m else []
        if late or done:
            self.last = self.clock()
        return done


def write_stream(engine: Engine, writes: DataFrame, order: list[str], checkpoint: str, flush: AutoFlush | None = None, once: bool = True):
    """Appends a stream of writes; ``order`` are the columns that order a batch.

    A batch that comes twice gets newer epochs for the same values, which latest-write-wins makes harmless.
    """

    def handle(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.append(batch, order)
            if flush:
                flush.poll()

    writer = writes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


LIMITED = T.StructType([T.StructField("identifier", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.DoubleType()), T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])
_STATE = T.StructType([T.StructField("times", T.ArrayType(T.DoubleType()))])


def rate_limited_stream(requests: DataFrame, max_requests: int, window_seconds: float) -> DataFrame:
    """The sliding window of ``operators.audit.rate_limited`` on a stream: state is the times within one window of each identifier."""

    def step(key: tuple, parts: Iterator, state) -> Iterator:
        import pandas as pd

        window = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        out = []
        for seq, t in zip(rows["seq"].tolist(), rows["ts"].tolist(), strict=True):
            window = [w for w in window if w > t - window_seconds]
            ok = len(window) < max_requests
            out.append((key[0], seq, t, ok, 0.0 if ok else max(0.0, window_seconds - (t - window[0]))))
            if ok:
                window.append(t)
        state.update((window,))
        yield pd.DataFrame(out, columns=LIMITED.names)

    typed = requests.select(F.col("identifier").cast("string").alias("identifier"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"))
    return typed.groupBy("identifier").applyInPandasWithState(step, LIMITED, _STATE, "append", "NoTimeout")

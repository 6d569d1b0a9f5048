"""Reports over a write log and over benchmark runs."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.functions import metrics as M


def log_audit(log: DataFrame) -> DataFrame:
    """Entries, upserts, deletes, last epoch and distinct ids of each collection."""
    return log.groupBy("collection_id").agg(
        F.count("*").alias("entries"), F.count_if(F.col("operation") == "upsert").alias("upserts"), F.count_if(F.col("operation") == "delete").alias("deletes"),
        F.max("write_epoch").alias("max_epoch"), F.count_distinct("vector_id").alias("vectors"),
    )


def log_snapshot(log: DataFrame) -> DataFrame:
    """(live, deleted): ids by their last operation in the order of the log."""
    last = log.groupBy("collection_id", "vector_id").agg(F.max_by("operation", "write_epoch").alias("operation"))
    return last.agg(F.count_if(F.col("operation") == "upsert").alias("live"), F.count_if(F.col("operation") == "delete").alias("deleted"))


def recall_table(expected: DataFrame, actual: DataFrame, k: int) -> DataFrame:
    """(qid, recall, overlap) from two tables of (qid, rank, vector_id); a query without hits has an empty list."""

    def lists(hits: DataFrame, name: str) -> DataFrame:
        top = hits.where(F.col("rank") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vector_id"))).alias("r"))
        return top.select("qid", F.col("r.vector_id").alias(name))

    both = lists(expected, "expected").join(lists(actual, "actual"), "qid", "full_outer")
    empty = F.array().cast(both.schema["expected"].dataType)
    both = both.select("qid", F.coalesce("expected", empty).alias("expected"), F.coalesce("actual", empty).alias("actual"))
    return both.select("qid", M.recall_at_k(F.col("expected"), F.col("actual"), k).alias("recall"), M.top_k_overlap(F.col("expected"), F.col("actual")).alias("overlap"))


def mean_recall(table: DataFrame) -> DataFrame:
    """Mean over queries; 1 without any."""
    return table.agg(F.coalesce(F.avg("recall"), F.lit(1.0)).alias("mean_recall"), F.coalesce(F.avg("overlap"), F.lit(1.0)).alias("mean_overlap"), F.count("*").alias("queries"))


def latency_report(latencies: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """Mean, true median, and the rank percentiles of a bounded window of latencies a group."""
    v = F.col(value)
    return latencies.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"),
        M.rank_percentile(v, 0.5).alias("p50"), M.rank_percentile(v, 0.95).alias("p95"), M.rank_percentile(v, 0.99).alias("p99"),
    )


def rate_limited(requests: DataFrame, max_requests: int, window_seconds: float) -> DataFrame:
    """(identifier, seq, ts, allowed, retry_after): a sliding window for each identifier; refused requests do not count.

    ``requests``: (identifier, seq, ts) with ts in seconds. Sequential for an
    identifier by nature: its requests stream through one task in the order of
    (ts, seq), which holds the times within one window only.
    """
    id_type = requests.schema["identifier"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        who, window = None, deque()
        for b in batches:
            allowed, wait = [], []
            for name, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if name != who:
                    who, window = name, deque()
                while window and window[0] <= t - window_seconds:
                    window.popleft()
                ok = len(window) < max_requests
                allowed.append(ok)
                wait.append(0.0 if ok else max(0.0, window_seconds - (t - window[0])))
                if ok:
                    window.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed, pa.bool_()), pa.array(wait, pa.float64())], names=["identifier", "seq", "ts", "allowed", "retry_after"])

    typed = requests.select("identifier", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"))
    dealt = typed.repartition("identifier").sortWithinPartitions("identifier", "ts", "seq")
    return dealt.mapInArrow(run, f"identifier {id_type}, seq long, ts double, allowed boolean, retry_after double")

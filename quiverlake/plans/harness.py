"""Benchmark runs: the three ways to search, with recall against the exact one."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.operators import audit
from quiverlake.plans.engine import COMPRESSED, EXACTISH, RERANKED, Engine, EngineOptions
from quiverlake.schema import Collection
from quiverlake.sources import fixtures


@dataclass(frozen=True)
class PathResult:
    """Latency is of the whole batch over its queries: one job answers them together."""

    path: str
    queries: int
    top_k: int
    ms_per_query: float
    recall: float
    overlap: float


def run_paths(engine: Engine, queries: DataFrame, top_k: int = 10, probe_k: int | None = None, repeat: int = 1, **how) -> list[PathResult]:
    """exact, compressed and reranked, each over the whole query table; recall at min(10, top_k) against exact."""
    n, exact, out = queries.count(), None, []
    for name, mode in (("exact-hybrid", EXACTISH), ("compressed-hybrid", COMPRESSED), ("compressed-reranked-hybrid", RERANKED)):
        probes = None if mode == EXACTISH else probe_k
        times = []
        for _ in range(max(1, repeat)):
            began = time.perf_counter()
            hits = engine.search(queries, top_k, mode, probe_k=probes, **how).select("qid", "rank", F.concat_ws("@", "vector_id", "shard_id").alias("vector_id")).collect()
            times.append(time.perf_counter() - began)
        found = queries.sparkSession.createDataFrame(hits, f"qid {queries.schema['qid'].dataType.simpleString()}, rank int, vector_id string")
        exact = found if exact is None else exact
        m = audit.mean_recall(audit.recall_table(exact, found, min(10, top_k))).first()
        out.append(PathResult(name, n, top_k, 1000 * min(times) / max(1, n), m["mean_recall"], m["mean_overlap"]))
    return out


@dataclass(frozen=True)
class Scenario:
    name: str
    rows: int
    dim: int
    shards: int = 1
    delete_ratio: float = 0.0
    clusters: int | None = None
    probe_k: int | None = None
    queries: int = 8


SCENARIOS = (
    Scenario("small-single-shard", 128, 2),
    Scenario("medium-ivf", 512, 16, clusters=16, probe_k=2, queries=16),
    Scenario("medium-ivf-deletes", 512, 16, shards=2, delete_ratio=0.2, clusters=16, probe_k=2, queries=16),
    Scenario("large-ivf-multishard", 1024, 32, shards=4, delete_ratio=0.1, clusters=32, probe_k=3, queries=24),
)


def run_scenario(spark: SparkSession, root: str, s: Scenario, top_k: int = 10, quantizer: str = "scalar") -> DataFrame:
    """Loads, deletes, flushes and searches one scenario over all its shards; one row a path."""
    engine = Engine(spark, root, Collection(s.name, s.dim, quantizer=quantizer), EngineOptions(ivf_n_clusters=s.clusters, ivf_auto_threshold=None))
    rows, gone = fixtures.scenario(spark, s.rows, s.dim, s.shards, s.delete_ratio)
    engine.append(rows.select("vector_id", "embedding", "shard_id", "ordinal"), ["ordinal"])
    if s.delete_ratio:
        engine.append(gone.selectExpr("vector_id", "shard_id", "cast(null as array<float>) as embedding"), ["vector_id"])
    for shard in engine.shards():
        engine.flush(shard, truncate_log=True)
    queries = rows.where(f"ordinal % {max(1, s.rows // s.queries)} = 0").selectExpr("ordinal as qid", "cast(embedding as array<double>) as query").limit(s.queries)
    stats = engine.stats()
    results = [asdict(r) | {"scenario": s.name, "live_rows": stats["live_rows"], "storage_bytes": stats["storage_bytes"], "bytes_per_vector": stats["storage_bytes"] / max(1, stats["live_rows"])} for r in run_paths(engine, queries, top_k, s.probe_k)]
    return spark.createDataFrame(results).select("scenario", "path", "queries", "top_k", "ms_per_query", "recall", "overlap", "live_rows", "storage_bytes", "bytes_per_vector")


def compare_quantizers(spark: SparkSession, root: str, s: Scenario, names: list[str], top_k: int = 10) -> DataFrame:
    """One scenario with each quantiser."""
    out = None
    for name in names:
        one = run_scenario(spark, f"{root}/{name}", s, top_k, name).withColumn("quantizer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out

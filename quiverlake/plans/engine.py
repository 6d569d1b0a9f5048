"""The engine: a write log, sealed segments, and batches of searches over both."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.functions.quantizers import quantizer
from quiverlake.functions.text import mode_name
from quiverlake.operators import audit, hybrid, ivf, lifecycle
from quiverlake.operators import filters as FL
from quiverlake.operators import topk as K
from quiverlake.operators import visibility as VIS
from quiverlake.schema import DEFAULT_SHARD, Collection, checked_dim
from quiverlake.sources.log import WriteLog, numbered
from quiverlake.sources.segments import SegmentStore, ShardState
from quiverlake.sources.storage import Storage

EXACT, EXACTISH, COMPRESSED, RERANKED = "exact", "exactish", "compressed", "reranked"
LATEST, COMPAT = "latest", "compat"
KEY = "__key"


@dataclass(frozen=True)
class EngineOptions:
    flush_threshold: int | None = None
    ivf_n_clusters: int | None = None
    ivf_auto_threshold: int | None = 50_000
    ivf_probe_k: int = 2
    rerank_probe_k: int | None = None
    filter_threshold: float = FL.PRE_FILTER_AT
    cached_segments: int = 0


@dataclass(frozen=True)
class QueryPlan:
    mode: str
    top_k: int
    candidate_k: int | None
    filter_strategy: str
    visibility: str
    probe_k: int | None
    versions: dict[str, int]


@dataclass(frozen=True)
class Inspection:
    """What ``Engine.inspect`` saw. Times are in milliseconds, of whole jobs over all queries."""

    plan: QueryPlan
    filters_applied: bool
    mutable_live_count: int
    active_segments: dict[str, list[str]]
    result_count: int
    mutable_hit_count: int
    sealed_hit_count: int
    pre_filter_candidate_count: int
    post_filter_candidate_count: int
    candidate_generation_count: int
    plan_ms: float
    search_ms: float
    rerank_ms: float
    total_ms: float

    def payload(self, notes: dict[str, str] | None = None) -> dict[str, Any]:
        """For export as JSON: the counts, the plan, and notes if there are any."""
        out = asdict(self)
        plan = out.pop("plan")
        return {"inspection": out | {"mode": f"{self.plan.mode}-engine", "top_k": self.plan.top_k, "rerank_candidate_k": self.plan.candidate_k}, "plan": plan} | ({"notes": dict(notes)} if notes else {})


class Engine:
    """One collection below a root folder. All state is on storage: a new engine on the same root goes on where the last one was."""

    def __init__(self, spark: SparkSession, root: str, collection: Collection, options: EngineOptions | None = None):
        self.spark, self.collection, self.options = spark, collection, options or EngineOptions()
        self.storage = Storage(spark, f"{root.rstrip('/')}/{collection.collection_id}")
        self.metadata_type = collection.metadata_type() if collection.filter_schema else T.StructType([T.StructField("none", T.StringType())])
        self.id_type = T.StringType()
        self.log = WriteLog(self.storage, self.storage.path("log"), self.metadata_type, self.id_type)
        self.store = SegmentStore(self.storage, self.storage.path("shards"), self.options.cached_segments)
        self.quantizer = quantizer(collection.quantizer)
        self.last_trace: Inspection | None = None

    # ---- writing ----------------------------------------------------------------

    def shards(self) -> list[str]:
        return sorted({*self.log.shards(), *self.store.shards()})

    def last_epoch(self) -> int:
        """The highest epoch in the log or in any segment."""
        sealed = [s.replay_from for s in map(self.store.load, self.store.shards())]
        return max([self.log.last_epoch(), *sealed])

    def append(self, writes: DataFrame, order: list[str] | None = None) -> int:
        """Appends upserts and deletes in the given order and returns the last epoch.

        ``writes``: vector_id, embedding (null in a delete), and where they
        differ from the defaults operation, metadata, shard_id.
        """
        have = set(writes.columns)
        rows, n, held = numbered(writes, order or [], self.last_epoch())
        op = F.col("operation") if "operation" in have else F.when(F.col("embedding").isNull(), "delete").otherwise("upsert")
        meta = F.col("metadata").cast(self.metadata_type) if "metadata" in have and self.collection.filter_schema else F.lit(None).cast(self.metadata_type)
        embedding = checked_dim(F.col("embedding").cast("array<float>"), self.collection.dim)
        self.log.append(
            rows.select(
                op.alias("operation"), F.lit(self.collection.collection_id).alias("collection_id"), (F.coalesce("shard_id", F.lit(DEFAULT_SHARD)) if "shard_id" in have else F.lit(DEFAULT_SHARD)).alias("shard_id"),
                F.col("vector_id").cast("string").alias("vector_id"), "write_epoch", F.when(op == "upsert", embedding).alias("embedding"), meta.alias("metadata"), F.current_timestamp().alias("ts"),
            )
        )
        held.unpersist()
        if self.options.flush_threshold:
            for shard in self.shards():
                if self.tail(shard).count() >= self.options.flush_threshold:
                    self.flush(shard)
        return self.last_epoch() if n == 0 else self.log.last_epoch()

    def upsert(self, rows: list[tuple[str, list[float], dict[str, Any] | None]], shard_id: str = DEFAULT_SHARD) -> int:
        """A few rows from the driver."""
        kind = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("vector_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", self.metadata_type), T.StructField("shard_id", T.StringType())])
        names = self.metadata_type.names
        data = [(k, i, [float(x) for x in v], tuple((m or {}).get(n) for n in names), shard_id) for k, (i, v, m) in enumerate(rows)]
        return self.append(self.spark.createDataFrame(data, kind), ["seq"])

    def delete(self, ids: list[str], shard_id: str = DEFAULT_SHARD) -> int:
        """Tombstones, for unknown ids too. Metadata of earlier versions is not kept."""
        rows = self.spark.createDataFrame([(k, i, shard_id) for k, i in enumerate(ids)], "seq int, vector_id string, shard_id string")
        return self.append(rows.withColumn("embedding", F.lit(None).cast("array<float>")), ["seq"])

    # ---- reading state ----------------------------------------------------------

    def tail(self, shard_id: str, state: ShardState | None = None) -> DataFrame:
        """The mutable rows of a shard: the newest write of each id after the flushed ones, tombstones included."""
        state = state or self.store.load(shard_id)
        log = self.log.replay(state.replay_from, shard_id)
        usable = log.where((F.col("operation") == "delete") | F.col("embedding").isNotNull())
        return VIS.newest(usable).select("shard_id", "vector_id", "embedding", "metadata", "write_epoch", (F.col("operation") == "delete").alias("is_deleted"))

    def buffer(self, shard_id: str) -> DataFrame:
        """The tail with the times of an id's first and last write, and with the metadata that a deletion keeps."""
        return VIS.buffered(self.log.replay(self.store.load(shard_id).replay_from, shard_id))

    def sealed(self, shard_id: str, state: ShardState | None = None) -> DataFrame | None:
        return self.store.read(state or self.store.load(shard_id), shard_id, self.metadata_type, self.id_type)

    def _rows(self, states: dict[str, ShardState]) -> tuple[DataFrame | None, DataFrame | None]:
        """The tails and the sealed rows of shards; None where there are none, as the folders tell."""
        mutable = sealed = None
        for shard, state in states.items():
            m = self.tail(shard, state) if self.log.has(state.replay_from, shard) else None
            s = self.sealed(shard, state)
            mutable = m if mutable is None else mutable if m is None else mutable.unionByName(m)
            sealed = s if sealed is None else sealed if s is None else sealed.unionByName(s)
        return mutable, sealed

    def _no_tail(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*[f for f in self.log.schema if f.name in ("shard_id", "vector_id", "embedding", "metadata", "write_epoch")], T.StructField("is_deleted", T.BooleanType())]))

    def _snapshot(self, shard_id: str | None) -> dict[str, ShardState]:
        """One version of each shard, for all steps of a query."""
        return {s: self.store.load(s) for s in ([shard_id] if shard_id else self.shards() or [DEFAULT_SHARD])}

    def _tagged(self, mutable: DataFrame | None, sealed: DataFrame | None) -> DataFrame:
        q = self.quantizer
        if mutable is None and sealed is not None:
            return sealed.withColumn("source", F.lit(hybrid.SEALED))
        m = self._no_tail() if mutable is None else mutable
        m = m.withColumn("source", F.lit(hybrid.MUTABLE)).withColumn("segment_pos", F.lit(1 << 30)).withColumn("segment_id", F.lit(None).cast("string")).withColumn("cluster_id", F.lit(None).cast("int")).withColumn("docno", F.lit(0))
        m = m.withColumn("__e", F.when(F.col("embedding").isNotNull(), q.encode(F.col("embedding")))).withColumn("codes", F.col("__e.codes")).withColumn("scale", F.col("__e.scale")).drop("__e")
        return m if sealed is None else m.unionByName(sealed.withColumn("source", F.lit(hybrid.SEALED)))

    def visible(self, shard_id: str | None = None, filters: dict | None = None, states: dict[str, ShardState] | None = None) -> DataFrame:
        """Live rows: the newest version of each id over the tail and all segments, then the filter.

        Which rows are hidden is found on keys and epochs alone; vectors are not
        shuffled for it. A shard with one segment and no tail has no older versions.
        """
        states = states or self._snapshot(shard_id)
        mutable, sealed = self._rows(states)
        rows = self._tagged(mutable, sealed)
        if mutable is None and all(len(s.active) <= 1 for s in states.values()):
            seen = VIS.live(rows)
        else:
            place = ["write_epoch", "segment_pos"]
            gone = VIS.hidden(rows.select(*VIS.KEY, *place, "is_deleted"), place, VIS.KEY, [F.col("write_epoch").desc(), F.col("segment_pos").desc()])
            seen = rows.join(gone, [*VIS.KEY, *place], "left_anti")
        return FL.apply_filter(seen, filters, lambda k: F.col(f"metadata.{k}"))

    # ---- searching --------------------------------------------------------------

    def plan(self, top_k: int, mode: str, filters: dict | None = None, candidate_k: int | None = None, probe_k: int | None = None, visibility: str = LATEST, shard_id: str | None = None) -> QueryPlan:
        strategy = FL.NO_FILTER
        if filters:
            strategy = FL.plan_filter(self.visible(shard_id), filters, lambda k: F.col(f"metadata.{k}"), self.options.filter_threshold).strategy
        name = mode_name(mode in (COMPRESSED, RERANKED), mode == RERANKED)
        return QueryPlan(name, top_k, hybrid.candidate_budget(top_k, candidate_k) if mode == RERANKED else None, strategy, visibility, probe_k, {s: st.version for s, st in self._snapshot(shard_id).items()})

    def search(
        self, queries: DataFrame, top_k: int = 10, mode: str = EXACT, shard_id: str | None = None, filters: dict | None = None, candidate_k: int | None = None,
        probe_k: int | None = None, search_budget: int | None = None, visibility: str = LATEST, candidates: DataFrame | None = None,
    ) -> DataFrame:
        """(qid, rank, vector_id, score, source, metadata) for a table of (qid, query).

        Modes: ``exact`` scores stored vectors; ``exactish`` dequantised ones;
        ``compressed`` scores codes; ``reranked`` takes candidates by codes and
        scores them exactly. ``probe_k`` reads only the nearest clusters of
        clustered segments, ``search_budget`` only the first rows of each.
        Without a shard, all shards are searched.
        """
        if mode not in (EXACT, EXACTISH, COMPRESSED, RERANKED):
            raise ValueError(f"unknown mode {mode!r}")
        states = self._snapshot(shard_id)
        metric, meta = self.collection.metric, lambda k: F.col(f"metadata.{k}")
        # An id is one within its shard, so hits are known by both all the way.
        keyed = lambda r: r.withColumn(KEY, F.struct("vector_id", "shard_id"))
        budget = lambda r: r if search_budget is None else r.where("source = 'mutable'").unionByName(K.first_rows(r.where("source = 'sealed'"), search_budget, ["shard_id", "segment_id"], ["docno"]))
        limit = hybrid.candidate_budget(top_k, candidate_k) if mode == RERANKED else top_k
        wide = (self.options.rerank_probe_k or 2 * probe_k) if mode == RERANKED and probe_k else probe_k
        score = lambda r: self._scored(r, queries, limit, mode, states, wide)
        if visibility == COMPAT:
            mutable, sealed = self._rows(states)
            tail = self._no_tail() if mutable is None else mutable
            m = keyed(self._tagged(FL.restrict(FL.apply_filter(VIS.live(tail), filters, meta), candidates), None))
            columns = [KEY, "source", "metadata", "embedding"]
            source = m.select(*columns)
            if sealed is None:
                found = score(m)
            else:
                s = VIS.live(sealed if mutable is None else VIS.masked(sealed, mutable))
                s = budget(keyed(FL.restrict(FL.apply_filter(s, filters, meta), candidates).withColumn("source", F.lit(hybrid.SEALED))))
                found = hybrid.merge_compat(score(m), score(s), limit, ["qid"], KEY)
                source = source.unionByName(hybrid.sealed_map(s, KEY).join(m.select(KEY), KEY, "left_anti").select(*columns))
            if mode == RERANKED:
                found = hybrid.rerank(found, source, queries, top_k, metric=metric, key=KEY)
            hits = K.top_k_scored(found.select("qid", KEY, "score").join(source.select(KEY, "source", "metadata"), KEY), top_k, ["qid"], KEY)
        else:
            # A hit carries its source and metadata, and its second score, from where it is scored; vectors are read once.
            rows = budget(keyed(FL.restrict(self.visible(shard_id, filters, states), candidates)))
            hits = self._scored(rows, queries, limit, mode, states, wide, mode == RERANKED)
            if mode == RERANKED:
                hits = K.top_k_again(hits, top_k, KEY, ("source", "metadata"))
        return hits.select("qid", "rank", f"{KEY}.vector_id", "score", "source", f"{KEY}.shard_id", "metadata")

    def _scored(self, rows: DataFrame, queries: DataFrame, k: int, mode: str, states: dict[str, ShardState], probe_k: int | None, twice: bool = False) -> DataFrame:
        """The k best rows a query; ``twice``: also their score by the stored vector, as ``again``."""
        q = self.quantizer
        coded, carry = F.struct("codes", "scale"), ("source", "metadata")
        metric = self.collection.metric
        if mode in (EXACT, EXACTISH):
            vector = F.col("embedding") if mode == EXACT else F.when(F.col("source") == hybrid.MUTABLE, F.col("embedding")).otherwise(q.restored(coded))
            return K.top_k_batch(rows, queries, k, vector, KEY, metric, carry=carry)
        again = F.col("embedding") if twice else None
        asked = queries.select("qid", q.prepare(F.col("query")).cast("array<double>").alias("query"), *([F.col("query").cast("array<double>").alias("again")] if twice else []))
        names, centroids = [], []
        for shard, state in states.items() if probe_k and k > 0 else ():
            for segment_id, table in self.store.centroid_tables(state, shard).items():
                names += [(f"{shard}/{segment_id}", c) for c in range(len(table))]
                centroids.append(table)
        if names:
            found = ivf.top_k_probed(rows, asked, names, np.concatenate(centroids), probe_k, k, ["shard_id", "segment_id"], q.decode(coded), KEY, metric, carry=carry, again=again)
            if found is not None:
                return K.top_k_scored(found, k, ["qid"], KEY)
        return K.top_k_batch(rows, asked, k, q.decode(coded), KEY, metric, carry=carry, again=again)

    def explain_query(self, queries: DataFrame, **how) -> DataFrame:
        """One row a query: hits by source, and the plan as JSON."""
        import json

        options = {k: how[k] for k in ("filters", "candidate_k", "probe_k", "visibility", "shard_id") if k in how}
        plan = self.plan(how.get("top_k", 10), how.get("mode", EXACT), **options)
        sources = hybrid.hit_sources(self.search(queries, **how), ["qid"])
        counted = queries.select("qid").join(sources, "qid", "left").fillna(0, ["mutable_hits", "sealed_hits"])
        return counted.withColumn("plan", F.lit(json.dumps(asdict(plan), sort_keys=True)))

    def inspect(self, queries: DataFrame, top_k: int = 10, mode: str = EXACT, filters: dict | None = None, shard_id: str | None = None, candidate_k: int | None = None, **how) -> tuple[list, Inspection]:
        """The hits of a search as rows, and how it came to them: plan, rows before and after the filter, hits by side, times of the stages."""
        began = time.perf_counter()
        states = self._snapshot(shard_id)
        plan = self.plan(top_k, mode, filters, candidate_k, how.get("probe_k"), how.get("visibility", LATEST), shard_id)
        rows = self.visible(shard_id, None, states)
        side = lambda s: F.count_if(F.col("source") == s)
        seen = rows.agg(side(hybrid.MUTABLE).alias("mutable"), side(hybrid.SEALED).alias("sealed"), F.count_if(FL.predicate(filters, lambda k: F.col(f"metadata.{k}"))).alias("after")).first()
        planned = time.perf_counter()
        stage = dict(shard_id=shard_id, filters=filters, **how)
        n = len(self.search(queries, plan.candidate_k or top_k, COMPRESSED if mode == RERANKED else mode, **stage).select("qid").collect())
        searched = time.perf_counter()
        hits = self.search(queries, top_k, mode, candidate_k=candidate_k, **stage).orderBy("qid", "rank").collect()
        ended = time.perf_counter()
        of = lambda s: sum(h["source"] == s for h in hits)
        ms = lambda a, b: round(1000 * (b - a), 3)
        self.last_trace = Inspection(
            plan, bool(filters), seen["mutable"], {s: list(st.active) for s, st in states.items()}, len(hits), of(hybrid.MUTABLE), of(hybrid.SEALED), seen["mutable"] + seen["sealed"], seen["after"],
            n, ms(began, planned), ms(planned, searched), ms(searched, ended) if mode == RERANKED else 0.0, ms(began, ended),
        )
        return hits, self.last_trace

    # ---- lifecycle --------------------------------------------------------------

    def _now(self) -> str:
        return datetime.now(UTC).isoformat(timespec="seconds")

    def _clusters(self, shard_id: str, tail_rows: int, state: ShardState) -> int | None:
        live = sum(state.segments[s]["live_row_count"] for s in state.active)
        return ivf.cluster_count(live + tail_rows, self.options.ivf_n_clusters, self.options.ivf_auto_threshold)

    def flush(self, shard_id: str = DEFAULT_SHARD, segment_id: str | None = None, truncate_log: bool = False) -> dict[str, Any] | None:
        """Seals the tail of a shard, tombstones too. None if there is nothing to seal.

        The log goes on counting from the segment's last epoch once the new
        version is published; a crash before that leaves the old state.
        """
        state = self.store.load(shard_id)
        rows = self.tail(shard_id, state).persist()
        try:
            n, alive, top = rows.agg(F.count("*"), F.count_if(~F.col("is_deleted")), F.max("write_epoch")).first()
            if not n:
                return None
            segment_id = segment_id or f"seg-{top:020d}-{state.version + 1}"
            clusters = self._clusters(shard_id, alive, state) if alive else None
            manifest = self.store.write(shard_id, segment_id, rows.drop("shard_id"), self.quantizer, 0, self.collection.collection_id, clusters, self._now())
        finally:
            rows.unpersist()
        state.segments[segment_id] = manifest
        state.active.append(segment_id)
        state.replay_from = max(state.replay_from, top)
        self._checked(shard_id, state)
        self.store.publish(shard_id, state)
        if truncate_log:
            self.log.truncate(state.replay_from, shard_id)
        return manifest

    def _checked(self, shard_id: str, state: ShardState) -> None:
        lost = [s for s in state.active if s not in state.segments or state.segments[s]["state"] == "retired"]
        if lost or len(set(state.active)) != len(state.active):
            raise ValueError(f"manifest check failed in {shard_id}: {lost or state.active}")

    def compact(self, shard_id: str = DEFAULT_SHARD, segment_ids: list[str] | None = None, limits: lifecycle.CompactionLimits | None = None) -> dict[str, Any] | None:
        """Merges segments (the plan's, if none are named) into one and retires them. None if there is nothing to do."""
        state = self.store.load(shard_id)
        if segment_ids is None:
            open_ = self.store.manifests([shard_id]).where(F.col("segment_id").isin(state.active))
            segment_ids = [r["segment_id"] for r in lifecycle.compaction_plan(open_, limits).orderBy("position").collect()]
        chosen = [s for s in state.active if s in set(segment_ids)]
        if not chosen:
            return None
        picked = ShardState(state.version, chosen, state.segments, state.replay_from)
        rows = self.store.read(picked, shard_id, self.metadata_type, self.id_type)
        # A tombstone may go only if no segment outside the selection holds older rows.
        newest_chosen = max(state.segments[s]["max_write_epoch"] for s in chosen)
        covers = all(s in chosen or state.segments[s]["min_write_epoch"] > newest_chosen for s in state.active)
        merged = lifecycle.compacted(rows, covers).select("vector_id", "embedding", "metadata", "write_epoch", "is_deleted")
        generation = max(state.segments[s]["generation"] for s in chosen) + 1
        out = f"seg-{newest_chosen:020d}-{state.version + 1}"
        live = sum(state.segments[s]["live_row_count"] for s in chosen)
        clusters = ivf.cluster_count(live, self.options.ivf_n_clusters, self.options.ivf_auto_threshold) if live else None
        manifest = self.store.write(shard_id, out, merged, self.quantizer, generation, self.collection.collection_id, clusters, self._now())
        low, high = min(state.segments[s]["min_write_epoch"] for s in chosen), newest_chosen
        manifest |= {"min_write_epoch": low, "max_write_epoch": high}
        for s in chosen:
            state.segments[s] = state.segments[s] | {"state": "retired"}
        at = min(state.active.index(s) for s in chosen)
        rest = [s for s in state.active if s not in chosen]
        state.active = [*rest[:at], out, *rest[at:]]
        state.segments[out] = manifest
        state.replay_from = max(state.replay_from, high)
        self._checked(shard_id, state)
        self.store.publish(shard_id, state)
        return manifest

    def maybe_compact(self, shard_id: str = DEFAULT_SHARD, limits: lifecycle.TriggerLimits | None = None) -> dict[str, Any] | None:
        state = self.store.load(shard_id)
        active = self.store.manifests([shard_id]).where(F.col("segment_id").isin(state.active))
        due = lifecycle.should_compact(active, limits).first()
        return self.compact(shard_id) if due and due["compact"] else None

    def maintenance_rank(self, limits: lifecycle.MaintenanceLimits | None = None) -> DataFrame:
        tails = [(s, self.tail(s).where("not is_deleted").count()) for s in self.shards()]
        mutable = self.spark.createDataFrame(tails, "shard_id string, mutable_rows long")
        active = self.store.manifests().join(self.store.active(), ["shard_id", "segment_id"], "left_semi")
        return lifecycle.maintenance_rank(active, mutable, limits)

    def compact_most_urgent(self, limits: lifecycle.MaintenanceLimits | None = None) -> dict[str, Any] | None:
        first = self.maintenance_rank(limits).limit(1).collect()
        return self.compact(first[0]["shard_id"]) if first else None

    def collect_garbage(self, shard_id: str = DEFAULT_SHARD) -> list[str]:
        """Removes retired segments, manifests first. Doing it again finds nothing."""
        state = self.store.load(shard_id)
        gone = [s for s, m in state.segments.items() if m["state"] == "retired" and s not in state.active]
        if gone:
            for s in gone:
                del state.segments[s]
            self.store.publish(shard_id, state)
            for s in gone:
                self.store.remove(shard_id, s)
        return sorted(gone)

    def truncate_log(self, shard_id: str = DEFAULT_SHARD) -> int:
        return self.log.truncate(self.store.load(shard_id).replay_from, shard_id)

    # ---- reports ------------------------------------------------------------------

    def recover(self, shard_id: str = DEFAULT_SHARD) -> int:
        """How many log entries a shard's tail is rebuilt from; reading always goes through the log, so nothing is to be loaded."""
        return self.log.replay(self.store.load(shard_id).replay_from, shard_id).count()

    def recover_all(self) -> dict[str, int]:
        """``recover`` for every shard that has a log or a manifest."""
        return {s: self.recover(s) for s in self.shards()}

    def violations(self) -> DataFrame:
        return lifecycle.manifest_violations(self.store.manifests(), self.store.active(), self.collection.collection_id)

    def verify_integrity(self) -> list[dict[str, str]]:
        return [{"shard_id": s, **b} for s in self.store.shards() for b in self.store.verify(s)]

    def live_fractions(self) -> DataFrame:
        return lifecycle.live_fractions(self.store.manifests())

    def stats(self) -> dict[str, Any]:
        mutable, _ = self._rows(self._snapshot(None))
        mutable = self._no_tail() if mutable is None else mutable
        row = lifecycle.collection_stats(self.store.manifests(), mutable).first().asDict()
        return row | {"storage_bytes": self.storage.size(self.storage.root)}

    def audit(self) -> DataFrame:
        return audit.log_audit(self.log.replay())

    def log_snapshot(self) -> DataFrame:
        return audit.log_snapshot(self.log.replay())

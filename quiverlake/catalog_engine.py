"""Registered queries that run the engine, the sidecar and the sources themselves, each with SQL that says what must come out.

The engine's writes are ``events``: write n of the log is event n - 1, of id
user_id, in shard event_id mod 2 (so that an id is in both), with the vector
and the metadata of a row of ``embeddings``; an error is a delete. The first half is
appended and flushed, then the third quarter, and the rest is the tail. The
sidecar's host is ``documents``. What is built is kept for a session and data
folder, below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.catalog import _EMB, _HOST, _Q, EVERY, GROUPS, REGIONS, _coded, _score, _top, asked, host, query, table, vectors
from quiverlake.functions import vectors as V
from quiverlake.operators import ivf
from quiverlake.operators import lifecycle as L
from quiverlake.operators import topk as K
from quiverlake.operators import visibility as VIS
from quiverlake.plans.engine import COMPAT, COMPRESSED, EXACT, EXACTISH, RERANKED, Engine, EngineOptions
from quiverlake.plans.harness import run_paths
from quiverlake.plans.sidecar import Sidecar
from quiverlake.schema import Collection
from quiverlake.sources import fixtures
from quiverlake.sources.host import ParquetHost
from quiverlake.sources.log import as_json_lines, from_json_lines
from quiverlake.sources.storage import shared_folder
from quiverlake.streaming import outbox

DIM, CLUSTERS = 64, 4
_BUILT: dict[tuple, object] = {}


def _kept(name: str):
    """A builder whose result is kept for each session and data folder."""

    def wrap(build):
        def get(spark, d):
            at = (spark.sparkContext.applicationId, d, name)
            if at not in _BUILT:
                _BUILT[at] = build(spark, d, f"{shared_folder(spark)}/catalog-{name}-{uuid.uuid4().hex}")
            return _BUILT[at]

        return get

    return wrap


def writes(spark, d) -> DataFrame:
    events, m = table(spark, d, "events"), table(spark, d, "embeddings").count()
    n = events.count()
    v = vectors(spark, d).select(F.col("vector_id").alias("vec_id"), "embedding", "region", "tier")
    e = events.withColumn("vec_id", F.pmod("event_id", F.lit(m))).join(v, "vec_id")
    delete = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") * 4 / F.lit(n)).cast("int").alias("part"), F.concat(F.lit("shard-"), F.pmod("event_id", F.lit(2)).cast("string")).alias("shard_id"),
        F.col("user_id").cast("string").alias("vector_id"), F.when(delete, "delete").otherwise("upsert").alias("operation"), F.when(~delete, F.col("embedding")).alias("embedding"),
        F.when(~delete, F.struct("region", F.col("tier").cast("long").alias("tier"))).alias("metadata"),
    )


def _engine(spark, root, **options) -> Engine:
    return Engine(spark, root, Collection("catalog", DIM, {"region": "keyword", "tier": "int"}), EngineOptions(**({"ivf_auto_threshold": None} | options)))


@_kept("base")
def base(spark, d, root) -> Engine:
    engine, w = _engine(spark, root), writes(spark, d)
    for step, part in enumerate(("part < 2", "part = 2", "part = 3")):
        engine.append(w.where(part).drop("part"), ["seq"])
        for s in engine.shards() if step < 2 else ():
            engine.flush(s)
    return _engine(spark, root)  # another engine on the same root: all state is on storage


@_kept("compacted")
def compacted(spark, d, root) -> Engine:
    """Truncated at each flush, and each shard's two segments merged."""
    engine, w = _engine(spark, root), writes(spark, d)
    for step, part in enumerate(("part < 2", "part = 2", "part = 3")):
        engine.append(w.where(part).drop("part"), ["seq"])
        for s in engine.shards() if step < 2 else ():
            engine.flush(s, truncate_log=True)
    for s in engine.shards():
        engine.compact(s, limits=L.CompactionLimits(max_total_rows=1 << 40))
    engine.garbage = {s: engine.collect_garbage(s) for s in engine.shards()}
    return engine


@_kept("clustered")
def clustered(spark, d, root) -> Engine:
    engine = _engine(spark, root, ivf_n_clusters=CLUSTERS)
    engine.append(writes(spark, d).where("part < 3").drop("part"), ["seq"])
    for s in engine.shards():
        engine.flush(s, truncate_log=True)
    return engine


_LG = f"""v as (select vec_id, embedding as f, embedding::double[] as e, ['us', 'ca', 'uk', 'eu'][vec_id % 4 + 1] as region, vec_id % 3 as tier from embeddings),
lg as (
  select event_id + 1 as write_epoch, user_id::varchar as vector_id, 'shard-' || (event_id % 2) as shard_id, event_type = 'error' as is_deleted, event_id % m as vec_id, (event_id * 4 // n)::int as part
  from events, (select count(*) as n from events), (select count(*) as m from embeddings)),
seg as (select *, (part = 2)::int as pos from lg where part < 3 qualify row_number() over (partition by shard_id, part = 2, vector_id order by write_epoch desc) = 1),
tail as (select * from lg where part = 3 qualify row_number() over (partition by shard_id, vector_id order by write_epoch desc) = 1),
vis as (select * from (select * from lg qualify row_number() over (partition by shard_id, vector_id order by write_epoch desc) = 1) where not is_deleted),
live as (select vis.*, f, e, region, tier, case when part = 3 then 'mutable' else 'sealed' end as source from vis join v using (vec_id)), {_Q}"""
assert REGIONS == ("us", "ca", "uk", "eu")


def _best(score: str, rows: str, k: int, extra: str = "") -> str:
    return f"select qid, row_number() over (partition by qid order by s desc, vector_id, shard_id)::int as rank, vector_id, shard_id, round(s, 6) as score{extra} from (select *, {score} as s from {rows}) qualify rank <= {k}"


# ---- log, segments, state -----------------------------------------------------------


@query("engine_log", f"with {_LG} select write_epoch, shard_id, vector_id, case when is_deleted then 'delete' else 'upsert' end as operation, case when not is_deleted then round(e[1], 6) end as first, case when not is_deleted then region end as region from lg join v using (vec_id)")
def engine_log(spark, d):
    got = base(spark, d).log.replay()
    return got.select("write_epoch", "shard_id", "vector_id", "operation", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), "metadata.region")


@query("engine_log_after", f"with {_LG} select write_epoch, vector_id from lg where write_epoch > (select count(*) * 5 // 8 from events) and shard_id = 'shard-1'")
def engine_log_after(spark, d):
    half = table(spark, d, "events").count() * 5 // 8
    return base(spark, d).log.replay(half, "shard-1").select("write_epoch", "vector_id")


@query("engine_log_truncated", f"with {_LG} select write_epoch, shard_id, vector_id from lg where part = 3")
def engine_log_truncated(spark, d):
    return compacted(spark, d).log.replay().select("write_epoch", "shard_id", "vector_id")


@query("engine_log_json", f"with {_LG} select write_epoch, shard_id, vector_id, is_deleted from lg")
def engine_log_json(spark, d):
    """The log written as JSON lines and read again."""
    engine, path = base(spark, d), f"{shared_folder(spark)}/catalog-json-{uuid.uuid4().hex}"
    as_json_lines(engine.log.replay(), path)
    return from_json_lines(spark, path, engine.metadata_type).select("write_epoch", "shard_id", "vector_id", (F.col("operation") == "delete").alias("is_deleted"))


@query("engine_tail", f"with {_LG} select shard_id, vector_id, write_epoch, is_deleted from tail")
def engine_tail(spark, d):
    mutable, _ = base(spark, d)._rows(base(spark, d)._snapshot(None))
    return mutable.select("shard_id", "vector_id", "write_epoch", "is_deleted")


@query("engine_buffer", f"with {_LG}, up as (select shard_id, vector_id, arg_max(region, write_epoch) as region from lg join v using (vec_id) where part = 3 and not is_deleted group by all) select t.shard_id, t.vector_id, t.write_epoch, t.is_deleted, up.region from tail t left join up on up.shard_id = t.shard_id and up.vector_id = t.vector_id")
def engine_buffer(spark, d):
    engine = base(spark, d)
    both = engine.buffer("shard-0").unionByName(engine.buffer("shard-1"))
    return both.select("shard_id", "vector_id", "write_epoch", "is_deleted", "metadata.region")


@query("engine_buffer_removed", f"with {_LG} select shard_id, vector_id from tail where shard_id || vector_id not in (select shard_id || vector_id from seg where is_deleted)")
def engine_buffer_removed(spark, d):
    engine = base(spark, d)
    mutable, sealed = engine._rows(engine._snapshot(None))
    return VIS.removed(mutable, sealed.where("is_deleted"))[0].select("shard_id", "vector_id")


@query("engine_recover", f"with {_LG} select shard_id, count(*) as entries from lg where part = 3 group by shard_id")
def engine_recover(spark, d):
    return spark.createDataFrame(list(base(spark, d).recover_all().items()), "shard_id string, entries long")


@query("engine_manifests", f"with {_LG} select shard_id, pos, 'active' as state, count(*) as row_count, count(*) filter (not is_deleted) as live_row_count, count(*) filter (is_deleted) as deleted_row_count, min(write_epoch) as min_write_epoch, max(write_epoch) as max_write_epoch from seg group by shard_id, pos")
def engine_manifests(spark, d):
    store = base(spark, d).store
    m = store.manifests().join(store.active().select("shard_id", "segment_id", F.col("segment_pos").alias("pos")), ["shard_id", "segment_id"])
    return m.select("shard_id", "pos", "state", "row_count", "live_row_count", "deleted_row_count", "min_write_epoch", "max_write_epoch")


@query("engine_active_segments", f"with {_LG} select shard_id, count(distinct pos) as segments, max(write_epoch) as replay_from from seg group by shard_id")
def engine_active_segments(spark, d):
    store = base(spark, d).store
    rows = [(s, len(st.active), st.replay_from) for s in store.shards() for st in [store.load(s)]]
    return spark.createDataFrame(rows, "shard_id string, segments long, replay_from long")


@query(
    "engine_segment_rows",
    f"""with {_LG.replace("v as (select vec_id,", "v as (select vec_id as vector_id, vec_id,", 1)}, {_coded("scalar")},
code as (select vec_id, codes, scale from deco)
select shard_id, pos, s.vector_id, (row_number() over (partition by shard_id, pos order by is_deleted, s.vector_id) - 1)::int as docno, write_epoch, is_deleted,
  case when not is_deleted then list_sum(list_transform(codes, lambda c, i: c::bigint * i))::bigint end as checksum, case when not is_deleted then round(scale, 6) end as scale from seg s join code using (vec_id)""",
)
def engine_segment_rows(spark, d):
    _, sealed = base(spark, d)._rows(base(spark, d)._snapshot(None))
    check = F.aggregate(F.transform("codes", lambda c, i: c.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return sealed.select("shard_id", F.col("segment_pos").alias("pos"), "vector_id", "docno", "write_epoch", "is_deleted", check.alias("checksum"), F.round("scale", 6).alias("scale"))


@query("engine_visible", f"with {_LG} select shard_id, vector_id, write_epoch, source, region, tier from live")
def engine_visible(spark, d):
    return base(spark, d).visible().select("shard_id", "vector_id", "write_epoch", "source", "metadata.region", "metadata.tier")


# ---- searches --------------------------------------------------------------------------

_COLUMNS = ("qid", "rank", "vector_id", "shard_id", "score")


def _search(name: str, sql: str, make=base, columns=_COLUMNS, **how) -> None:
    query(name, f"with {_LG}{sql}")(lambda spark, d: _score(make(spark, d).search(asked(spark, d), **how)).select(*columns))


_DOT = "list_dot_product(e, query)"
_CODED_LIVE = ", " + _coded("scalar").replace("from v)", "from (select * from live))") + ", sc as (select * from deco, q)"
_search("engine_search_exact", " " + _best(_DOT, "live, q", 10, ", source"), columns=(*_COLUMNS, "source"), top_k=10, mode=EXACT)
_search("engine_search_exactish", _CODED_LIVE + " " + _best("case when source = 'mutable' then list_dot_product(e, query) else list_dot_product(dec, query) end", "sc", 10), top_k=10, mode=EXACTISH)
_search("engine_search_compressed", _CODED_LIVE + " " + _best("list_dot_product(dec, query)", "sc", 10), top_k=10, mode=COMPRESSED)
_search("engine_search_reranked", _CODED_LIVE + f", cand as ({_best('list_dot_product(dec, query)', 'sc', 20)}) " + _best(_DOT, "(select l.vector_id, l.shard_id, e, q.qid, query from cand c join live l on l.vector_id = c.vector_id and l.shard_id = c.shard_id join q on q.qid = c.qid)", 5), top_k=5, mode=RERANKED)
_search("engine_search_shard", " " + _best(_DOT, "live, q where shard_id = 'shard-1'", 10), top_k=10, mode=EXACT, shard_id="shard-1")
_search("engine_search_filtered", " " + _best(_DOT, "live, q where region in ('us', 'eu') and tier >= 1", 10), top_k=10, mode=EXACT, filters={"region": {"in": ["us", "eu"]}, "tier": {"gte": 1}})
_search("engine_search_budget", f", bud as (select * from live where source = 'sealed' qualify row_number() over (partition by shard_id, part = 2 order by vector_id) <= 30), cut as (select * from bud union all select * from live where source = 'mutable') {_best(_DOT, 'cut, q', 10)}", top_k=10, mode=EXACT, search_budget=30)
_COMPAT_SQL = f""", dead as (select shard_id, vector_id from tail where is_deleted),
sealed as (select s.*, e from seg s join v using (vec_id) where not is_deleted and not exists (from dead where dead.shard_id = s.shard_id and dead.vector_id = s.vector_id)),
best as (select qid, vector_id, shard_id, {_DOT} as s from sealed, q qualify row_number() over (partition by qid order by s desc, vector_id, shard_id) <= 10),
both_ as (select qid, vector_id, shard_id, min(s) as s from best group by all union all select qid, vector_id, shard_id, {_DOT} as s from (select t.*, e from tail t join v using (vec_id) where not is_deleted), q),
one as (select qid, vector_id, shard_id, max(s) as m from both_ group by all) {_best("m", "one", 10)}"""
_search("engine_search_compat", _COMPAT_SQL, top_k=10, mode=EXACT, visibility=COMPAT)
_PAST = f", cl as (select * from (select * from lg where part < 3 qualify row_number() over (partition by shard_id, vector_id order by write_epoch desc) = 1) where not is_deleted), live3 as (select cl.*, f, e from cl join v using (vec_id)), {_coded('scalar').replace('from v)', 'from (select * from live3))')}, sc as (select * from deco, q)"
_search("engine_search_clustered", _PAST + " " + _best("list_dot_product(dec, query)", "sc", 10), clustered, top_k=10, mode=COMPRESSED, probe_k=CLUSTERS)
_search("engine_search_clustered_reranked", _PAST + f", cand as ({_best('list_dot_product(dec, query)', 'sc', 40)}) " + _best(_DOT, "(select l.vector_id, l.shard_id, e, q.qid, query from cand c join live3 l on l.vector_id = c.vector_id and l.shard_id = c.shard_id join q on q.qid = c.qid)", 10), clustered, top_k=10, mode=RERANKED, probe_k=CLUSTERS)
_search("engine_search_compacted", " " + _best(_DOT, "live, q", 10), compacted, top_k=10, mode=EXACT)


@query("engine_search_candidates", f"with {_LG} {_best(_DOT, 'live, q where vector_id::bigint % 2 = 0', 10)}")
def engine_search_candidates(spark, d):
    some = writes(spark, d).where(F.col("vector_id").cast("long") % 2 == 0).select("vector_id")
    return _score(base(spark, d).search(asked(spark, d), 10, EXACT, candidates=some)).select(*_COLUMNS)


@query("engine_hit_sources", f"with {_LG}, top as ({_best(_DOT, 'live, q', 20, ', source')}) select qid, count(*) filter (source = 'mutable') as mutable_hits, count(*) filter (source = 'sealed') as sealed_hits from top group by qid")
def engine_hit_sources(spark, d):
    return base(spark, d).explain_query(asked(spark, d), top_k=20, mode=EXACT).select("qid", "mutable_hits", "sealed_hits")


@query(
    "engine_inspection",
    f"""with {_LG} select 'compressed-reranked-hybrid' as mode, count(*) as before_filter, count(*) filter (region = 'us') as after_filter, count(*) filter (source = 'mutable') as mutable_live,
  (select count(distinct (shard_id, pos)) from seg) as segments, 20::bigint as candidate_k, 5 * (select count(*) from q) as results,
  case when count(*) filter (region = 'us') / count(*) <= 0.35 then 'pre-filter' else 'post-filter' end as strategy from live""",
)
def engine_inspection(spark, d):
    _, i = base(spark, d).inspect(asked(spark, d), 5, RERANKED, {"region": "us"})
    row = (i.plan.mode, i.pre_filter_candidate_count, i.post_filter_candidate_count, i.mutable_live_count, sum(map(len, i.active_segments.values())), i.plan.candidate_k, i.result_count, i.plan.filter_strategy)
    return spark.createDataFrame([row], "mode string, before_filter long, after_filter long, mutable_live long, segments long, candidate_k long, results long, strategy string")


@query(
    "engine_trace",
    f"""with {_LG}, t as ({_best(_DOT, "live, q", 3, ", source")}) select 'exact-hybrid-engine' as mode, 3::bigint as top_k, count(*) as result_count, count(*) filter (source = 'mutable') as mutable_hits, false as filters_applied, 'catalog' as collection from t""",
)
def engine_trace(spark, d):
    """The exported trace of the last query, read back from JSON."""
    engine = base(spark, d)
    engine.inspect(asked(spark, d), 3, EXACT)
    out = json.loads(json.dumps(engine.last_trace.payload({"collection": engine.collection.collection_id})))
    i = out["inspection"]
    return spark.createDataFrame([(i["mode"], i["top_k"], i["result_count"], i["mutable_hit_count"], i["filters_applied"], out["notes"]["collection"])], "mode string, top_k long, result_count long, mutable_hits long, filters_applied boolean, collection string")


# ---- clusters -----------------------------------------------------------------------------


@query("engine_clusters", f"with {_LG}, cl as (select * from lg where part < 3 qualify row_number() over (partition by shard_id, vector_id order by write_epoch desc) = 1) select shard_id, {CLUSTERS}::bigint as clusters, count(*) filter (not is_deleted) as assigned, count(*) filter (is_deleted) as tombstones, 0::bigint as not_nearest from cl group by shard_id")
def engine_clusters(spark, d):
    """Clusters of k-means in each shard's segment, and rows that are not in the cluster nearest to them."""
    engine, out = clustered(spark, d), None
    for shard in engine.shards():
        state = engine.store.load(shard)
        c = engine.store.centroids(state, shard).select("cluster_id", "centroid")
        rows = engine.sealed(shard, state).withColumn("was", F.col("cluster_id")).withColumn("decoded", engine.quantizer.decode(F.struct("codes", "scale")))
        again = ivf.assign(rows, c, "decoded")
        n = c.count()
        one = again.agg(F.count_if(~F.col("is_deleted")).alias("assigned"), F.count_if(F.col("is_deleted")).alias("tombstones"), F.count_if(~F.col("is_deleted") & (F.col("was") != F.col("cluster_id"))).alias("not_nearest"))
        one = one.select(F.lit(shard).alias("shard_id"), F.lit(n).cast("long").alias("clusters"), "assigned", "tombstones", "not_nearest")
        out = one if out is None else out.unionByName(one)
    return out


# ---- lifecycle -----------------------------------------------------------------------------


@query("engine_compacted", f"with {_LG} select shard_id, vector_id, write_epoch from (select * from seg qualify row_number() over (partition by shard_id, vector_id order by write_epoch desc) = 1) where not is_deleted")
def engine_compacted(spark, d):
    _, sealed = compacted(spark, d)._rows(compacted(spark, d)._snapshot(None))
    return sealed.select("shard_id", "vector_id", "write_epoch")


@query("engine_garbage", f"with {_LG} select shard_id, count(distinct pos) as removed from seg group by shard_id")
def engine_garbage(spark, d):
    return spark.createDataFrame([(s, len(g)) for s, g in compacted(spark, d).garbage.items()], "shard_id string, removed long")


@query("engine_integrity", "select 0::bigint as violations, 0::bigint as broken, 2::bigint as shards, 2::bigint as segments")
def engine_integrity(spark, d):
    engine = compacted(spark, d)
    feet = [f for s in engine.shards() for f in engine.store.footprint(s)]
    return spark.createDataFrame([(engine.violations().count(), len(engine.verify_integrity()), len(engine.shards()), len(feet))], "violations long, broken long, shards long, segments long")


@query(
    "engine_stats",
    f"with {_LG} select 2::bigint as shards, (select count(distinct (shard_id, pos)) from seg) as segments, count(*) filter (not is_deleted) as live_rows, round(count(*) filter (is_deleted) / count(*), 9) as delete_ratio, (select count(*) from tail) as mutable_rows from seg",
)
def engine_stats(spark, d):
    s = base(spark, d).stats()
    return spark.createDataFrame([(s["shards"], s["segments"], s["live_rows"], round(s["delete_ratio"], 9), s["mutable_rows"])], "shards long, segments long, live_rows long, delete_ratio double, mutable_rows long")


@query("engine_live_fractions", f"with {_LG} select shard_id, round(count(*) filter (not is_deleted) / count(*), 9) as live_fraction from seg group by shard_id")
def engine_live_fractions(spark, d):
    return base(spark, d).live_fractions().select("shard_id", F.round("live_fraction", 9).alias("live_fraction"))


@query(
    "engine_maintenance_rank",
    f"""with {_LG}, t as (select shard_id, count(distinct pos) as segments, count(*) as total_rows, count(*) filter (is_deleted) / count(*) as ratio from seg group by shard_id),
m as (select shard_id, count(*) as mutable_rows from tail where not is_deleted group by shard_id)
select shard_id, segments, total_rows, mutable_rows, round((segments - 1) + 2.0 * ratio + total_rows / 100000.0 + 0.5 * mutable_rows / 100000.0, 6) as score from t join m using (shard_id)""",
)
def engine_maintenance_rank(spark, d):
    return base(spark, d).maintenance_rank().select("shard_id", "segments", "total_rows", "mutable_rows", F.round("score", 6).alias("score"))


@query("engine_audit", f"with {_LG} select 'catalog' as collection_id, count(*) as entries, count(*) filter (not is_deleted) as upserts, count(*) filter (is_deleted) as deletes, max(write_epoch) as max_epoch, count(distinct vector_id) as vectors from lg")
def engine_audit(spark, d):
    return base(spark, d).audit()


@query("engine_last_epoch", "select count(*) as last_epoch, count(*) as in_log from events")
def engine_last_epoch(spark, d):
    engine = base(spark, d)
    return spark.createDataFrame([(engine.last_epoch(), engine.log.replay().count())], "last_epoch long, in_log long")


@query("engine_cache", "select 2::bigint as entries, 2::bigint as hits, 6::bigint as misses, 4::bigint as evictions, 0::bigint as invalidations")
def engine_cache(spark, d):
    """Four segments read once and then the last two again, through a cache of two."""
    b = base(spark, d)
    store = _engine(spark, b.storage.root.removesuffix("/catalog"), cached_segments=2).store
    for shard in ("shard-0", "shard-1", "shard-0", "shard-0"):
        store.read(store.load(shard), shard, b.metadata_type, b.id_type)
    s = store.cache.stats()
    store.cache.clear()
    return spark.createDataFrame([tuple(s[k] for k in ("entries", "hits", "misses", "evictions")) + (0,)], "entries long, hits long, misses long, evictions long, invalidations long")


@query("engine_paths", f"select unnest(['exact-hybrid', 'compressed-hybrid', 'compressed-reranked-hybrid']) as path, count(*) as queries, 5::bigint as top_k, unnest([1.0::double, null, null]) as recall from embeddings where vec_id % {EVERY} = 0")
def engine_paths(spark, d):
    """The benchmark paths; only the recall of the exact one is a constant."""
    rows = [(r.path, r.queries, r.top_k, r.recall if r.path == "exact-hybrid" else None) for r in run_paths(base(spark, d), asked(spark, d), 5)]
    return spark.createDataFrame(rows, "path string, queries long, top_k long, recall double")


# ---- the sidecar ------------------------------------------------------------------------------

_STATUS = "case when doc_id % 10 = 3 then 'unpublished' else 'published' end"
_SIDE = f"""{_HOST.replace("case when toxic = 1 then 'unpublished' else 'published' end", "'published'")}, {_EMB}, idx as (select 'document:' || document_id as vector_id, document_id, region, e::float[] as f, e::float[]::double[] as e, text from emb)"""


@_kept("sidecar")
def sidecar(spark, d, root) -> Sidecar:
    """All documents in the host and the index; then each tenth is unpublished in the host alone, and an eleventh removed."""
    files = ParquetHost(spark, f"{root}/host")
    docs = host(spark, d).select(F.col("document_id").cast("string").alias("document_id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("body"), "region", F.lit("published").alias("status"))
    files.upsert(docs)
    side = Sidecar(spark, f"{root}/index", files, groups=GROUPS, options=EngineOptions(ivf_auto_threshold=None))
    side.backfill()
    side.flush()
    number = F.col("document_id").cast("long")
    files.set_status(docs.where(number % 10 == 3).select("document_id"), "unpublished")
    files.delete(docs.where(number % 11 == 5).select("document_id"))
    return side


@query("sidecar_index", f"with {_SIDE} select vector_id, region, round(e[1], 4) as e1, round(e[2], 4) as e2, round(e[3], 4) as e3, round(e[4], 4) as e4 from idx")
def sidecar_index(spark, d):
    rows = sidecar(spark, d).engine.visible()
    return rows.select("vector_id", "metadata.region", *[F.round(F.element_at("embedding", k).cast("double"), 4).alias(f"e{k}") for k in (1, 2, 3, 4)])


@query("host_documents", f"select doc_id::varchar as document_id, lang as region, {_STATUS} as status from documents where doc_id % 11 <> 5")
def host_documents(spark, d):
    return sidecar(spark, d).host.documents().select("document_id", "region", "status")


@query("host_published", "select doc_id::varchar as document_id from documents where doc_id % 11 <> 5 and doc_id % 10 <> 3")
def host_published(spark, d):
    return sidecar(spark, d).host.documents(False).select("document_id")


@query("sidecar_known", "select doc_id::varchar as document_id from documents")
def sidecar_known(spark, d):
    return sidecar(spark, d).known().select("document_id")


@query("sidecar_drift", "select doc_id::varchar as document_id, 'absent' as should, 'indexed' as \"is\" from documents where doc_id % 11 = 5 or doc_id % 10 = 3")
def sidecar_drift(spark, d):
    return sidecar(spark, d).drift()


_SIDE_TOP = f"""{_SIDE}, v as (select vector_id, document_id, region, f, e from idx), {_coded("scalar")}, aq as (select document_id as qid, e as exact from emb where document_id % {EVERY} = 0),
cand as (select qid, vector_id, document_id, exact, e from (select * from deco, aq) qualify row_number() over (partition by qid order by list_dot_product(dec, exact) desc, vector_id) <= 10),
top as (select qid, row_number() over (partition by qid order by list_dot_product(e, exact) desc, vector_id)::int as rank, document_id from cand qualify rank <= 5)"""


@query("sidecar_hits", f"with {_SIDE_TOP} select qid, rank, document_id::varchar as document_id from top where document_id % 11 <> 5 and document_id % 10 <> 3")
def sidecar_hits(spark, d):
    """Reranked candidates of the index; what the host no longer publishes is left out."""
    texts = host(spark, d).where(F.col("document_id") % EVERY == 0).select(F.col("document_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    return sidecar(spark, d).search(texts, 5).select("qid", "rank", "document_id")


@_kept("outbox")
def events_done(spark, d, root) -> tuple[Sidecar, outbox.Outbox]:
    """An event for each document, in one pass that stops and one that does not."""
    files = ParquetHost(spark, f"{root}/host")
    side = Sidecar(spark, f"{root}/index", files, groups=GROUPS, options=EngineOptions(ivf_auto_threshold=None))
    box = outbox.Outbox(spark, f"{root}/outbox")
    docs = host(spark, d).select(F.col("document_id").cast("string").alias("document_id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("body"), "region", "status")
    files.upsert(docs)
    number = F.col("document_id").cast("long")
    operation = F.when(number.isin(50, 70), "explode").when(F.col("status") == "unpublished", "unpublish").otherwise("upsert")
    box.enqueue(docs.select(number.alias("n"), "document_id", operation.alias("operation")), ["n"])
    try:
        outbox.process(side, box)
    except outbox.UnknownOperation as e:
        box.first_failure = e.event_id
    box.after_one = box.events().select("event_id", "status", "attempts").checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else spark.createDataFrame(box.events().select("event_id", "status", "attempts").collect(), "event_id long, status string, attempts int")
    outbox.drain(side, box)
    return side, box


_NTH = "n as (select doc_id, row_number() over (order by doc_id) as event_id from documents)"


@query("outbox_after_failure", f"with {_NTH}, b as (select min(event_id) as bad from n where doc_id in (50, 70)) select event_id, case when event_id < bad then 'processed' when event_id = bad then 'failed' else 'pending' end as status, (event_id <= bad)::int as attempts from n, b")
def outbox_after_failure(spark, d):
    return events_done(spark, d)[1].after_one


@query("outbox_drained", f"with {_NTH} select event_id, doc_id::varchar as document_id, case when doc_id in (50, 70) then 'failed' else 'processed' end as status, 1 as attempts, case when doc_id in (50, 70) then 'unknown operation explode' end as error from n")
def outbox_drained(spark, d):
    return events_done(spark, d)[1].events().select("event_id", "document_id", "status", "attempts", "error")


@query("outbox_index", f"with {_HOST} select 'document:' || document_id as vector_id from host where status = 'published' and document_id not in (50, 70)")
def outbox_index(spark, d):
    return events_done(spark, d)[0].engine.visible().select("vector_id")


# ---- fixtures --------------------------------------------------------------------------------


@query("fixture_lattice", "select 'v' || i as vector_id, round((i % 16) / 15, 6) as x, round(((7 * i) % 16) / 15, 6) as y, (i % 4)::int as bucket, case when i % 2 = 0 then 'even' else 'odd' end as family from range(256) t(i)")
def fixture_lattice(spark, d):
    return _points(fixtures.lattice(spark))


@query("fixture_xlarge", "select 'doc-' || i as vector_id, round((i % 32) / 31, 6) as x, round(((11 * i) % 32) / 31, 6) as y, (i % 8)::int as bucket, ['alpha', 'beta', 'gamma'][i % 3 + 1] as family from range(512) t(i)")
def fixture_xlarge(spark, d):
    return _points(fixtures.xlarge(spark))


def _points(rows: DataFrame) -> DataFrame:
    at = lambda k: F.round(F.element_at("embedding", k).cast("double"), 6)
    return rows.select("vector_id", at(1).alias("x"), at(2).alias("y"), "metadata.bucket", "metadata.family")


@query("fixture_highdim", "select 'v' || i as vector_id, round(list_sum([((i * (j + 3)) % 17) / 16 for j in range(8)]), 5) as total from range(256) t(i)")
def fixture_highdim(spark, d):
    return fixtures.highdim(spark).select("vector_id", F.round(F.aggregate(V.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("fixture_scale", "select 'v' || i as vector_id, (i % 20)::int as cluster, (i // 1000)::int as batch, 128 as dim, 1.0::double as length from range(3000) t(i)")
def fixture_scale(spark, d):
    rows = fixtures.scale(spark, 3000)
    return rows.select("vector_id", "metadata.cluster", "metadata.batch", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 5).alias("length"))


@query("fixture_tiny_topk", "with i as (select unnest(['a', 'b', 'c', 'd']) as vector_id, unnest([[1.0, 0.0], [0.0, 1.0], [0.8, 0.2], [0.2, 0.8]]::float[][])::double[] as e), q as (select unnest([0, 1, 2])::int as qid, unnest([[0.9, 0.1], [0.1, 0.9], [0.75, 0.25]]::double[][]) as query) " + _top("list_dot_product(e, query)", "i, q", 2))
def fixture_tiny_topk(spark, d):
    items, queries = fixtures.tiny(spark)
    return _score(K.top_k_batch(items, queries, 2))


@query("fixture_json", "select doc_id::varchar as vector_id, n_chars::bigint as n_chars, length(lang)::double as x from documents")
def fixture_json(spark, d):
    """A dataset written in the JSON layout of fixtures, one file, and read by the fixture reader."""
    path = f"{shared_folder(spark)}/catalog-fixture-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    item = F.struct(F.col("doc_id").cast("string").alias("vector_id"), F.array(F.length("lang").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.struct("n_chars").alias("metadata"))
    docs.agg(F.lit("all").alias("name"), F.collect_list(item).alias("items"), F.lit([[1.0, 0.0]]).cast("array<array<double>>").alias("queries")).write.json(path)
    items, _ = fixtures.load_fixture(spark, path)
    return items.select("vector_id", F.col("metadata.n_chars").alias("n_chars"), F.element_at("embedding", 1).cast("double").alias("x"))




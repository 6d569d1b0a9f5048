"""The engine against a model that is a dictionary, and the cases that define its contract."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quiverlake.operators import lifecycle as L
from quiverlake.operators import visibility as VIS
from quiverlake.plans.engine import COMPAT, COMPRESSED, EXACT, EXACTISH, RERANKED, Engine, EngineOptions
from quiverlake.schema import Collection


@pytest.fixture
def make(spark, tmp_path):
    def build(dim=2, schema=None, **options):
        return Engine(spark, str(tmp_path), Collection("c", dim, schema or {"region": "keyword", "n": "int"}), EngineOptions(**({"ivf_auto_threshold": None} | options)))

    return build


def ask(spark, *vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "qid int, query array<double>")


def ids(engine, spark, vector, k=10, **how):
    return [r["vector_id"] for r in engine.search(ask(spark, vector), k, **how).orderBy("rank").collect()]


def test_model(spark, make):
    rng = random.Random(12)
    engine, model = make(), {}
    for _ in range(5):
        batch = []
        for _ in range(rng.randint(2, 8)):
            shard, name = f"shard-{rng.randrange(2)}", f"v{rng.randrange(6)}"
            if rng.random() < 0.3:
                batch.append((len(batch), shard, name, None))
                model.pop((shard, name), None)
            else:
                v = [rng.random(), rng.random()]
                batch.append((len(batch), shard, name, v))
                model[shard, name] = v
        engine.append(spark.createDataFrame(batch, "seq int, shard_id string, vector_id string, embedding array<float>"), ["seq"])
        act = rng.choice(["flush", "flush", "compact", "reopen"])
        shard = f"shard-{rng.randrange(2)}"
        if act == "flush":
            engine.flush(shard, truncate_log=rng.random() < 0.5)
        elif act == "compact":
            engine.compact(shard, limits=L.CompactionLimits(min_segment_count=1))
        else:
            engine = make()
        seen = {(r["shard_id"], r["vector_id"]): list(r["embedding"]) for r in engine.visible().collect()}
        assert seen.keys() == model.keys()
        assert all(seen[k] == pytest.approx(model[k]) for k in model)


def test_delete_stays_deleted_over_flush_and_partial_compaction(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], {"region": "us"}), ("b", [0, 1], {"region": "ca"})])
    first = engine.flush()["segment_id"]
    engine.delete(["a"])
    assert ids(engine, spark, [1, 0]) == ["b"]
    second = engine.flush()
    assert (second["row_count"], second["live_row_count"], second["deleted_row_count"]) == (1, 0, 1)
    assert ids(engine, spark, [1, 0]) == ["b"]
    engine.upsert([("c", [0.5, 0.5], None)])
    engine.flush()
    engine.compact(segment_ids=[s for s in engine.store.load("shard-0").active if s != first])
    assert sorted(ids(engine, spark, [1, 0])) == ["b", "c"]
    engine.compact(segment_ids=engine.store.load("shard-0").active)
    m = engine.store.manifests().where("state = 'active'").collect()
    assert [(r["row_count"], r["deleted_row_count"], r["min_write_epoch"], r["max_write_epoch"]) for r in m] == [(2, 0, 1, 4)]
    gone = engine.collect_garbage()
    assert len(gone) == 4 and engine.collect_garbage() == []
    assert make().stats()["live_rows"] == 2 and engine.verify_integrity() == []


def test_tail_over_compacted(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], None), ("b", [0, 1], None)])
    engine.flush(truncate_log=True)
    engine.upsert([("c", [0.9, 0.1], None)])
    engine = make()
    assert engine.recover() == 1
    for mode in (EXACT, EXACTISH, COMPRESSED, RERANKED):
        assert ids(engine, spark, [1, 0], mode=mode) == ["a", "c", "b"]


def test_latest_and_compat_differ_on_stale_versions(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], None), ("b", [0.5, 0], None)])
    engine.flush()
    engine.upsert([("a", [0.1, 0], None)])
    hits = lambda v: [(r["vector_id"], round(r["score"], 2)) for r in engine.search(ask(spark, [1, 0]), 2, visibility=v).orderBy("rank").collect()]
    assert hits("latest") == [("b", 0.5), ("a", 0.1)]
    assert hits(COMPAT) == [("a", 1.0), ("b", 0.5)]
    engine.delete(["a"])
    engine.flush()
    assert hits("latest") == [("b", 0.5)]


def test_filters_and_candidates(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], {"region": "us", "n": 1}), ("b", [0.9, 0], {"region": "ca", "n": 2}), ("c", [0.8, 0], {"region": "us", "n": 3})])
    engine.flush()
    engine.upsert([("d", [0.7, 0], {"region": "us", "n": 4}), ("e", [0.6, 0], None)])
    assert ids(engine, spark, [1, 0], filters={"region": "us"}) == ["a", "c", "d"]
    assert ids(engine, spark, [1, 0], filters={"region": {"in": ["us", "ca"]}, "n": {"gte": 2, "lte": 3}}) == ["b", "c"]
    assert ids(engine, spark, [1, 0], filters={"region": None}) == ["e"]
    some = spark.createDataFrame([("b",), ("e",)], "vector_id string")
    assert ids(engine, spark, [1, 0], candidates=some) == ["b", "e"]
    assert ids(engine, spark, [1, 0], candidates=some.limit(0)) == []
    assert ids(engine, spark, [1, 0], k=0) == []
    with pytest.raises(ValueError):
        engine.search(ask(spark, [1, 0]), 3, filters={"n": {"near": 1}})
    plan = engine.plan(2, RERANKED, {"region": "ca"})
    assert (plan.mode, plan.candidate_k, plan.filter_strategy) == ("compressed-reranked-hybrid", 8, "pre-filter")
    one = engine.explain_query(ask(spark, [1, 0]), top_k=5, mode=EXACT).first()
    assert (one["mutable_hits"], one["sealed_hits"]) == (2, 3)


def test_shards_are_apart(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], None)], "shard-0")
    engine.upsert([("a", [0.5, 0], None)], "shard-1")
    engine.delete(["a"], "shard-0")
    assert ids(engine, spark, [1, 0], shard_id="shard-0") == [] and ids(engine, spark, [1, 0], shard_id="shard-1") == ["a"]
    engine.flush("shard-0", truncate_log=True)
    assert ids(engine, spark, [1, 0]) == ["a"]


@pytest.mark.parametrize("metric", ["dot_product", "cosine", "l2"])
def test_one_id_in_several_shards(spark, tmp_path, metric):
    """All modes and both visibilities against a dictionary, with the same ids in three shards."""
    rng = random.Random(14)
    engine = Engine(spark, str(tmp_path), Collection("c", 3, {"n": "int"}, metric), EngineOptions(ivf_auto_threshold=None, ivf_n_clusters=2))
    model, sealed = {}, {}
    for step in range(2):
        rows = [(k, f"shard-{k % 3}", f"v{k % 4}", [rng.uniform(0.1, 1) * (1 + k) for _ in range(3)]) for k in range(12)]
        rows = [(*r, {"n": r[0]}) for r in rows if step == 0 or r[0] % 5]
        if step:
            rows.append((99, "shard-1", "v1", None, None))
        engine.append(spark.createDataFrame(rows, "seq int, shard_id string, vector_id string, embedding array<float>, metadata struct<n: long>"), ["seq"])
        for _, s, v, e, _ in rows:
            model[s, v] = e
        if step == 0:
            for s in engine.shards():
                engine.flush(s)
            sealed = dict(model)
    model = {k: e for k, e in model.items() if e}
    q = [1.0, 0.3, 0.2]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    measure = {"dot_product": dot, "cosine": lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, "l2": lambda a, b: -sum((x - y) ** 2 for x, y in zip(a, b, strict=True))}[metric]
    want = sorted(((-measure(e, q), v, s) for (s, v), e in model.items()))
    for mode in (EXACT, EXACTISH, COMPRESSED, RERANKED):
        for probe in (None, 2):
            got = [(r["vector_id"], r["shard_id"], r["score"]) for r in engine.search(ask(spark, q), 5, mode, probe_k=probe).orderBy("rank").collect()]
            assert len({g[:2] for g in got}) == 5
            if mode in (EXACT, RERANKED):
                assert [g[:2] for g in got] == [(v, s) for _, v, s in want[:5]]
                assert [g[2] for g in got] == pytest.approx([-w for w, *_ in want[:5]], abs=1e-5)
    # Compat: of an id in a shard the better of its sealed and mutable score counts, unless the tail deletes it.
    best = {k: max(measure(e, q) for e in (model[k], sealed.get(k, model[k]))) for k in model}
    want = sorted((-x, v, s) for (s, v), x in best.items())
    got = engine.search(ask(spark, q), 5, EXACT, visibility=COMPAT).orderBy("rank").collect()
    assert [(r["vector_id"], r["shard_id"]) for r in got] == [(v, s) for _, v, s in want[:5]]
    assert [r["score"] for r in got] == pytest.approx([-w for w, *_ in want[:5]], abs=1e-5)


def test_inspection(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], {"region": "us", "n": 1}), ("b", [0.9, 0], {"region": "ca", "n": 2}), ("c", [0.8, 0], {"region": "us", "n": 3})])
    engine.flush()
    engine.upsert([("d", [0.7, 0], {"region": "us", "n": 4})])
    hits, seen = engine.inspect(ask(spark, [1, 0]), 1, RERANKED, {"region": "us"})
    assert [h["vector_id"] for h in hits] == ["a"] and engine.last_trace is seen
    assert (seen.mutable_live_count, seen.pre_filter_candidate_count, seen.post_filter_candidate_count, seen.candidate_generation_count) == (1, 4, 3, 3)
    assert (seen.mutable_hit_count, seen.sealed_hit_count, seen.result_count) == (0, 1, 1) and seen.total_ms >= seen.rerank_ms > 0
    out = json.loads(json.dumps(seen.payload({"collection": "c"})))
    assert out["inspection"]["mode"] == "compressed-reranked-hybrid-engine" and out["inspection"]["rerank_candidate_k"] == 4 and out["notes"] == {"collection": "c"}
    (foot,) = engine.store.footprint("shard-0")
    assert foot["vectors"] == 3 and foot["files"] > 0 and foot["bytes"] > 0


def test_buffer_keeps_first_time_and_metadata(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], {"region": "us", "n": 1}), ("b", [0, 1], {"region": "ca", "n": 2})])
    engine.upsert([("a", [0.5, 0], {"region": "eu", "n": 3})])
    engine.delete(["a", "z"])
    rows = {r["vector_id"]: r for r in engine.buffer("shard-0").collect()}
    assert rows["a"]["is_deleted"] and rows["a"]["embedding"] is None and rows["a"]["metadata"]["region"] == "eu" and rows["a"]["created_at"] < rows["a"]["updated_at"]
    assert rows["z"]["metadata"] is None and not rows["b"]["is_deleted"]
    kept, gone = VIS.removed(engine.buffer("shard-0"), spark.createDataFrame([("shard-0", "a"), ("shard-0", "none")], "shard_id string, vector_id string"))
    assert sorted(r["vector_id"] for r in kept.collect()) == ["b", "z"] and [r["vector_id"] for r in gone.collect()] == ["a"]


def test_format_version_is_checked(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], None)])
    engine.flush()
    state = engine.store.load("shard-0")
    (segment,) = state.active
    state.segments[segment]["format_version"] = 99
    engine.store.publish("shard-0", state)
    with pytest.raises(ValueError, match="format"):
        engine.visible()


def test_flush_without_rows_and_auto_flush(spark, make):
    assert make().flush() is None
    engine = make(flush_threshold=3)
    engine.upsert([(f"v{k}", [k, 1], None) for k in range(3)])
    assert len(engine.store.load("shard-0").active) == 1 and engine.tail("shard-0").count() == 0


def test_dimension_is_checked(make):
    with pytest.raises(Exception, match="components"):
        make().upsert([("a", [1, 2, 3], None)])


def test_clusters(spark, make):
    rng = random.Random(13)
    engine = make(dim=8, schema={"n": "int"}, ivf_n_clusters=6)
    rows = [(f"v{k:03d}", [rng.gauss(0, 1) + 3 * (k % 4 == j % 4) for j in range(8)], {"n": k}) for k in range(200)]
    engine.upsert(rows)
    engine.flush()
    centroids = engine.store.centroids(engine.store.load("shard-0"), "shard-0")
    assert centroids.count() == 6
    queries = ask(spark, *[v for _, v, _ in rows[:8]])
    found = lambda **how: {q: [r["vector_id"] for r in sorted(g, key=lambda r: r["rank"])] for q, g in _by_query(engine.search(queries, 5, **how)).items()}
    exact = found(mode=EXACTISH)
    recall = lambda got: sum(len(set(got.get(q, [])) & set(exact[q])) for q in exact) / sum(map(len, exact.values()))
    narrow, wide, every = (recall(found(mode=COMPRESSED, probe_k=p)) for p in (1, 3, 6))
    assert narrow <= wide <= every and every == 1.0
    assert recall(found(mode=RERANKED, probe_k=1)) >= narrow
    assert found(mode=COMPRESSED, probe_k=6) == found(mode=COMPRESSED)
    few = found(mode=COMPRESSED, search_budget=10)
    assert all(int(v[1:]) < 10 for vs in few.values() for v in vs)
    plan = engine.sealed("shard-0").where("cluster_id in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cluster_id" in plan


def _by_query(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r["qid"], []).append(r)
    return out


def test_corruption_is_found(make, tmp_path):
    engine = make()
    engine.upsert([("a", [1, 0], None)])
    segment = engine.flush()["segment_id"]
    files = [p for p in tmp_path.rglob("*.parquet") if segment in str(p) and p.is_file()]
    files[0].write_bytes(files[0].read_bytes() + b"x")
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    assert engine.verify_integrity() == [{"shard_id": "shard-0", "segment_id": segment, "issue": "checksum"}]


def test_unpublished_segment_is_not_seen(spark, make, monkeypatch):
    engine = make()
    engine.upsert([("a", [1, 0], None)])
    monkeypatch.setattr(engine.store, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        engine.flush(segment_id="seg-x")
    engine = make()
    assert engine.recover() == 1 and ids(engine, spark, [1, 0]) == ["a"]
    stale = engine.store.load("shard-0")
    engine.flush()
    with pytest.raises(RuntimeError, match="meanwhile"):
        engine.store.publish("shard-0", stale)


def test_log_truncation_and_reports(spark, make):
    engine = make()
    engine.upsert([("a", [1, 0], None), ("b", [1, 0], None), ("c", [1, 0], None)])
    engine.delete(["a", "zz"])
    row = engine.audit().first()
    assert (row["entries"], row["upserts"], row["deletes"], row["max_epoch"], row["vectors"]) == (5, 3, 2, 5, 4)
    assert tuple(engine.log_snapshot().first()) == (2, 2)
    assert engine.log.truncate(2, "shard-0") == 2
    assert [r["write_epoch"] for r in engine.log.replay().orderBy("write_epoch").collect()] == [3, 4, 5]
    assert engine.log.replay(4).count() == 1 and engine.last_epoch() == 5
    assert engine.violations().count() == 0


def test_maintenance(make):
    engine = make()
    for k in range(3):
        engine.upsert([(f"v{k}", [k, 1], None)], "shard-1")
        engine.flush("shard-1")
    engine.upsert([("x", [1, 1], None)], "shard-0")
    ranked = engine.maintenance_rank().collect()
    assert [r["shard_id"] for r in ranked] == ["shard-1"] and ranked[0]["score"] == pytest.approx(2 + 3 / 100_000)
    assert engine.compact_most_urgent()["row_count"] == 3
    assert engine.maybe_compact("shard-1") is None
    assert engine.live_fractions().where("shard_id = 'shard-1'").select(F.col("live_fraction")).first()[0] == 1.0

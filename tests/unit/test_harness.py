from quiverlake.plans.engine import Engine, EngineOptions
from quiverlake.plans.harness import Scenario, run_scenario
from quiverlake.schema import Collection
from quiverlake.sources.cache import SegmentCache


def test_scenario(spark, tmp_path):
    s = Scenario("t", 120, 8, shards=2, delete_ratio=0.1, clusters=4, probe_k=2, queries=6)
    got = {r["path"]: r for r in run_scenario(spark, str(tmp_path), s, 5).collect()}
    assert len(got) == 3 and {r["live_rows"] for r in got.values()} == {108}
    assert got["exact-hybrid"]["recall"] == 1.0
    assert got["compressed-reranked-hybrid"]["recall"] >= 0.9 and got["compressed-hybrid"]["recall"] > 0.3


def test_cache(spark, tmp_path):
    made = []
    cache = SegmentCache(2)
    take = lambda k: cache.get(k, lambda: made.append(k) or spark.range(3))
    for k in ("s/a", "s/b", "s/a", "s/c", "s/b"):
        take(k).count()
    assert made == ["s/a", "s/b", "s/c", "s/b"]
    assert cache.stats() == {"entries": 2, "hits": 1, "misses": 4, "evictions": 2, "invalidations": 0, "hit_rate": 0.2}
    assert cache.invalidate("s/c") == 1 and cache.invalidate("x") == 0
    engine = Engine(spark, str(tmp_path), Collection("c", 2), EngineOptions(ivf_auto_threshold=None, cached_segments=4))
    engine.upsert([("a", [1, 0], None)])
    engine.flush()
    for _ in range(2):
        assert engine.visible().count() == 1
    assert engine.store.cache.stats()["hits"] >= 1
    engine.compact(segment_ids=engine.store.load("shard-0").active)
    engine.collect_garbage()
    assert engine.visible().count() == 1 and engine.recover_all() == {"shard-0": 0}

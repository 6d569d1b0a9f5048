import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import metrics as M
from quiverlake.functions import text as X
from quiverlake.functions import vectors as V
from quiverlake.functions.quantizers import QUANTIZERS, quantizer
from quiverlake.operators import audit, ivf
from quiverlake.operators import filters as FL
from quiverlake.operators import topk as K
from quiverlake.operators import visibility as VIS
from quiverlake.schema import Collection
from quiverlake.sources import fixtures, reports


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_vector_arithmetic(spark):
    a, b = V.literal([1, 2, 3]), V.literal([0, 1, -1])
    assert _one(spark, V.dot(a, b)) == -1.0 and _one(spark, V.squared_l2(a, b)) == 18.0
    assert _one(spark, V.cosine(a, V.literal([0, 0, 0]))) is None
    assert _one(spark, V.rolled(a, 1)) == [3, 1, 2] and _one(spark, V.rolled(a, -1)) == [2, 3, 1] and _one(spark, V.rolled(a, 5)) == [2, 3, 1]
    assert _one(spark, V.unit(V.literal([0, 0]))) == [0, 0]
    with pytest.raises(Exception, match="components"):
        _one(spark, V.dot(a, V.literal([1, 2])))


def _numpy_codes(name, v):
    x = np.asarray(v, np.float32)
    if name in ("residual", "centered"):
        x = (x - np.float32(x.astype(np.float64).sum() / x.size)).astype(np.float32)
    if name == "normalized" and np.abs(x).max() > 0:
        x = (x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum())).astype(np.float32)
    x = np.roll(x, {"rotate": 1, "shift": 2, "centered": 1}.get(name, 0))
    top = float(np.abs(x.astype(np.float64)).max())
    scale = top / 127 if top else 1.0
    return np.clip(np.rint(x / np.float32(scale)), -127, 127).astype(int).tolist(), scale, x


@pytest.mark.parametrize("name", sorted(QUANTIZERS))
def test_quantisers_match_numpy(spark, name):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(50)] + [(50, [0.0] * 16), (51, [1.0] + [0.5] * 15)]
    q = QUANTIZERS[name]
    query = rng.normal(size=16).tolist()
    d = spark.createDataFrame(rows, "k int, v array<float>").withColumn("e", q.encode(F.col("v")))
    d = d.select("k", "v", "e", q.decode(F.col("e")).alias("dec"), q.restored(F.col("e")).alias("back"), q.approx_score(V.literal(query), F.col("e")).alias("s"))
    off = 0
    for r in d.collect():
        codes, scale, prepared = _numpy_codes(name, r["v"])
        off += sum(a != b for a, b in zip(codes, r["e"]["codes"], strict=True))
        assert r["e"]["scale"] == pytest.approx(scale, rel=1e-5)
        assert np.abs(np.array(r["dec"]) - prepared).max() <= r["e"]["scale"] * 0.51
        assert r["s"] == pytest.approx(float(np.dot(_numpy_codes(name, query)[2].astype(np.float64), np.array(r["dec"]))), abs=1e-5)
        if name in ("scalar", "rotate", "shift"):
            assert np.abs(np.array(r["back"]) - np.array(r["v"])).max() <= r["e"]["scale"] * 0.51
    assert off <= 1
    assert quantizer(name, 7).levels == 7


ROWS = [("a", "us", True, 10, 2), ("b", "us", False, 5, 10), ("c", "ca", True, 7, 20), ("d", "uk", True, 2, 40), ("e", None, None, None, None)]


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({"region": {"eq": "us"}}, "ab"), ({"region": {"in": ["us", "ca"]}}, "abc"), ({"score": {"gte": 6}}, "ac"), ({"age_days": {"gte": 5, "lte": 20}}, "bc"),
        ({"region": "us", "active": True}, "a"), ({"region": None}, "e"), ({}, "abcde"), (None, "abcde"), ({"region": {"in": ["uk", None]}}, "de"), ({"region": {"in": []}}, ""), ({"score": {}}, "abcde"),
    ],
)
def test_filters(spark, filters, want):
    d = spark.createDataFrame(ROWS, "vector_id string, region string, active boolean, score int, age_days int")
    assert "".join(sorted(r["vector_id"] for r in FL.apply_filter(d, filters).collect())) == want


def test_filter_plans(spark):
    d = spark.createDataFrame(ROWS[:4], "vector_id string, region string, active boolean, score int, age_days int")
    uk, on = FL.plan_filter(d, {"region": "uk"}, threshold=0.3), FL.plan_filter(d, {"active": True}, threshold=0.3)
    assert (uk.selectivity, uk.strategy, on.selectivity, on.strategy) == (0.25, "pre-filter", 0.75, "post-filter")
    assert FL.plan_filter(d, None).strategy == "no-filter" and FL.plan_filter(d.limit(0), {"region": "us"}).selectivity == 0.0
    with pytest.raises(ValueError, match="unknown filter"):
        FL.predicate({"region": {"like": "u"}})
    assert {(r["key"], r["value"]): r["n"] for r in FL.postings(d, ["region"]).collect()} == {("region", "us"): 2, ("region", "ca"): 1, ("region", "uk"): 1}


def test_filters_reach_the_scan(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = K.top_k(FL.apply_filter(d, {"label": {"gte": 3}}).withColumnRenamed("vec_id", "vector_id"), [0.0] * 64, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(label), GreaterThanOrEqual(label,3)]" in plan or "GreaterThanOrEqual(label,3)" in plan
    assert "TakeOrderedAndProject" in plan


def test_top_k_ties_blocks_and_nulls(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(10)] + [(99, None)], "vector_id int, embedding array<float>")
    q = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(5)], "qid int, query array<double>")
    one = sorted(map(tuple, K.top_k_batch(rows, q, 3).collect()))
    assert one == [(k, r, v, 1.0) for k in range(5) for r, v in ((1, 1), (2, 3), (3, 5))]
    assert sorted(map(tuple, K.top_k_batch(rows, q, 3, most=2).collect())) == one
    assert sorted(map(tuple, K.top_k_native(rows, q, 3).collect())) == one
    assert K.top_k_batch(rows, q, 0).collect() == K.top_k_batch(rows.limit(0), q, 3).collect() == K.top_k_batch(rows, q.limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        K.top_k_native(rows, q, 3, most=4)


def test_second_scores_against_a_loop(spark):
    rng = np.random.default_rng(5)
    coarse, fine = rng.integers(-2, 3, (60, 4)).astype(float), rng.normal(size=(60, 4))
    fine[7] = np.inf
    rows = spark.createDataFrame([(f"v{i:02}", c.tolist(), f.tolist()) for i, (c, f) in enumerate(zip(coarse, fine, strict=True))], "vector_id string, code array<double>, embedding array<float>").repartition(5)
    q = rng.normal(size=(3, 4))
    queries = spark.createDataFrame([(i, v.tolist(), (-v).tolist()) for i, v in enumerate(q)], "qid int, query array<double>, again array<double>")
    want = []
    for i, v in enumerate(q):
        near = sorted(range(60), key=lambda r: (-(coarse[r] * v).sum(), r))[:12]
        second = {r: -(fine[r].astype(np.float32).astype(float) * v).sum() for r in near if r != 7}
        want += [(i, n + 1, f"v{r:02}", round(second[r], 9)) for n, r in enumerate(sorted(second, key=lambda r: (-second[r], r))[:4])]
    for most in (100, 2):
        found = K.top_k_batch(rows, queries, 12, F.col("code"), most=most, again=F.col("embedding"))
        assert sorted((r["qid"], r["rank"], r["vector_id"], round(r["score"], 9)) for r in K.top_k_again(found, 4).collect()) == want
    assert K.top_k_again(K.top_k_batch(rows, queries.limit(0), 12, F.col("code"), again=F.col("embedding")), 4).collect() == []


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("s", "a", 2, False), ("s", "a", 1, False), ("s", "b", 3, True), ("s", "b", 1, False), ("t", "b", 1, False)], "shard_id string, vector_id string, write_epoch long, is_deleted boolean")
    assert sorted(map(tuple, VIS.visible(rows).select("shard_id", "vector_id", "write_epoch").collect())) == [("s", "a", 2), ("t", "b", 1)]
    assert VIS.watermark(rows).first()[0] == 3 and VIS.watermark(rows.limit(0)).first()[0] == 0
    sealed = rows.where("shard_id = 't'").union(rows.where("write_epoch = 1 and shard_id = 's'"))
    assert sorted(r["shard_id"] + r["vector_id"] for r in VIS.masked(sealed, rows).collect()) == ["sa", "tb"]


def test_measures(spark):
    e = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    assert _one(spark, M.recall_at_k(e("a", "b"), e("a", "c"), 2)) == 0.5
    assert _one(spark, M.top_k_overlap(e("a", "b"), e("b", "c"))) == pytest.approx(1 / 3)
    assert _one(spark, M.recall_at_k(e(), e("a"), 3)) == 1.0 and _one(spark, M.recall_at_k(e("a"), e("a"), 0)) == 0.0
    lat = spark.createDataFrame([("m", float(v)) for v in range(1, 101)] + [("n", 7.0)], "mode string, latency_ms double")
    got = {r["mode"]: r for r in audit.latency_report(lat, ["mode"]).collect()}
    assert (got["m"]["mean"], got["m"]["median"], got["m"]["p50"], got["m"]["p95"], got["m"]["p99"]) == (50.5, 50.5, 50.0, 95.0, 99.0)
    assert got["n"]["p99"] == 7.0


def test_rate_limit_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{k % 3}", k, float(t)) for k, t in enumerate(np.cumsum(rng.exponential(2.0, 200)).round(1))]
    seen, want = {}, []
    for who, seq, t in rows:
        w = seen.setdefault(who, [])
        w[:] = [x for x in w if x > t - 20]
        ok = len(w) < 3
        want.append((seq, ok, 0.0 if ok else pytest.approx(20 - (t - w[0]))))
        if ok:
            w.append(t)
    got = audit.rate_limited(spark.createDataFrame(rows, "identifier string, seq long, ts double"), 3, 20).orderBy("seq").collect()
    assert [(r["seq"], r["allowed"], r["retry_after"]) for r in got] == want


def test_text(spark):
    assert _one(spark, X.document_id_of(X.vector_id_of(F.lit("a:b")))) == "a:b"
    assert _one(spark, X.document_id_of(F.lit("document:"))) is None and _one(spark, X.document_id_of(F.lit("x:1"))) is None
    assert _one(spark, X.group_counts(F.lit("PostgreSQL and SQL, python script"))) == [4.0, 2.0, 0.0, 0.0]
    assert _one(spark, X.embed_text(F.lit("nothing of it"))) == [1.0, 0.0, 0.0, 0.0] == _one(spark, X.embed_text(F.lit(None).cast("string")))
    assert [X.mode_name(a, r, "engine") for a, r in ((False, True), (True, False), (True, True))] == ["exact-hybrid-engine", "compressed-hybrid-engine", "compressed-reranked-hybrid-engine"]


def test_cluster_policy_and_kmeans(spark):
    assert [ivf.cluster_count(n, m, t) for n, m, t in ((5, None, 100), (20, None, 10), (10_000, None, 100), (5, 32, None), (5, None, None))] == [None, 8, 100, 32, None]
    assert ivf.probe_width(None, 2, 8) == 2 and ivf.probe_width(99, 2, 8) == 8
    x = np.concatenate([np.random.default_rng(k).normal(5 * k, 0.1, (30, 4)) for k in range(3)]).astype(np.float32)
    centroids, own = ivf.lloyd(x, 3)
    assert len(centroids) == 3 and all(((x - centroids[own]) ** 2).sum(1) <= ((x[:, None] - centroids) ** 2).sum(-1).min(1) + 1e-4)
    rows = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)], "segment_id string, docno int, embedding array<float>")
    built = ivf.build_per_segment(rows, 3)
    assert np.allclose(np.array([r["centroid"] for r in built.orderBy("cluster_id").collect()]), centroids)
    assert [r["cluster_id"] for r in ivf.assign(rows, built).orderBy("docno").collect()] == own.tolist()
    assert ivf.build_distributed(rows, 3).count() == 3
    many = spark.createDataFrame([(k, [float(k), 0.0, 0.0, 0.0]) for k in range(100)], "cluster_id int, centroid array<float>")
    assert [r["cluster_id"] for r in ivf.assign(rows.where("docno in (0, 40, 80)"), many).orderBy("docno").collect()] == [int(v) for v in np.abs(x[[0, 40, 80]][:, None] - np.array([[k, 0, 0, 0] for k in range(100)])).__pow__(2).sum(-1).argmin(1)]


def test_fixtures(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"name": "t", "items": [{"vector_id": "a", "embedding": [1, 0], "metadata": {"region": "us"}}], "queries": [[0.9, 0.1], [0.1, 0.9]]}))
    items, queries = fixtures.load_fixture(spark, str(tmp_path / "f.json"))
    assert items.first()["metadata"]["region"] == "us" and queries.count() == 2
    assert fixtures.lattice(spark).select("embedding").distinct().count() == 16
    assert fixtures.highdim(spark, 10).first()["embedding"] == [0.0] * 8
    assert fixtures.clustered(spark, 4).count() == 12
    g = fixtures.gaussian(spark, 40, 8).collect()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in g)
    rows, gone = fixtures.scenario(spark, 40, 4, shards=2, delete_ratio=0.1)
    assert rows.select("shard_id").distinct().count() == 2 and gone.count() == 4


def test_reports(spark):
    d = spark.createDataFrame([("a", 1.23456), ("b", None)], "name string, ms double")
    assert reports.markdown(d) == "| name | ms |\n|---|---|\n| a | 1.235 |\n| b |  |\n"
    assert json.loads(reports.summary(d))[0] == {"name": "a", "ms": 1.23456}
    assert json.loads(d.select(reports.trace("name", "ms")).first()[0]) == {"name": "a", "ms": 1.23456}


def test_collection_checks():
    assert Collection(" c ", 2).collection_id == "c"
    for bad in (("", 2, {}), ("c", 0, {}), ("c", 2, {"metric": "x"})):
        with pytest.raises(ValueError):
            Collection(bad[0], bad[1], **bad[2])


def test_scores_are_fused_sums(spark):
    """Vectors that are alike but for a rounding: DuckDB's dot product rounds once a component, and what comes first follows from it."""
    import math

    import duckdb

    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=(3, 2000)) * 10.0 ** rng.integers(-8, 8, (3, 2000))
    c[:500] = -(a * b)[:500]
    assert K.fused(a, b, c).tolist() == [math.fma(*t) for t in zip(a, b, c, strict=True)]
    counts = np.array([[3, 5, 7, 2], [1, 1, 3, 9], [2, 7, 0, 1]])[rng.integers(0, 3, 300)] * rng.integers(1, 90, (300, 1))
    unit = (counts / np.sqrt((counts * counts).sum(1))[:, None]).tolist()
    rows = spark.createDataFrame(list(enumerate(unit)), "vector_id int, embedding array<double>").repartition(3)
    queries = rows.where("vector_id % 30 = 0").select(F.col("vector_id").alias("qid"), F.col("embedding").alias("query"))
    con = duckdb.connect()
    con.execute("create table v (i int, e double[])")
    con.executemany("insert into v values (?, ?)", [[i, e] for i, e in enumerate(unit)])
    want = con.execute("select q.i, row_number() over (partition by q.i order by list_dot_product(v.e, q.e) desc, v.i) as r, v.i from v, v q where q.i % 30 = 0 qualify r <= 5").fetchall()
    assert sorted(tuple(r)[:3] for r in K.top_k_batch(rows, queries, 5).collect()) == sorted(want)


def test_a_task_keeps_its_limits_over_batches():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(700, 8)), rng.normal(size=(900, 8))
    x[100:140] = x[3]
    tops, got = np.full((700, 6), -np.inf), []
    for at in range(0, 900, 100):
        qi, ri, s = K.best(q, x[at : at + 100], "dot_product", 6, tops)
        got += zip(qi.tolist(), s.tolist(), (ri + at).tolist(), strict=True)
    full = q @ x.T
    for j in range(0, 700, 50):
        mine = sorted((-s, r) for i, s, r in got if i == j)[:6]
        assert [r for _, r in mine] == sorted(range(900), key=lambda r: (-round(full[j, r], 12), r))[:6]
    assert len(got) < 700 * 6 * 9


@pytest.mark.parametrize("metric", ["dot_product", "cosine", "l2"])
def test_native_top_k_leaves_out_only_what_cannot_be_among_the_best(spark, metric):
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (600, 5)).astype(float)
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(700, None), (701, [1.0, None, 1.0, 1.0, 1.0]), (702, [0.0] * 5)]
    rows = spark.createDataFrame(data, "vector_id int, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(k, (v + 0.1).tolist()) for k, v in enumerate(x[:9])], "qid int, query array<double>")
    whole = rows.where("vector_id < 700 or vector_id = 702")
    plain = lambda df: sorted((r["qid"], r["rank"], r["vector_id"], round(r["score"], 9)) for r in df.collect())
    want = plain(K._ranked(whole.crossJoin(queries).withColumn("score", K.METRICS[metric](F.col("embedding"), F.col("query"))).where("score is not null"), 4, ["qid"], "vector_id"))
    assert plain(K.top_k_native(rows, queries, 4, metric=metric)) == plain(K.top_k_native_blocks(rows, queries, 4, most=4, metric=metric)) == want
    assert K.top_k_native_blocks(rows, queries.limit(0), 4).collect() == K.top_k_native(rows.limit(0), queries, 4).collect() == []
    with pytest.raises(Exception, match="components"):
        K.top_k_native(rows.union(spark.createDataFrame([(9000, [1.0])], rows.schema)), queries, 4, metric=metric).collect()

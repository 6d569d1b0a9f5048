import numpy as np
from pyspark.sql import functions as F

from quiverlake.llm.ann import IvfPq, cosines, nearest, survivors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, q boolean, cid int, cell int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, None, None, None, None) for i, v in rows], SCHEMA)


def _exact(rows, every, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        c = cosines(x[q], x)
        c[q] = -9
        best = np.lexsort((ids, -c))[: min(k, len(ids) - 1)]
        out[int(ids[q])] = [(int(ids[b]), float(c[b])) for b in best]
    return out


def test_recall_and_scores(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    rows += [(10_000 + k, rng.normal(size=64).tolist()) for k in range(2500)] + [(20_000 + k, rows[7][1]) for k in range(1500)]
    got = nearest(_frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = _exact(rows, 50)
    mine: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert mine.keys() == want.keys()
    hits = sum(len({i for i, _ in mine[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    by_id = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    for q, found in mine.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == cosines(by_id[q], by_id[i][None])[0] for i, s in found)
    hot = [q for q in want if q >= 20_000]
    assert hot and all([i for i, _ in mine[q]] == [i for i, _ in want[q]] for q in hot)  # ties go to the smaller ids


def test_thousands_of_near_copies(spark):
    rng = np.random.default_rng(8)
    one = rng.normal(size=64)
    rows = [(k, rng.normal(size=64).tolist()) for k in range(6000)]
    rows += [(10_000 + 4000 * g + k, (one + noise * rng.normal(size=64)).tolist()) for g, noise in enumerate((1e-3, 1e-2)) for k in range(4000)]
    got = {}
    for r in nearest(_frame(spark, rows), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = _exact(rows, 100)
    for low, high in ((0, 10_000), (10_000, 14_000), (14_000, 18_000)):
        group = [q for q in want if low <= q < high]
        assert sum(len(got[q] & {i for i, _ in want[q]}) for q in group) / (5 * len(group)) >= 0.9, low


def test_bounds_pass_over_no_true_neighbour():
    rng = np.random.default_rng(9)
    x = IvfPq.unit(np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=32) + 1e-2 * rng.normal(size=(1500, 32))]))
    model = IvfPq.fit(x, 3000)
    own, codes = model.encode(x)
    table = model.table(x[::100])
    rough = x[::100] @ model.centroids[own].T + sum(table[:, p][:, codes[:, p]] for p in range(codes.shape[1]))
    exact = x[::100] @ x.T
    off = model.misses(x, own, codes)
    assert (np.abs(rough - exact) <= off + 1e-9).all()
    best = np.argsort(-exact, axis=1)[:, :6]
    assert np.take_along_axis(survivors(rough, off, 6), best, axis=1).all()


def test_small_and_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (50, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [None, 1.0]), (1, [1.0, 0.1])]
    got = sorted(map(tuple, nearest(_frame(spark, rows), F.col("vec_id") % 50 == 0).collect()))
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 50), (0, 2, 1), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert nearest(_frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert nearest(_frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 50 == 0).collect() == []


def test_codes_approximate_residuals():
    x = IvfPq.unit(np.random.default_rng(5).normal(size=(3000, 32)))
    model = IvfPq.fit(x, 3000)
    own, codes = model.encode(x)
    parts = model.books.shape[0]
    back = model.centroids[own] + np.stack([model.books[p][codes[:, p]] for p in range(parts)], 1).reshape(len(x), -1)
    assert ((x - back) ** 2).sum(1).mean() < 0.3
    table = model.table(x[:3])
    rough = (x[:3] @ model.centroids[own].T) + sum(table[:, p][:, codes[:, p]] for p in range(parts))
    assert np.abs(rough - x[:3] @ back.T).max() < 1e-9


def test_exact_switch(spark):
    """With all cells probed every neighbour is found, on vectors for which few probes miss some."""
    rng = np.random.default_rng(10)
    rows = [(k, rng.normal(size=24).tolist()) for k in range(3000)]
    want, got = _exact(rows, 50), {}
    for r in sorted(nearest(_frame(spark, rows), F.col("vec_id") % 50 == 0, exact=True).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in best] for q, best in want.items()}


def test_cells_grow_with_the_sample():
    x = np.random.default_rng(1).normal(size=(3000, 8))
    assert [len(IvfPq.fit(x, n, parts=4, codes=16).centroids) for n in (100, 3000, 10**6, 10**9)] == [1, 13, 250, 300]


def test_cosines_of_extreme_vectors():
    q, x = np.array([1e200, 1e200]), np.array([[1e200, 0.0], [3e-200, 3e-200], [2.0, 2.0]])
    assert np.allclose(cosines(q, x), [0.5**0.5, 1.0, 1.0])


def test_lengths_are_apart(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 0.2, 0.0]), (52, [1.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(_frame(spark, rows), F.col("vec_id") % 50 == 0, k=1).collect()]
    assert sorted(got) == [(0, 1, 1), (50, 1, 51)]

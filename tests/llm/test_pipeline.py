import random

from pyspark.sql import functions as F

import corpus_pipeline
from quiverlake.llm.components import connected_components
from quiverlake.llm.queries import ORACLE_SQL, QUERIES


def _step(spark, name, d, sf_dir):
    return dict(corpus_pipeline.STAGES)[name](spark, d, sf_dir)


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = d.columns, [d.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, sf_dir).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        n.append(d.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or d.columns == columns, name
    assert n[1] < n[0] and n[3] < n[2] and n[4] > n[3] and n[5] == n[4]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "length", "bucket", "bound", "batch", "place"] and out.count() > 0


def test_copies_go_and_clean_texts_stay(spark, docs, sf_dir):
    rng = random.Random(11)
    words = ["w%d" % k for k in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    clean = [(k, text(200), "en", "a") for k in range(60)]
    near = [(1000 + k, t + " one more", "en", "b") for k, t, *_ in clean[:15]]
    same = [(2000 + k, t, "en", "b") for k, t, *_ in clean[:30]]
    again = [clean[3], clean[3]]
    got = _step(spark, "near_duplicates", docs(clean + near + same + again, extra=True), sf_dir)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60))


def test_only_texts_with_like_shingles_go(spark, docs, sf_dir):
    """More than a fifth of all shingles differ, though few bits of the fingerprint do."""
    rng = random.Random(12)
    base = ["w%d" % rng.randrange(3000) for _ in range(400)]

    def edited(every):
        return " ".join("x%d" % rng.randrange(10**9) if every and k % every == 7 else w for k, w in enumerate(base))

    below = [(k, edited(40), "en", "a") for k in range(1, 40)]
    alike = [(100 + k, edited(100), "en", "a") for k in range(40)]
    got = {r["doc_id"] for r in _step(spark, "near_duplicates", docs([(0, edited(0), "en", "a"), *below, *alike], extra=True), sf_dir).collect()}
    assert got == set(range(40))


def test_odd_rows_through_all_stages(spark, docs, odd_rows, sf_dir):
    for rows in (odd_rows, []):
        d = docs(rows, extra=True)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, sf_dir)
            assert out.count() >= 0, name
    mixed = _step(spark, "mixing", docs(odd_rows, extra=True), sf_dir)
    assert all((r["text"] or "").strip() for r in mixed.collect())


def test_registered_queries():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == list(QUERIES) or len(QUERIES) == 10
    assert len(QUERIES) == 10 and set(ORACLE_SQL) <= set(QUERIES)


def test_rows_that_share_an_id_are_apart(spark, docs, sf_dir):
    """Texts that have nothing to do with each other stay under one id; of rows alike in both one stays."""
    rows = [(5, "one two three four five six seven", "en", "a"), (5, "red green blue black white pink grey", "en", "a"), (5, "one two three four five six seven", "en", "a")]
    rows += [(None, "up down left right in out over", "en", "a"), (None, "red green blue black white pink grey", "en", "b"), (None, "up down left right in out over", "en", "a"), (None, None), (9, "")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in _step(spark, "near_duplicates", docs(rows), sf_dir).collect())
    assert got == [("5", "one two three four five six seven"), ("5", "red green blue black white pink grey"), ("9", ""), ("None", "up down left right in out over")]


def test_clashing_names(spark, docs, sf_dir):
    """Columns named like those that the stages use inside."""
    names = ["__id", "__keep", "row", "ONE", "two", "kept1", "slot", "other1", "__slice", "__w", "turn", "key1", "goal", "start", "component_id", "least"]
    d = docs([(k, "word%d and some more of it, plain as day. " % (k % 3) * 4, "en", "ab"[k % 2]) for k in range(12)])
    for n in names:
        d = d.withColumn(n, F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf_dir)
        assert out.count() >= 0 and (name == "packing" or out.columns == d.columns), name


def test_mixing_is_in_the_order_of_slots(spark, docs, sf_dir):
    rows = [(k, " ".join("w%d" % (k * 50 + j) for j in range(400)), "en", "ab"[k % 2]) for k in range(80)]
    got = [r["source"] for r in _step(spark, "mixing", docs(rows), sf_dir).collect()]
    # a weighs 3 and b 1, and a stops at twice its size: 80 and 40 documents, even in each stretch.
    assert got.count("a") >= 80 and 38 <= got.count("b") <= 42
    for at in range(0, 100, 20):
        assert 9 <= got[at : at + 20].count("a") <= 17


def test_near_duplicates_against_all_pairs(spark, docs, sf_dir):
    """The plain version: all pairs by the sets of five-word shingles, then components. Edits of up to two words are within the candidates."""
    rng = random.Random(21)
    words = ["w%d" % k for k in range(2000)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(400, 600))]
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t), "en", "a"))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                top[max(root(a), root(b))] = min(root(a), root(b))
    want = {root(k) for k in range(len(rows))}
    assert {r["doc_id"] for r in _step(spark, "near_duplicates", docs(rows), sf_dir).collect()} == want


def _largest_plan(spark, run):
    """Nodes of the largest plan that Spark ran meanwhile."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = {store.executionsList().apply(k).executionId() for k in range(store.executionsCount())}
    run()
    bus.waitUntilEmpty()
    ids = {store.executionsList().apply(k).executionId() for k in range(store.executionsCount())}
    return max(store.planGraph(k).allNodes().size() for k in ids - seen)


def test_plans_stay_small(spark, sf_dir, tmp_path):
    """The driver plans a query again after each of its exchanges, so large plans cost it memory."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _largest_plan(spark, lambda: _step(spark, "near_duplicates", d, sf_dir).write.parquet(f"{tmp_path}/near")) <= 80
    assert _largest_plan(spark, lambda: _step(spark, "mixing", d, sf_dir).write.parquet(f"{tmp_path}/mixed")) <= 100


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    """With hubs and without; the result is what it was."""
    edges = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 2000), (2000, 2001)], "u long, v long")
    want = {k: 0 for k in [*range(1, 300), 2000, 2001]} | {k: 1000 for k in range(1001, 1101)}
    for hub, most in ((100_000, 60), (20, 80)):
        monkeypatch.setattr("quiverlake.llm.components.HUB", hub)
        found = []
        assert _largest_plan(spark, lambda: found.extend(connected_components(edges).collect())) <= most  # noqa: B023
        assert {r["u"]: r["v"] for r in found} == want

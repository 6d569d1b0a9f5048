import numpy as np
from pyspark.sql import functions as F

from quiverlake.llm.quality import LABELLERS, LabelModel, featurise, fit_quality, good_text, hashed, measures, score_quality, votes_of


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    m, n = len(LABELLERS), 40_000
    true = np.linspace(0.75, 0.97, m)
    good = rng.random(n) < 0.8
    right = rng.random((n, m)) < true
    vote = np.where(rng.random((n, m)) < 0.5, 2, np.where(right, good[:, None], ~good[:, None]).astype(int))
    patterns: dict[str, int] = {}
    for v in vote:
        key = "".join(map(str, v))
        patterns[key] = patterns.get(key, 0) + 1
    model = LabelModel.fit(patterns)
    assert abs(model.share - 0.8) < 0.03
    for c in (0, 1):  # bad texts: votes for bad are right; good texts: votes for good
        assert np.abs(model.rates[c, :, c] - 0.5 * true).max() < 0.05 and np.abs(model.rates[c, :, 1 - c] - 0.5 * (1 - true)).max() < 0.05
    assert ((model.posterior(vote) > 0.5) == good).mean() > 0.93


def _patterns(vote):
    out: dict[str, int] = {}
    for v in vote:
        key = "".join(map(str, v))
        out[key] = out.get(key, 0) + 1
    return out


def test_em_with_one_sided_and_correlated_labellers():
    """Each labeller votes bad only, some copy one another, and one votes good only; rates differ by class and are found without bounds on them."""
    rng = np.random.default_rng(3)
    m, n = len(LABELLERS), 40_000
    good = rng.random(n) < 0.7
    vote = np.full((n, m), 2)
    hit = rng.random((n, m)) < np.where(good[:, None], 0.01, np.linspace(0.2, 0.6, m))
    vote[hit] = 0
    vote[:, 1] = np.where(rng.random(n) < 0.8, vote[:, 0], vote[:, 1])
    vote[:, -1] = np.where(rng.random(n) < np.where(good, 0.9, 0.05), 1, 2)
    model = LabelModel.fit(_patterns(vote))
    assert abs(model.share - 0.7) < 0.02
    assert np.abs(model.rates[1, 2:-1, 0] - 0.01).max() < 0.01 and np.abs(model.rates[0, 2:-1, 0] - np.linspace(0.2, 0.6, m)[2:-1]).max() < 0.05
    assert ((model.posterior(vote) > 0.5) == good).mean() > 0.96


def test_em_is_what_a_plain_loop_gives():
    """Against the same steps written row by row."""
    rng = np.random.default_rng(4)
    m = len(LABELLERS)
    vote = rng.integers(0, 3, (60, m))
    model = LabelModel.fit(_patterns(vote), rounds=3)
    good = [0.1 if (v == 0).sum() > (v == 1).sum() else 0.9 if (v == 1).sum() > (v == 0).sum() else 0.5 for v in vote]
    for _ in range(3):
        rates = [[[1.0 + sum((g if c else 1 - g) for v, g in zip(vote, good, strict=True) if v[k] == x) for x in range(3)] for k in range(m)] for c in (0, 1)]
        rates = [[[x / sum(r) for x in r] for r in rows] for rows in rates]
        share = (sum(good) + 1) / (len(vote) + 2)
        odds = [share / (1 - share) * np.prod([rates[1][k][v[k]] / rates[0][k][v[k]] for k in range(m)]) for v in vote]
        good = [o / (1 + o) for o in odds]
    assert np.allclose(model.rates, rates) and abs(model.share - share) < 1e-12


def test_against_labels(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    features = featurise(d, "doc_id", "text")
    model = fit_quality(features)
    got = score_quality(features, model).toPandas()
    both = got.merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    assert (both.keep == (both.quality == 1)).mean() > 0.95
    assert both[both.quality == 1].keep.mean() > 0.97
    assert d.filter(good_text(spark, model, F.col("text"))).count() == got.keep.sum()
    again = score_quality(features, fit_quality(featurise(d, "doc_id", "text"))).toPandas()
    assert np.array_equal(again.sort_values("doc_id").score, got.sort_values("doc_id").score)


def test_measures_and_features_read_whole_texts():
    text = "Plain words in a row. " * 500 + "| " * 3000
    m = measures(text)
    assert m["bare"] > 0.5 and votes_of(m)[2] == "0"
    assert measures(" \n") is None and votes_of(None) == ""
    index, x = hashed(text, m)
    assert index.size == x.size and index.max() < 1 << 13


def test_odd_rows(docs, odd_rows):
    features = featurise(docs(odd_rows, extra=True), "doc_id", "text")
    got = score_quality(features, fit_quality(features)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["score"] == 0 and not r["keep"] for r in got if r["doc_id"] in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    none = featurise(docs([]), "doc_id", "text")
    assert score_quality(none, fit_quality(none)).collect() == []

import numpy as np
from pyspark.sql import functions as F

from quiverlake.llm.language import Ftrl, fit_language, grams, predict_language, softmax, sure_language, temperature


def test_grams_cover_the_whole_text():
    index, counts = grams("Ab 9c" * 4000)
    n = len("Ab 9c") * 4000 + 2
    assert counts.sum() == n + (n - 1) + (n - 2)
    assert grams("123 !?")[0].size == 0 and grams(None)[0].size == 0
    assert (np.diff(index) > 0).all()


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    model = Ftrl(50, 3, l1=0.5)
    for _ in range(600):
        y = int(rng.integers(3))
        model.learn(np.array([y, 3 + int(rng.integers(47))]), np.array([1.0, 0.3]), y)
    w = model.weights(slice(None))
    assert all(softmax(w[y][None])[0].argmax() == y for y in range(3))
    assert (w[3:] == 0).mean() > 0.3


def test_temperature_softens_overconfidence():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 4000)
    shown = np.where(rng.random(4000) < 0.8, labels, 1 - labels)
    logits = np.eye(2)[shown] * 10
    assert abs(softmax(logits / temperature(logits, labels)).max(1).mean() - 0.8) < 0.02


def test_held_out_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit_language(d, ~held)
    got = predict_language(d.withColumn("held", held), model, ["doc_id", "held", "lang"]).toPandas()
    test = got[got.held]
    assert len(test) > 20 and (test.lang == test.lang_pred).mean() > 0.95
    again = predict_language(d, fit_language(d, ~held), ["doc_id"]).toPandas().sort_values("doc_id").score
    assert np.array_equal(again.to_numpy(), got.sort_values("doc_id").score.to_numpy())
    assert d.filter(sure_language(d, model, F.col("text"), 0.5)).count() >= 0.95 * d.count()


def test_odd_rows(docs, odd_rows):
    d = docs(odd_rows, extra=True)
    got = predict_language(d, fit_language(d, F.lit(True)), ["doc_id"]).collect()
    assert len(got) == len(odd_rows)
    assert {(r["doc_id"], r["lang_pred"]) for r in got} >= {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (10, "en")}
    assert all(0 <= r["score"] <= 1 for r in got)
    none = docs([])
    assert predict_language(none, fit_language(none, F.lit(True)), ["doc_id"]).collect() == []
    blind = fit_language(d, F.lit(False))
    assert {r["lang_pred"] for r in predict_language(d, blind, ["doc_id"]).collect()} == {"und"}

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to ``MOST`` letters, every other code point
counting as one space; a weight is (1 + log count) * idf, with unit length.
Document frequencies count all documents that may be learnt from. The weights
are fitted by follow-the-regularised-leader with elastic-net penalties (the L1
part leaves most at zero) on a bounded sample of labelled documents, at most
``per_label`` of a language and ``most_rows`` in all, drawn by a hash of the
row. A fifth of the sample is set apart to fit the temperature that calibrates
the probabilities. Whole texts are read, in learning and in prediction.

Rows: a null text, or one without a letter, is ``und`` with score 0; so is all
if there is nothing to learn from. Rows with null label or null id are not
learnt from. Repeated rows stay. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feature buckets, and the longest n-gram.
BITS, MOST = 16, 3
UNKNOWN = "und"
_MULTIPLY = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            table[cp] = True
    return table


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    return _LETTERS[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, ascending, and their counts. Empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    points = np.where(is_letter, points, np.uint32(32))
    points = np.concatenate([np.array([32], np.uint32), points, np.array([32], np.uint32)])
    parts, mixed = [], np.zeros(points.size, np.uint32)
    for n in range(1, MOST + 1):
        if points.size < n:
            break
        at = points[n - 1 :]
        mixed = (mixed[: at.size] + at + np.uint32(n)) * _MULTIPLY[(n - 1) % 3]
        mixed ^= mixed >> np.uint32(15)
        parts.append(((mixed * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32))
    counts = np.bincount(np.concatenate(parts), minlength=1 << BITS)
    index = np.flatnonzero(counts)
    return index.astype(np.int32), counts[index].astype(np.int32)


def weigh(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[index]
    size = np.sqrt((x * x).sum())
    return x / size if size else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, ratio = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    """Weights of the buckets in use (sorted ``index``), idf of all buckets, labels and temperature."""

    labels: list[str]
    index: np.ndarray
    weights: np.ndarray
    idf: np.ndarray
    heat: float = 1.0

    def predict(self, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
        dense = np.zeros((1 << BITS, max(1, len(self.labels))), np.float32)
        dense[self.index] = self.weights
        for text in texts:
            index, counts = grams(text)
            if not index.size or not self.labels:
                yield UNKNOWN, 0.0
                continue
            p = softmax(weigh(index, counts, self.idf) @ dense[index] / self.heat)
            best = int(p.argmax())
            yield self.labels[best], float(p[best])


def fit_language(
    df: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    per_label: int = 1000, most_rows: int = 6000, epochs: int = 2,
) -> LanguageModel:
    """Fits on the rows where ``learnable`` holds. The driver holds bucket counts and the bounded sample."""
    rows = df.filter(learnable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    labelled = {r[0]: r[1] for r in rows.groupBy(F.col(label_col).alias("label")).count().collect()}
    labels = sorted(labelled)
    if not labels:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.ones(1 << BITS, np.float32))
    texts = rows.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)).alias("h"))

    def frequencies(batches):
        import pyarrow as pa

        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for t in b.column(0):
                total[grams(t.as_py())[0]] += 1
        index = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int32)), pa.array(total[index])], names=["bucket", "n"])

    seen = texts.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df_count = np.zeros(1 << BITS)
    df_count[[r["bucket"] for r in seen]] = [r["n"] for r in seen]
    idf = (np.log((1 + sum(labelled.values())) / (1 + df_count)) + 1).astype(np.float32)

    each = max(1, min(per_label, most_rows // len(labels)))
    limit = F.create_map(*[F.lit(x) for v, n in labelled.items() for x in (v, int(min(1.0, each / n) * (1 << 40)))])

    def features(batches):
        import pyarrow as pa

        for b in batches:
            got = [grams(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("h"), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], names=["label", "h", "index", "counts"])

    label_type = df.schema[label_col].dataType.simpleString()
    drawn = texts.filter(F.col("h") < F.element_at(limit, F.col("label"))).mapInArrow(features, f"label {label_type}, h long, index binary, counts binary")
    # Rows alike fall to one place: however many there are, the driver gets no more than twice the bound.
    drawn = drawn.orderBy("h", "label").limit(2 * most_rows).collect()
    place = {v: k for k, v in enumerate(labels)}
    sample = []
    drawn.sort(key=lambda r: (r["h"], r["label"], bytes(r["index"])), reverse=True)
    while drawn:  # what has been read is let go
        r = drawn.pop()
        index, counts = np.frombuffer(r["index"], np.int32).copy(), np.frombuffer(r["counts"], np.int32)
        if index.size:
            sample.append((index, weigh(index, counts, idf).astype(np.float32), place[r["label"]]))
    apart = [s for k, s in enumerate(sample) if k % 5 == 4]
    learn = [s for k, s in enumerate(sample) if k % 5 != 4] or sample
    model = Ftrl(1 << BITS, len(labels))
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(learn)):
            model.learn(*learn[k])
    w = model.weights(slice(None))
    logits = np.array([x @ w[i] for i, x, _ in apart]).reshape(len(apart), len(labels))
    heat = temperature(logits, np.array([y for *_, y in apart], np.int64))
    used = np.flatnonzero((w != 0).any(axis=1))
    return LanguageModel(labels, used, w[used].astype(np.float32), idf, heat)


def predict_language(df: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred and score; the model goes to the executors as one broadcast of fixed size."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = list(sent.value.predict(t.as_py() for t in b.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([v for v, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def sure_language(df: DataFrame, model: LanguageModel, text: Column, least: float) -> Column:
    """Whether a text has a language with a score of at least ``least``; for filters that keep all columns."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def sure(texts: pd.Series) -> pd.Series:
        return pd.Series([v != UNKNOWN and s >= least for v, s in sent.value.predict(iter(texts))], dtype=bool)

    return sure(text)

"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each text. The number of
documents with each pattern of votes is counted over the whole corpus (at most
3 to the number of heuristics patterns, whatever its size), and
expectation-maximisation finds from these counts how often each heuristic casts
each vote on good and on bad texts, and the share of good ones. The posterior
of a document's pattern is its soft label. Soft labels train a logistic scorer
on hashed features of a bounded sample of ``most_rows`` documents, drawn by a
hash of the row; the scorer then scores every document.

A text is read once: its votes and its hashed features (a few hundred bytes)
go to the shared checkpoint folder, and all later passes read those.

Rows: a text that is null or has no word gets no votes, score 0 and is not
kept. Rows with null id are scored but not learnt from. Repeated rows stay.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.llm._common import cut_lineage

#: Buckets of the scorer's features.
BITS = 13
_MARKS = frozenset(".,;:!?'\"()-’“”«»…¿¡–—")


def measures(text: str | None) -> dict[str, float] | None:
    """What the heuristics look at. None for a text without words."""
    words = (text or "").split()
    if not words:
        return None
    n = len(words)
    text = text or ""
    kinds = Counter(words)
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    odd = sum(1 for w in words if not w.isalnum() and any(not c.isalnum() and c not in _MARKS for c in w))
    bare = sum(1 for w in words if not w.isalnum() and not any(c.isalnum() for c in w))
    letters = sum(map(len, words))
    signs = sum(map(text.count, "#$%&*|~^=+<>{}[]\\@_"))
    capital = sum(1 for w in words if len(w) > 1 and w.isupper())
    return {
        "odd": odd / n,
        "signs": signs / letters,
        "bare": bare / n,
        "cells": (text.count("|") + text.count("\t")) / n,
        "shout": sum(1 for w in words if w.endswith("!!")) / n,
        "capital": capital / n,
        "echo": sum(map(str.__eq__, words, words[1:])) / n,
        "kinds": len(kinds) / n**0.8 if n >= 20 else 1.0,
        "top": max(kinds.values()) / n if n >= 20 else 0.0,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.0,
        "length": letters / n,
        "ends": sum(1 for x in lines if x[-1] in ".!?…\"'»”)") / len(lines),
    }


def _bad_from(name: str, limit: float) -> Callable[[dict[str, float]], int]:
    return lambda m: 0 if m[name] >= limit else 2


def _prose(m: dict[str, float]) -> int:
    calm = m["odd"] <= 0.1 and m["bare"] <= 0.05 and m["shout"] <= 0.02 and m["echo"] <= 0.05 and m["capital"] <= 0.2
    return 1 if calm and m["kinds"] >= 0.6 and m["lines"] <= 0.3 else 2


#: The heuristics: 1 good, 0 bad, 2 no vote. Each kind of junk is in reach of two or more.
LABELLERS: dict[str, Callable[[dict[str, float]], int]] = {
    "odd": _bad_from("odd", 0.25),
    "signs": _bad_from("signs", 0.08),
    "bare": _bad_from("bare", 0.1),
    "cells": _bad_from("cells", 0.1),
    "shout": _bad_from("shout", 0.2),
    "capital": _bad_from("capital", 0.5),
    "echo": _bad_from("echo", 0.2),
    "kinds": lambda m: 0 if m["kinds"] <= 0.35 else 2,
    "top": _bad_from("top", 0.35),
    "lines": _bad_from("lines", 0.6),
    "length": lambda m: 2 if 2 <= m["length"] <= 16 else 0,
    "prose": _prose,
}


def votes_of(measured: dict[str, float] | None) -> str:
    return "" if measured is None else "".join(str(f(measured)) for f in LABELLERS.values())


_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
_STEPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 4.0, 8.0, 16.0)


def hashed(text: str, measured: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: trigrams of letter shapes (unit length in all), and the step of each measure."""
    shape = _SHAPE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    half = 1 << (BITS - 1)
    if shape.size >= 3:
        mixed = (shape[:-2] * np.uint32(31) + shape[1:-1]) * np.uint32(131) + shape[2:]
        counts = np.bincount(((mixed * np.uint32(2654435761)) >> np.uint32(33 - BITS)).astype(np.int64), minlength=half)
    else:
        counts = np.zeros(half, np.int64)
    index = np.flatnonzero(counts)
    x = 1 + np.log(counts[index]) if index.size else np.zeros(0)
    x = x / max(1e-9, float(np.sqrt((x * x).sum())))
    steps = [half + k * 32 + sum(v > s for s in _STEPS) for k, v in enumerate(measured.values())]
    return np.concatenate([index, steps]).astype(np.int32), np.concatenate([x, np.full(len(steps), 0.5)]).astype(np.float32)


@dataclass
class LabelModel:
    """Share of good texts, and how often each labeller casts each vote on bad and on good ones: ``rates[class, labeller, vote]``."""

    share: float
    rates: np.ndarray

    @classmethod
    def start(cls, votes: np.ndarray) -> np.ndarray:
        """First guess of each pattern's chance to be good: bad votes against good ones, even without any."""
        against, in_favour = (votes == 0).sum(1), (votes == 1).sum(1)
        return np.where(against > in_favour, 0.1, np.where(in_favour > against, 0.9, 0.5))

    @classmethod
    def fit(cls, patterns: dict[str, int], rounds: int = 500, pseudo: float = 1.0) -> LabelModel:
        """Expectation-maximisation over counts of vote patterns.

        A labeller has rates of its own for good and for bad texts, no vote
        being one of the three; ``pseudo`` votes of each kind keep them above
        zero. The classes are told apart by the first guess alone: good is where
        votes for good prevail.
        """
        known = {p: n for p, n in sorted(patterns.items()) if p}
        if not known:
            return cls(0.5, np.full((2, len(LABELLERS), 3), 1 / 3))
        votes = np.array([[int(c) for c in p] for p in known])
        weight = np.array(list(known.values()), float)
        cast = np.stack([votes == v for v in range(3)], axis=2).astype(float)
        good, model = cls.start(votes), None
        for _ in range(rounds):
            mass = np.stack([weight * (1 - good), weight * good])
            rates = np.einsum("cp,plv->clv", mass, cast) + pseudo
            model = cls(float((mass[1].sum() + pseudo) / (weight.sum() + 2 * pseudo)), rates / rates.sum(2, keepdims=True))
            was, good = good, model.posterior(votes)
            if np.abs(good - was).max() < 1e-9:
                break
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of each row of votes to be on a good text."""
        of = np.log(self.rates)[:, np.arange(votes.shape[1]), votes].sum(2)
        odds = of[1] - of[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def of(self, pattern: str) -> float:
        return float(self.posterior(np.array([[int(c) for c in pattern]]))[0]) if pattern else 0.0


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, index: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights[index], -30, 30)))) if index.size else 0.0

    def score_text(self, text: str | None) -> float:
        m = measures(text)
        return 0.0 if m is None else self.score(*hashed(text, m))


def train(sample: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 3, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad."""
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(sample)):
            index, x, y = sample[k]
            d = 1 / (1 + np.exp(-np.clip(bias + x @ w[index], -30, 30))) - y
            g = d * x
            g2[index] += g * g
            w[index] -= rate * g / np.sqrt(g2[index])
            b2 += d * d
            bias -= rate * d / np.sqrt(b2)
    return w, bias


def featurise(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, votes, index, x), written to the shared folder."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            votes, index, x = [], [], []
            for t in b.column(1):
                text = t.as_py()
                m = measures(text)
                votes.append(votes_of(m))
                i, v = hashed(text, m) if m is not None else (np.zeros(0, np.int32), np.zeros(0, np.float32))
                index.append(i.astype(np.uint16).tobytes())
                x.append(v.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.string()), pa.array(index, pa.binary()), pa.array(x, pa.binary())], names=["id", "votes", "index", "x"])

    return cut_lineage(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, votes string, index binary, x binary"))


def _unpack(index: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(index, np.uint16), np.frombuffer(x, np.float16).astype(np.float32)


def fit_quality(features: DataFrame, most_rows: int = 8000) -> QualityModel:
    """Fits on features of all documents: vote patterns of all, the scorer on at most about ``most_rows``."""
    patterns = {r["votes"]: r["n"] for r in features.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    labels = LabelModel.fit(patterns)
    share = min(1.0, most_rows / max(1, sum(patterns.values())))
    place = F.pmod(F.xxhash64("id", "index", "x"), F.lit(1 << 40))
    pick = (place < F.lit(int(share * (1 << 40)))) & F.col("id").isNotNull() & (F.col("votes") != "")
    # Rows alike fall to one place: however many there are, the driver gets no more than twice the bound.
    drawn = features.filter(pick).withColumn("place", place).orderBy("place", "id").limit(2 * most_rows).collect()
    good = {p: labels.of(p) for p in patterns}
    sample = [(*_unpack(r["index"], r["x"]), good[r["votes"]]) for r in drawn]
    del drawn
    weights, bias = train(sample)
    return QualityModel(labels, weights, bias)


def score_quality(features: DataFrame, model: QualityModel, id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(id, posterior, score, keep) for each document."""
    sent = features.sparkSession.sparkContext.broadcast(model)
    id_type = features.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        m, known = sent.value, {}
        for b in batches:
            votes, score = b.column(1).to_pylist(), [sent.value.score(*_unpack(i.as_py(), x.as_py())) for i, x in zip(b.column(2), b.column(3), strict=True)]
            for v in set(votes) - known.keys():
                known[v] = m.labels.of(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([known[v] for v in votes], pa.float64()), pa.array(score, pa.float64()), pa.array([s >= least for s in score], pa.bool_())], names=[id_col, "posterior", "score", "keep"])

    return features.select("id", "votes", "index", "x").mapInArrow(run, f"{id_col} {id_type}, posterior double, score double, keep boolean")


def good_text(spark, model: QualityModel, text: Column, least: float = 0.5) -> Column:
    """Whether a text's score is at least ``least``; for filters that keep all columns."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score_text(t) >= least for t in texts], dtype=bool)

    return good(text)

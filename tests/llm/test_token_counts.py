import random

import pyarrow as pa
import pytest

from quiverlake.llm import token_counts as module
from quiverlake.llm.token_counts import PrefixCounter, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(public_tokenizers.path(MODEL))


def _texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "e", "th", "in", " ", "  ", "é", "\n", "日", "\U0001f600", "ﬁ", " the", "ing", "▁", "\x00", "#", "<s>", "     ", "\t"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_whole_texts_match_the_library(counter, library):
    texts = _texts(1, 1500) + ["x" * 400, "日本" * 200, " " * 60 + "z", "</s> <unk> <0x41>"]
    assert counter.counts(texts, 10)[0] == [len(library.encode(t)) for t in texts]


def test_every_prefix_and_budget(counter, library):
    for t in _texts(2, 80) + ["abc" * 40]:
        want = [len(library.encode(t[:p])) for p in range(len(t) + 1)]
        assert counter.every_prefix(t).tolist() == want
        assert counter.counts([t], 7)[1] == [max(p for p, n in enumerate(want) if n <= 7)]


def test_odd_rows(spark, docs, odd_rows, library):
    got = token_counts(docs(odd_rows, extra=True), limit=100).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in odd_rows]
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts(docs([])).collect() == []


def test_store_is_renewed(counter, library, monkeypatch):
    monkeypatch.setattr("quiverlake.llm.token_counts.KEEP", 3)
    for t in _texts(3, 60):
        assert counter.counts([t], 5)[0] == [len(library.encode(t))]


def test_caches_are_bounded(monkeypatch):
    """Small bounds change nothing but what is kept."""
    texts = [t for k in range(40) for t in ("word%d " % k * 30, "x" * (100 + k), "a%d,b c" % k)]
    c = PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    want = c.counts(texts, 20)
    monkeypatch.setattr(module, "KEEP_PREFIXES", 500)
    monkeypatch.setattr(module, "KEEP_PAIRS", 50)
    got = [c.counts([t], 20) for t in texts]
    assert ([n[0] for n, _ in got], [f[0] for _, f in got]) == want
    assert c.starts[-1] < 2000 and len(c.pairs) < 2000


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 10, None, "b" * 100, "c", "d" * 8, "", "e" * 50])], names=["i", "t"])
    parts = [p.column(0).to_pylist() for p in module.bounded(batch, 1, most=20, rows=3)]
    assert parts == [[0, 1], [2], [3, 4, 5], [6]]

"""Packing documents into batches by optimal length buckets.

Lengths are tokens of a public byte-level vocabulary, counted exactly over whole
texts in one narrow pass. The histogram of lengths over the whole corpus has a bin for each length up to
``FINE`` and, beyond, bins whose width is at most a 256th of the length; so its
size grows with the logarithm of the longest document only. A dynamic programme
over it chooses the bounds of at most ``buckets`` buckets that make the padding
least, a bucket's bound being its longest length. In a bucket, batches of
budget // bound rows (one at least) are filled in a hashed order; ranks come
from sums over slices of a bucket, so a bucket with most of the rows is no
single task. No document is cut or dropped; one longer than the budget is a
batch of its own.

Bounds are optimal to the bins: exactly up to ``FINE`` tokens, and beyond among
bounds that end a bin.

Rows: a null or empty text has length 0 and goes to the first bucket. Rows with
one id are packed each on its own; null ids too. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.llm._common import cut_lineage, running_position

FINE = 1024
#: The vocabulary that lengths are counted in: a name among the public tokenizers, or a path.
VOCABULARY = "byte_bpe_50k.tiktoken"
_ENCODERS: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a rank file, one a Python worker. Special strings in texts are ordinary text."""
    if vocabulary not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_lengths(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, length): tokens of each whole text, 0 for null."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        e = encoder(vocabulary)
        for b in batches:
            n = [len(e.encode_ordinary(t.as_py() or "")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "length"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, length long")


def _bin(length: Column) -> Column:
    """The bin's number, ascending with the length."""
    power = F.floor(F.log2(F.greatest(length, F.lit(FINE)).cast("double") / FINE)).cast("int")
    power = F.when(length >= FINE * F.pow(F.lit(2.0), power + 1), power + 1).when(length < FINE * F.pow(F.lit(2.0), power), power - 1).otherwise(power)
    step = F.pow(F.lit(2.0), power) * (FINE // 256)
    within = F.floor((length - FINE * F.pow(F.lit(2.0), power)) / step)
    return F.when(length < FINE, length).otherwise(FINE + power * 256 + within).cast("long")


def bucket_bounds(counts: list[int], tops: list[int], buckets: int) -> list[int]:
    """Bounds of the buckets with the least padded total; ``tops``: each bin's longest length, ascending."""
    n = len(counts)
    if n == 0:
        return []
    before = np.concatenate([[0], np.cumsum(np.array(counts, np.float64))])
    top = np.array(tops, np.float64)
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    back = []
    for _ in range(min(buckets, n)):
        new, own = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + (before[j] - before[:j]) * top[j - 1]
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], own[j] = cost[i], i
        back.append(own)
        if (own < 0).all():
            break
        best = new
    bounds, j = [], n
    for own in reversed(back):
        if j and own[j] >= 0:
            bounds.append(int(tops[j - 1]))
            j = int(own[j])
    return sorted(bounds)


def pack(lengths: DataFrame, budget: int = 65_536, buckets: int = 16) -> DataFrame:
    """(id, length) rows to (id, length, bucket, bound, batch, place): batch counts within a bucket from 0, place within a batch."""
    rows = cut_lineage(lengths.select("id", "length"))
    histogram = rows.groupBy(_bin(F.col("length")).alias("bin")).agg(F.count("*").alias("n"), F.max("length").alias("top")).orderBy("bin").collect()
    bounds = bucket_bounds([r["n"] for r in histogram], [r["top"] for r in histogram], buckets) or [0]
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = rows.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("length")))).withColumn("bound", F.element_at(limits, F.col("bucket") + 1))
    ranked = running_position(rows, ["bucket"], [F.xxhash64("id", F.lit(61)), F.col("id"), F.col("length")], F.lit(1), "rank")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bound", F.lit(1))))
    return ranked.select("id", "length", "bucket", "bound", F.floor(F.col("rank") / fit).cast("long").alias("batch"), F.pmod("rank", fit).cast("int").alias("place"))


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 65_536, buckets: int = 16, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs texts by their number of tokens; ``budget``: tokens of a batch, padding included."""
    return pack(token_lengths(df, id_col, text_col, vocabulary), budget, buckets).withColumnRenamed("id", id_col)

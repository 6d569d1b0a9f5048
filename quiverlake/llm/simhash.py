"""SimHash near-duplicates with BK-trees.

A fingerprint has a bit set if more than half of a text's shingle hashes have
it. Texts link if their fingerprints differ in at most ``radius`` bits, and
groups are the connected components of the links.

Equal fingerprints are one node. Two 64-bit words at most ``radius`` bits apart
agree in at least ``keep`` of ``keep + radius`` blocks, so the nodes are dealt
to shards: one for each choice of ``keep`` blocks and the value there. Each
shard has a BK-tree: a node's children are keyed by their Hamming distance to
it, and a search follows only edges within the radius of the distance at hand.
The method's broadcast of whole shard trees would grow with the corpus, so a
shard's members meet in one task by a shuffle instead, where all trees of the
task are built and searched side by side, level by level. The number of blocks
that a shard fixes grows with the corpus, and a shard beyond ``HEAVY`` nodes is
split again by parts of its remaining bits: at radius 2 it then has at most
2**22 nodes whatever the corpus.
A shard reports a spanning forest of its links, not all pairs, and
``connected_components`` joins the forests. Nothing is capped.

Rows: a null text, or one without words, has fingerprint zero and is linked
like any other. Repeated rows stay. Null ids never are a component's id unless
all its ids are null. Extra columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm._common import cut_lineage
from quiverlake.llm.components import connected_components

HEAVY = 4096
#: (search, node) pairs that a worker holds at once.
FRONTIER = 1 << 20


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of UTF-8 text: ASCII lower case, ``words``-word shingles with repeats, XXH64."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > hashes.size, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(id, fp) with fp as a signed long."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {id_type}, fp long")


class Forest:
    """BK-trees over words, one a shard, as arrays; ``shard``: sorted shard number of each word."""

    def __init__(self, words: np.ndarray, shard: np.ndarray):
        self.words, n = words, words.size
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        rest, at = np.flatnonzero(~first), self.root[~first]
        keys, kids = [], []
        while rest.size:
            distance = np.bitwise_count(words[rest] ^ words[at]).astype(np.int64)
            edge = at * 65 + distance
            order = np.argsort(edge, kind="stable")
            rest, edge = rest[order], edge[order]
            head = np.concatenate([[True], edge[1:] != edge[:-1]])
            keys.append(edge[head])
            kids.append(rest[head])
            at = rest[np.maximum.accumulate(np.where(head, np.arange(rest.size), 0))]
            rest, at = rest[~head], at[~head]
        edges, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, kids))
        order = np.argsort(edges)
        self.edges, self.child = edges[order], child[order]

    def near(self, radius: int):
        """Yields (query, node) index arrays of pairs within the radius, node before query."""
        size, step = self.words.size, max(1, FRONTIER // 64)
        for at in range(0, size, step):
            stack = [(np.arange(at, min(size, at + step)), self.root[at : at + step])]
            while stack:
                query, node = stack.pop()
                d = np.bitwise_count(self.words[query] ^ self.words[node]).astype(np.int64)
                hit = (d <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
                many = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right") - low
                query, low, many = query[many > 0], low[many > 0], many[many > 0]
                for a in range(0, query.size, FRONTIER // 8):
                    q, k, m = query[a : a + FRONTIER // 8], low[a : a + FRONTIER // 8], many[a : a + FRONTIER // 8]
                    inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                    stack.append((np.repeat(q, m), self.child[np.repeat(k, m) + inner]))


def spanning(words: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word that is linked to a smaller index, and the first word of its component within the shard."""
    label = np.arange(words.size)

    def settle():
        while True:
            up = label[label]
            if (up == label).all():
                return
            label[:] = up

    for query, node in Forest(words, shard).near(radius):
        while True:
            a, b = label[query], label[node]
            apart = a != b
            if not apart.any():
                break
            query, node, a, b = query[apart], node[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            settle()
    moved = np.flatnonzero(label != np.arange(words.size))
    return words[moved], words[label[moved]]


def _choices(radius: int, keep: int) -> list[int]:
    """Masks of all choices of ``keep`` of ``keep + radius`` blocks of a 64-bit word."""
    blocks = keep + radius
    limits = [64 * k // blocks for k in range(blocks + 1)]
    return [sum(((1 << limits[k + 1]) - (1 << limits[k])) for k in chosen) for chosen in combinations(range(blocks), keep)]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _thirds(mask: int, radius: int) -> list[int]:
    """The bits outside a mask in radius + 1 parts."""
    free = [k for k in range(64) if not mask >> k & 1]
    return [sum(1 << k for k in free[p :: radius + 1]) for p in range(radius + 1)]


def blocks_kept(nodes: int, radius: int) -> int:
    """How many of ``keep + radius`` blocks a shard fixes: as many as bring an even shard of so many nodes within half of ``HEAVY``, two at least."""
    keep = 2
    while keep < 8 and nodes >> (64 * keep // (keep + radius)) > HEAVY // 2:
        keep += 1
    return keep


def links(nodes: DataFrame, radius: int = 2, keep: int | None = None) -> DataFrame:
    """(u, v): for distinct fingerprints ``fp``, edges whose components are those of all links within the radius."""
    keep = blocks_kept(nodes.count(), radius) if keep is None else keep
    masks = _choices(radius, keep)
    fp = F.col("fp")
    shards = F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    dealt = nodes.select(fp, F.explode(shards).alias("s")).select("fp", "s.t", "s.key")
    # The join can split a shard that is far larger than others; a window could not. It is never a broadcast: Spark takes
    # the exploded side for as small as the fingerprints before it.
    dealt = dealt.hint("merge").join(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), ["t", "key"])
    parts = F.element_at(F.array(*[F.array(*[F.lit(_signed(p)) for p in _thirds(m, radius)]) for m in masks]), F.col("t") + 1)
    split = F.when(F.col("n") > HEAVY, F.transform(parts, lambda p, k: F.struct(k.alias("k"), fp.bitwiseAND(p).alias("part")))).otherwise(F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("part"))))
    dealt = dealt.select("fp", "t", "key", F.explode(split).alias("p")).select("fp", "t", "key", "p.k", "p.part")
    shard = F.xxhash64("t", "key", "k", "part")
    dealt = dealt.select("fp", "t", "k", shard.alias("shard")).repartition("shard").sortWithinPartitions("shard", "fp")

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(words, shard):
            far, near = spanning(words.view(np.uint64), shard, radius)
            if far.size:
                return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (far, near)], names=["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            last = held[-1][1][-1] if batch.num_rows else None
            if last is None or held[0][1][0] == last:
                continue
            words, shard = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(shard, last))
            held = [(words[cut:], shard[cut:])]
            if (out := done(words[:cut], shard[:cut])) is not None:
                yield out
        if held and (out := done(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
            yield out

    return dealt.select("fp", "shard").mapInArrow(run, "u long, v long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for each row; component_id: the smallest id that links reach."""
    rows = cut_lineage(fingerprints(df, id_col, text_col, words))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(nodes, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    linked = cut_lineage(roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()))
    least = linked.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    # Both sides of this join, and of the last one, come from storage, so that it can split a key that many rows have.
    named = linked.join(cut_lineage(least), "root").select("fp", "component_id", F.lit(True).alias("linked"))
    classes = nodes.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(cut_lineage(classes), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

import random

import numpy as np
from xxhash import xxh64_intdigest

from quiverlake.llm.components import connected_components
from quiverlake.llm.simhash import blocks_kept, Forest, fingerprint, links, simhash_groups


def _plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(words, radius):
    root = {w: w for w in words}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    order = sorted(root)
    for k, a in enumerate(order):
        for b in order[:k]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {w: find(w) for w in words}


def test_fingerprint_matches_its_definition():
    for t in [None, "", " \x0b\x0c", "one", "One TWO", "a b c", "A b C d", "Éa é b c d e", "x " * 500]:
        assert fingerprint((t or "").encode()) == _plain(t)


def test_forest_finds_all_pairs():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(4)]
    words = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(120)})
    shard = np.sort(np.array([w % 3 for w in words]))
    array = np.array(words, np.uint64)
    got = {(int(q), int(n)) for a, b in Forest(array, shard).near(2) for q, n in zip(a, b, strict=True)}
    want = {(q, n) for q in range(len(words)) for n in range(q) if shard[q] == shard[n] and bin(words[q] ^ words[n]).count("1") <= 2}
    assert got == want


def test_links_reach_what_all_pairs_reach(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    words = {0} | {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)} | set(base)
    signed = {w: w - (1 << 64) if w >> 63 else w for w in words}
    for heavy in (4096, 2):
        monkeypatch.setattr("quiverlake.llm.simhash.HEAVY", heavy)
        for radius in (2, 5):
            edges = links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), radius)
            got = {r["u"]: r["v"] for r in connected_components(edges).collect()}
            want = _groups(words, radius)
            same = lambda of: {frozenset(k for k in words if of(k) == v) for v in {of(k) for k in words}}
            assert same(lambda w: got.get(signed[w], signed[w])) == same(lambda w: want[w])


def test_components_of_a_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(7, 7)]
    got = {r["u"]: r["v"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(101, 141)} | {k: 1 for k in range(2, 60)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_groups_against_all_pairs(spark, docs, odd_rows):
    rng = random.Random(6)
    words = ["w%d" % k for k in range(400)]
    rows = list(odd_rows)
    for k in range(40):
        text = " ".join(rng.choice(words) for _ in range(80))
        rows += [(100 + 3 * k, text), (101 + 3 * k, text.upper()), (102 + 3 * k, text + " tail")]
    got = simhash_groups(docs(rows, extra=True)).collect()
    fp = {t: _plain(t) for _, t, *_ in rows}
    group = _groups(set(fp.values()), 2)
    least = {}
    for i, t, *_ in rows:
        g = group[fp[t]]
        if i is not None:
            least[g] = min(least.get(g, i), i)
    key = lambda r: tuple(map(str, r))
    want = [(i, f"{fp[t]:016x}", least.get(group[fp[t]])) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash_groups(docs([])).collect() == []


def test_components_with_hubs_and_long_paths(spark):
    """A hub with most of the edges, a path longer than any number of rounds that was ever fixed, and single edges."""
    rng = random.Random(5)
    edges = [(0, k) for k in range(1, 3000)] + [(k, 2999) for k in range(3000, 3100)]
    path = list(range(10_000, 12_000))
    edges += list(zip(path, path[1:], strict=False)) + [(20_000 + 2 * k, 20_001 + 2 * k) for k in range(50)]
    name = {v: rng.getrandbits(60) for e in edges for v in e}
    rng.shuffle(edges)
    got = {r["u"]: r["v"] for r in connected_components(spark.createDataFrame([(name[a], name[b]) for a, b in edges], "u long, v long")).collect()}
    groups = [list(range(3100)), path, *[[20_000 + 2 * k, 20_001 + 2 * k] for k in range(50)]]
    want = {name[v]: min(name[w] for w in g) for g in groups for v in g}
    assert got == {k: v for k, v in want.items() if k != v}


def test_blocks_grow_with_the_corpus():
    assert [blocks_kept(n, 2) for n in (0, 10**6, 10**12)] == [2, 2, 2]
    kept = [blocks_kept(n, 8) for n in (10**4, 10**6, 10**8, 10**10)]
    assert kept == sorted(kept) and kept[0] == 2 and kept[-1] > 3


def test_exploded_fingerprints_are_never_broadcast(spark):
    from pyspark.sql import functions as F

    nodes = spark.range(4000).select(F.xxhash64("id").alias("fp")).repartition(3).select("fp").distinct()
    got = links(nodes, 8)
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()

import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from quiverlake.llm.packing import _bin, bucket_bounds, encoder, FINE, pack, pack_documents


def test_bounds_are_optimal():
    rng = random.Random(7)
    for _ in range(30):
        tops = sorted(rng.sample(range(1, 200), rng.randint(1, 9)))
        counts = [rng.randint(1, 30) for _ in tops]
        cost = lambda bounds: sum(n * min(b for b in bounds if b >= t) for n, t in zip(counts, tops, strict=True))
        for k in (1, 2, 3, 20):
            best = min(cost([*c, tops[-1]]) for c in combinations(tops[:-1], min(k, len(tops)) - 1))
            got = bucket_bounds(counts, tops, k)
            assert len(got) <= k and got[-1] == tops[-1] and cost(got) == best
    assert bucket_bounds([], [], 4) == []


def test_bins_ascend_and_stay_narrow(spark):
    lengths = [*range(0, 3 * FINE, 7), 4095, 4096, 4097, 10**6, 10**9]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in lengths], "n long").select(_bin(F.col("n"))).collect()]
    assert got == sorted(got)
    ends = defaultdict(list)
    for n, b in zip(lengths, got, strict=True):
        ends[b].append(n)
    assert all(max(v) <= min(v) * (1 + 1 / 256) for v in ends.values())


def test_batches(spark):
    rng = random.Random(8)
    rows = [(k, min(900, int(rng.expovariate(1 / 60)))) for k in range(3000)] + [(9999, 50_000), (None, 5), (7, 5)]
    got = pack(spark.createDataFrame(rows, "id long, length long"), budget=4000, buckets=6).collect()
    assert sorted((str(r["id"]), r["length"]) for r in got) == sorted((str(i), n) for i, n in rows)
    batches = defaultdict(list)
    for r in got:
        assert r["length"] <= r["bound"]
        batches[r["bucket"], r["batch"]].append(r)
    full = defaultdict(list)
    for (bucket, batch), members in batches.items():
        fit = max(1, 4000 // max(1, members[0]["bound"]))
        assert sorted(m["place"] for m in members) == list(range(len(members))) and len(members) <= fit
        full[bucket].append((batch, len(members) == fit))
    for seen in full.values():
        assert sorted(b for b, _ in seen) == list(range(len(seen)))
        assert all(ok for b, ok in seen if b < len(seen) - 1)


def test_odd_rows(docs, odd_rows):
    got = pack_documents(docs(odd_rows, extra=True)).collect()
    assert len(got) == len(odd_rows)
    e = encoder()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == sorted((str(i), len(e.encode_ordinary(t or ""))) for i, t, *_ in odd_rows)
    assert {r["length"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert pack_documents(docs([])).collect() == []
    assert [r["bound"] for r in pack_documents(docs([(1, None)])).collect()] == [0]

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quiverlake.llm.mixing import mix, slot_schedule, source_targets, words_taken

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshares the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 10, None: 7}, {"x": 1}, {"a": 1, "b": 1000, "é": 3, "Z": 1000}, {"a": 5, "b": 5, "c": 5, "d": 5, "e": 500, "f": 2}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows, (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_schedule_is_complete_and_even(spark):
    sizes = spark.createDataFrame([("a", 300_000), ("b", 100_000), ("c", 40_000), ("d", 30)], "source string, size long")
    targets = source_targets(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    goal = {r["place"]: round(r["target"]) for r in targets.collect()}
    ranks = defaultdict(list)
    slots = sorted(map(tuple, slot_schedule(targets, 64).collect()))
    for slot, place, rank in slots:
        ranks[place].append(rank)
    for place, g in goal.items():
        assert ranks[place] == list(range(-(-g // 64)))  # each rank once, in the order of slots
    total, seen = len(slots), 0
    for k, (_, place, _) in enumerate(slots):
        seen += place == 0
        assert abs(seen - (k + 1) * len(ranks[0]) / total) < 12


def test_taken_matches_targets(spark, docs, odd_rows):
    rows = odd_rows + [(1000 + k, "w " * (k % 37), "en", "abc"[k % 3]) for k in range(300)]
    sizes, mixed = mix(docs(rows, extra=True), block=16)
    got = words_taken(sizes, mixed).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, _, s in [(*r, *((None,) * (4 - len(r)))) for r in rows]:
        size[s] += len(WORD.findall(t or ""))
    want = _targets(size)
    assert sorted((r["source_size"], round(r["target"], 6)) for r in got) == sorted((size[s], round(want[s], 6)) for _, _, _, s in [(*r, *((None,) * (4 - len(r)))) for r in rows])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    source = sizes.join(mixed.groupBy("row").agg(F.sum("words").alias("t")), "row").groupBy("target").agg(F.sum("t").alias("t")).collect()
    by_target = defaultdict(int)
    for s, w in want.items():
        by_target[round(w, 6)] += int(w + 0.5)
    assert {round(r["target"], 6): r["t"] for r in source} == {k: v for k, v in by_target.items() if v}


def test_reruns_agree_and_spans_fit(spark, docs):
    rows = [(k, "w " * (k % 50 + 1), "en", "ab"[k % 5 == 0]) for k in range(200)]
    one, two = ([tuple(r) for r in words_taken(*mix(docs(rows), block=32)).orderBy("doc_id").collect()] for _ in range(2))
    assert one == two
    sizes, mixed = mix(docs(rows), block=32)
    spans = mixed.join(sizes, "row").collect()
    assert all(0 <= r["first_word"] and r["first_word"] + r["words"] <= r["size"] for r in spans)
    per_slot = defaultdict(int)
    for r in spans:
        per_slot[r["slot"]] += r["words"]
    assert max(per_slot.values()) == 32 and sum(v < 32 for v in per_slot.values()) <= 2


def test_empty(docs):
    assert words_taken(*mix(docs([]))).collect() == []
    assert [r["taken"] for r in words_taken(*mix(docs([(1, None), (2, "")]))).collect()] == [0, 0]


def test_cap_beyond_two(spark, docs):
    rows = [(k, "word " * 50, "en", "a") for k in range(10)]
    got = words_taken(*mix(docs(rows, extra=True), share=3.5, cap=3.5)).collect()
    assert sum(r["taken"] for r in got) == 1750 and {r["taken"] for r in got} <= set(range(150, 201))

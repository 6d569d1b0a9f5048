import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from quiverlake.llm.fingerprints import LETTERS, WORDS, difference, fingerprint_edits, likeness, with_next

WORD = r"[^ \t\x0b\f\r\n]{1,%d}" % LETTERS
PARAGRAPH = re.compile(r"(?:%s[ \t\x0b\f\r]*){0,%d}%s" % (WORD, WORDS - 1, WORD))


def _chain(*parts):
    """Spark's xxhash64 of longs (8 bytes) and ints (4 bytes)."""
    seed = 42
    for value, width in parts:
        seed = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), seed)
    return seed


def _signed(u):
    return u - (1 << 64) if u >> 63 else u


def _keys(text):
    return {_signed(xxhash.xxh64_intdigest(p.encode(), 42)) for p in PARAGRAPH.findall(text or "")}


def _like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _cells(fingerprint):
    head, rest = fingerprint.split(":")
    n, third = (int(x, 16) for x in head.split("/"))
    return n, third, {int(c, 16): (int(k, 16), _signed(int(key, 16)), int(chk, 16)) for c, k, key, chk in (x.split(".") for x in rest.split(",") if x)}


def _peel(cells, third):
    """Digests by sign, and the cells that stay."""
    cells, out = dict(cells), {1: set(), -1: set()}
    while True:
        bare = [(n, key) for n, key, chk in cells.values() if abs(n) == 1 and chk == _chain((key, 8), (99, 4)) & 0xFFFFFFFF]
        if not bare:
            return out, cells
        for sign, key in set(bare):
            out[sign].add(key)
            for t in range(3):
                at = _signed(_chain((key, 8), (t, 4), (0, 4))) % third + t * third
                n, k, c = cells.get(at, (0, 0, 0))
                cells[at] = (n - sign, k ^ key, c ^ _chain((key, 8), (99, 4)) & 0xFFFFFFFF)
        cells = {a: c for a, c in cells.items() if any(c)}


def _from_strings(a, b):
    """The likeness by nothing but two fingerprints; None where a sketch of its first size does not peel."""
    (na, ta, ca), (nb, tb, cb) = _cells(a), _cells(b)
    if ta != tb:
        (da, ra), (db, rb) = _peel(ca, ta), _peel(cb, tb)
        return None if ra or rb else _like(da[1], db[1])
    diff = {at: tuple((x - y) if k == 0 else x ^ y for k, (x, y) in enumerate(zip(ca.get(at, (0, 0, 0)), cb.get(at, (0, 0, 0)), strict=True))) for at in ca.keys() | cb.keys()}
    got, rest = _peel({at: c for at, c in diff.items() if any(c)}, ta)
    return None if rest else (na - len(got[1])) / (na + len(got[-1])) if na + len(got[-1]) else 1.0


def _order(rows):
    h = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1
    return sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1])))


def _check(got, rows):
    order, want = _order(rows), []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        k = len(a) // 3
        e = a[: len(a) - k] + b[:k]
        want.append((str(i), len(a), hashlib.sha256(e.encode()).hexdigest(), round(_like(_keys(a), _keys(e)), 9), round(_like(_keys(a), _keys(b)), 9)))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == sorted(want)


def _rows(odd_rows):
    rng = random.Random(9)
    lines = ["line %d %s" % (k, "x y" * rng.randint(0, 60)) for k in range(60)]
    return odd_rows + [(100 + k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 80)))) for k in range(60)]


def test_against_sets(docs, odd_rows):
    rows = _rows(odd_rows)
    got = fingerprint_edits(docs(rows, extra=True)).collect()
    _check(got, rows)
    same = {}
    for (_, t), r in zip(_order(rows), sorted(got, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0))), strict=True):
        if r["doc_id"] in (6, 1, 2):
            same.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert fingerprint_edits(docs([])).collect() == []
    (sole,) = fingerprint_edits(docs([(5, "abcdef")])).collect()
    assert sole["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and sole["near_next"] == 1.0


def test_likeness_is_that_of_the_fingerprints(docs, odd_rows):
    got = fingerprint_edits(docs(_rows(odd_rows))).collect()
    again = [(r["near_edited"], _from_strings(r["fingerprint"], r["edited_fingerprint"])) for r in got]
    known = [(a, b) for a, b in again if b is not None]
    assert len(known) >= 0.9 * len(again) and all(abs(a - b) < 1e-9 for a, b in known)


def test_very_many_paragraphs(docs):
    """A megabyte of short lines, more than 16 bits count."""
    long = "\n".join("line %d" % k for k in range(70_000))
    rows = [(1, long), (2, long.replace("9\n", "nine\n")), (3, "short")]
    got = fingerprint_edits(docs(rows)).collect()
    _check(got, rows)
    assert {r["fingerprint"].split("/")[0] for r in got} == {hex(70_000)[2:], "1"}


def test_next_crosses_ranges(spark):
    rows = [(k * k, "t%d" % k) for k in range(1, 120)] + [(None, "none")]
    rows += [(50, "hot %d" % k) for k in range(60)] + [(None, "null %d" % k) for k in range(40)]
    for some in (rows, rows[:119], rows[120:180], rows[180:]):
        d = with_next(spark.createDataFrame(some, "i long, t string"), "i", "t", rows=7)
        order = _order(some)
        assert {r["text"]: r["next_text"] for r in d.collect()} == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_peeling_recovers_differences(spark):
    rng = random.Random(10)
    pool = [rng.getrandbits(62) for _ in range(900)]
    rows = []
    for size in (0, 1, 5, 40, 300, 800):
        base = rng.sample(pool, size)
        rows += [(base, base), (base, base[: size // 2]), (base, rng.sample(pool, size)), (base, [-k for k in base])]
    d = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", difference(F.col("a"), F.col("b")).alias("d"), likeness(F.col("a"), F.col("b")).alias("l"))
    for r in d.collect():
        a, b = set(r["a"]), set(r["b"])
        assert r["d"]["tries"] > 0 and (r["d"]["plus"], r["d"]["minus"]) == (len(a - b), len(b - a))
        assert abs(r["l"] - _like(a, b)) < 1e-12

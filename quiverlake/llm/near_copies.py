"""Near copies: SimHash links as candidates, exact similarity of word shingles as verdict.

Texts link if the Jaccard similarity of their sets of five-word shingles is at
least ``least``; groups are the connected components of the links. Candidates
are all pairs within one component of the SimHash links (``simhash.links``),
so a pair may be more than ``radius`` bits apart.

Texts with one set are one class. In each candidate group every class is first
compared with a few pivots; what that leaves outside the group's largest part
is then compared with the whole group, slice by slice, so that all links that
join parts are found though not all pairs are compared. Nothing is capped.

Sets hold 64-bit hashes. Rows: texts without words, and null ones, are one class.
Repeated rows stay. Null ids never are a component's id unless all its ids are
null. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverlake.llm._common import cut_lineage
from quiverlake.llm.components import connected_components
from quiverlake.llm.simhash import fingerprint, links

#: Classes that a task holds of a group at once.
SLICE = 1024
PIVOTS = 4


def shingles(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles of UTF-8 text, ASCII lower case; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: max(1, len(parts) - words + 1)].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64))


def overlaps(one: np.ndarray, hashes: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
    """How many of a set's hashes each of ``many`` sets has; ``hashes``: those of all, sorted, with their owners."""
    low, high = np.searchsorted(hashes, one), np.searchsorted(hashes, one, side="right")
    n = high - low
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.bincount(owner[at], minlength=many)


def similar(one: np.ndarray, sets: list[np.ndarray], index: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of at least ``least`` to one set."""
    size = np.array([len(s) for s in sets])
    both = overlaps(one, *index, len(sets))
    return both >= least * (size + len(one) - both) - 1e-9


def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], owner[order]


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _to_pivots(sets: DataFrame, least: float) -> DataFrame:
    """(u, v): links of classes to the pivots of their group."""
    first = Window.partitionBy("root").orderBy(F.xxhash64("num"), "num")
    pivots = sets.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= PIVOTS)
    pivots = cut_lineage(pivots.groupBy("root").agg(F.collect_list(F.struct("num", "shingles")).alias("pivots")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            u, v = [], []
            for num, raw, pivots in zip(*(b.column(c).to_pylist() for c in ("num", "shingles", "pivots")), strict=True):
                mine = _set(raw)
                others = [_set(p["shingles"]) for p in pivots]
                for k in np.flatnonzero(similar(mine, others, inverted(others), least)).tolist():
                    u.append(num)
                    v.append(pivots[k]["num"])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return sets.join(pivots, "root").select("num", "shingles", "pivots").mapInArrow(run, "u long, v long")


def _to_all(sets: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(u, v): links between classes outside their group's largest part and all of the group, one a part and slice."""
    named = cut_lineage(sets.join(parts.select(F.col("u").alias("num"), F.col("v").alias("part")), "num", "left").withColumn("part", F.coalesce("part", "num")))
    sizes = named.groupBy("root", "part").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("root").agg(F.sum("n").alias("all"), F.count("*").alias("parts"), F.max_by("part", F.struct("n", "part")).alias("main"))
    open_groups = cut_lineage(groups.filter("parts > 1").select("root", "main", F.ceil(F.col("all") / SLICE).cast("int").alias("slices")))
    met = named.join(open_groups, "root")
    own = met.select("root", F.pmod(F.xxhash64("num"), F.col("slices")).cast("int").alias("slice"), F.lit(0).alias("kind"), "num", "part", "shingles")
    rest = met.filter("part <> main").select("root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("kind"), "num", "part", "shingles")
    dealt = own.unionByName(rest).repartition("root", "slice").sortWithinPartitions("root", "slice", "kind")

    def run(batches):
        import pyarrow as pa

        at, held, ready = None, [], None
        for b in batches:
            u, v = [], []
            for root, part, kind, num, own_part, raw in zip(*(b.column(c).to_pylist() for c in ("root", "slice", "kind", "num", "part", "shingles")), strict=True):
                if (root, part) != at:
                    at, held, ready = (root, part), [], None
                if kind == 0:
                    held.append((num, own_part, _set(raw)))
                    continue
                if not held:
                    continue
                if ready is None:
                    sets = [s for _, _, s in held]
                    ready = sets, inverted(sets)
                reached = {own_part}
                for k in np.flatnonzero(similar(_set(raw), *ready, least)).tolist():
                    if held[k][1] not in reached:
                        reached.add(held[k][1])
                        u.append(num)
                        v.append(held[k][0])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 6, least: float = 0.8, words: int = 5) -> DataFrame:
    """(id, component_id) for each row; component_id: the smallest id that links reach."""
    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def mark(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            raw = [t.as_py() for t in b.column(1)]
            fp = np.array([fingerprint(t) for t in raw], np.uint64).view(np.int64)
            keys = [xxh3_128_digest(shingles(t, words).tobytes()) for t in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), pa.array(keys, pa.binary())], names=["id", "fp", "key"])

    def read(batches):
        import pyarrow as pa

        for b in batches:
            sets = [shingles(t.as_py(), words).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("num"), pa.array(sets, pa.binary())], names=["root", "num", "shingles"])

    rows = cut_lineage(texts.mapInArrow(mark, f"id {id_type}, fp long, key binary"))
    classes = cut_lineage(rows.groupBy("key", "fp").agg(F.min("id").alias("least")))
    whole = classes.groupBy("key").agg(F.min("fp").alias("first"), F.min("least").alias("least"))
    same = classes.join(whole.select("key", "first"), "key").filter("fp <> first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    roots = connected_components(links(classes.select("fp").distinct(), radius).unionByName(same))
    group = whole.join(roots.select(F.col("u").alias("first"), F.col("v").alias("root")), "first", "left")
    # A class goes by a number from here on, as long as the table that gives it is stored.
    group = cut_lineage(group.select(F.monotonically_increasing_id().alias("num"), "key", "least", F.coalesce("root", "first").alias("root")))
    several = group.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    wanted = cut_lineage(group.join(several, "root"))
    # A class's text is that of a row with its smallest id. Only ids meet texts, so that a class of many rows is no heavy key.
    ids = wanted.select("least").distinct()
    found = texts.join(ids, F.col("id").eqNullSafe(F.col("least")), "left_semi").mapInArrow(_keyed(words), f"id {id_type}, key binary, text binary")
    sets = found.dropDuplicates(["key"]).join(wanted.select("root", "num", "key"), "key").select("root", "num", "text").mapInArrow(read, "root long, num long, shingles binary")
    sets = cut_lineage(sets)
    near = cut_lineage(_to_pivots(sets, least))
    parts = connected_components(near)
    merged = connected_components(near.unionByName(_to_all(sets, parts, least)))
    named = group.join(merged.select(F.col("u").alias("num"), F.col("v").alias("top")), "num", "left").select("key", "least", F.coalesce("top", "num").alias("top"))
    named = cut_lineage(named)
    component = named.groupBy("top").agg(F.min("least").alias("component_id"))
    chosen = cut_lineage(named.join(component, "top").select("key", "component_id"))
    return rows.join(chosen, "key").select(F.col("id").alias(id_col), "component_id")


def _keyed(words: int):
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            keys = [xxh3_128_digest(shingles(t.as_py(), words).tobytes()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), b.column("text")], names=["id", "key", "text"])

    return run

"""Mixing sources to target weights by a low-discrepancy schedule.

Points of the golden-ratio sequence, frac((i + 1) * phi), run through the
cumulative targets of the sources: the source whose interval holds point i owns
slot i, so in every stretch of slots each source has its share within a few
slots. The r-th slot of a source takes the r-th block of its shuffled words;
all blocks have the same number of words, and a document is cut where a block
ends. Slots beyond a source's quota are void; a source that the points leave a
few slots short gets them at the end; so the words taken equal the target.
Read in the order of slots, the mix is even all along.

DataFrame functions only. Shuffled order, ranks and block limits come from
running sums over slices (``running_position``), never from one window over a
whole source or over all sources; a source with a third of all rows is one of
many slices, and sources may be as many as documents.

Rows: null and empty texts have size 0 and are taken 0 times. Null is a source
of its own, ordered last. Rows with the same id are mixed each on its own;
extra columns are not read. An empty table gives an empty result; if no source
has words, nothing is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm._common import WORD, cut_lineage, running_position

GOLDEN = 0.6180339887498949
#: The unit interval is cut into so many cells at least, to look a point's source up by an equal join.
CELLS = 1 << 14


def placed_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, place): sources by code point, null last, counted from 0 over sorted ranges."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranged = totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    part = F.shiftrightunsigned("at", 33)
    before, at = {}, 0
    for p, n in sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect()):
        before[p], at = at, at + n
    starts = F.create_map(*[F.lit(x).cast("long") for pair in (before or {0: 0}).items() for x in pair])
    place = F.element_at(starts, part) + F.col("at").bitwiseAND((1 << 33) - 1)
    return ranged.select("source", "source_size", place.alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, place, source_size, weight, target): water-filling of ``share`` of all sizes under ``cap`` times each size.

    The level, what a weight of one gets, starts as if no source was at its cap;
    those that it puts above are set to their cap, which raises it, until no
    more come. Each step is one aggregate.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    totals = placed_sources(sizes).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    totals = cut_lineage(totals)
    level, full = 0.0, -1
    while True:
        capped = (F.col("weight") * F.lit(level) >= F.col("limit")) if full >= 0 else F.lit(False)
        one = totals.agg(F.sum("source_size"), F.count_if(capped), F.sum(F.when(capped, F.col("limit"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if one[1] == full or not one[3]:
            break
        full, level = one[1], ((one[0] or 0) * share - (one[2] or 0.0)) / one[3]
    target = F.least(F.col("limit"), F.col("weight") * F.lit(level)) if level > 0 else F.lit(0.0)
    return totals.withColumn("target", target.cast("double")).select("source", "place", "source_size", "weight", "target")


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, place, rank): the source of each slot and the slot's rank within its source."""
    spark = targets.sparkSession
    quota = targets.select("place", F.round("target").cast("long").alias("goal")).withColumn("quota", F.ceil(F.col("goal") / F.lit(block)).cast("long"))
    total = quota.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count_if(F.col("quota") > 0), F.max("place")).first()
    n, cells, most = int(total[0]), CELLS, max(1, (total[2] or 0) + 1)
    while cells < total[1]:
        cells *= 2
    lines = running_position(quota.filter("quota > 0"), [], [F.col("place")], F.col("quota"), "first", slice_of=F.floor(F.col("place") * 1024 / F.lit(most)))
    # Both limits are a whole number over the same divisor, so no point falls between two sources.
    lines = lines.withColumn("low", F.col("first") / F.lit(float(max(n, 1)))).withColumn("high", (F.col("first") + F.col("quota")) / F.lit(float(max(n, 1))))
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    lines = lines.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))).select("place", "quota", "low", "high", "cell")
    turn = (F.col("slot") + 1) * F.lit(GOLDEN)
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", turn - F.floor(turn)).withColumn("cell", cell(F.col("x")))
    # Stored, as the ranks and the shortfall both read it: the plan, and what the driver holds of it, stays small.
    owned = cut_lineage(points.join(lines, "cell").filter("x >= low and x < high").select("slot", "place", "quota"))
    ranked = running_position(owned, ["place"], [F.col("slot")], F.lit(1), "rank", slice_of=F.floor(F.col("slot") * 1024 / F.lit(max(n, 1))))
    inside = ranked.filter("rank < quota").select("slot", "place", "rank")
    have = owned.groupBy("place").agg(F.count("*").alias("have"))
    short = quota.join(have, "place", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < quota")
    tail = short.withColumn("rank", F.explode(F.sequence(F.col("have"), F.col("quota") - 1))).select((F.lit(n) + F.col("rank")).alias("slot"), "place", "rank")
    return inside.unionByName(tail)


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, block: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """The sizes and the mix.

    sizes: (row, id, key1, key2, size, source_size, target), one row a document; the keys are two hashes of id, source and text.
    mix: (slot, row, turn, first_word, words): the spans of words that the slots hold, and which time it is that the document is taken.
    """
    parts = [F.col(id_col), F.col(source_col), F.col(text_col)]
    sized = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *[k.alias(f"key{j}") for j, k in enumerate(row_keys(*parts), 1)],
    )
    sized = cut_lineage(sized.withColumn("row", F.monotonically_increasing_id()))
    targets = cut_lineage(source_targets(sized, weights, share, cap))
    named = targets.select(F.col("source").alias("its_source"), "place", "source_size", "target")
    sizes = sized.join(named, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    placed = running_position(sizes.filter("size > 0"), ["place"], [F.xxhash64("id", F.lit(41)), F.col("id"), F.col("key1")], F.col("size"), "start")
    placed = placed.withColumn("goal", F.round("target").cast("long"))
    turns = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max(1, math.ceil(cap)) - 1))))
    turns = turns.withColumn("from", F.col("turn") * F.col("source_size") + F.col("start"))
    turns = turns.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal"))).filter("to > from")
    spans = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    first, last = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    spans = spans.select("place", "rank", "row", "turn", (first - F.col("from")).alias("first_word"), (last - first).alias("words"))
    mixed = cut_lineage(slot_schedule(targets, block)).join(spans, ["place", "rank"]).select("slot", "row", "turn", "first_word", "words")
    return sizes.select("row", "id", "key1", "key2", "size", "source_size", "target"), mixed


def row_keys(*parts):
    """Two hashes that together tell rows apart."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(3), *parts)


def words_taken(sizes: DataFrame, mixed: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """(id, size, source_size, target, taken, first_slot, blocks) for each document: words, the first slot that has some of them, and in how many slots they are."""
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("blocks"))
    zero = F.lit(0)
    return sizes.join(taken, "row", "left").select(
        F.col("id").alias(id_name), "size", "source_size", "target", F.coalesce("taken", zero).cast("long").alias("taken"), "first_slot", F.coalesce("blocks", zero).cast("long").alias("blocks")
    )


def turns_taken(sizes: DataFrame, mixed: DataFrame) -> DataFrame:
    """(key1, key2, turn, first_slot): each time that a document comes in the mix, and where. Rows alike in id, source and text count as one."""
    return mixed.join(sizes.select("row", "key1", "key2"), "row").groupBy("key1", "key2", "turn").agg(F.min("slot").alias("first_slot"))

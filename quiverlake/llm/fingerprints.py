"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, a long one in runs of at most ``WORDS`` words
(of at most ``LETTERS`` code points each, longer ones being cut); the digest of a
paragraph is its 64-bit xxHash, and a text stands for the set of its digests. A sketch has three
tables of cells, as many in each as the next power of two from the number of
digests on. Each digest is in one cell of each table, where a cell keeps how
many digests it has, their xor and the xor of a check value. The fingerprint is
this sketch, written out: ``digests/third:`` and the cells in use as
``cell.n.key.check`` in hex.

Two sketches of one size subtract cell by cell: what the versions share goes,
what differs stays. A cell that is left with one digest gives it away; taken out
of its other cells, it lays others bare (peeling). A pair is compared at the
larger of its two sizes, the smaller sketch dealt out anew (its own digests are
what peeling gives back). If cells remain, the pair is tried again with tables
of twice the size and other hash functions, until nothing remains.

The likeness of two texts is shared over all digests: with p and q recovered
on either side, (|A| - p) / (|A| + q); two empty sets have 1. A text of one
paragraph is all or nothing.

DataFrame functions only; all work on a document is in its own row, and grows
with its digests as sorting them does.

Rows: null is the empty text, whose sketch has no cells. Texts of one digest
set have one fingerprint. Documents with one id are ordered by their text's
hash, then by text; null ids come last. A sole document is its own next one.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a line that make one paragraph at most, and code points of such a word.
WORDS, LETTERS = 16, 24
_WORD = rf"[^ \t\x0B\f\r\n]{{1,{LETTERS}}}"
PARAGRAPH = rf"(?:{_WORD}[ \t\x0B\f\r]*+){{0,{WORDS - 1}}}{_WORD}"
#: Cells of a table at least.
LEAST = 16
#: Sizes that are tried, each twice the one before; rounds of peeling in each.
TRIES, ROUNDS = 24, 60


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF))


def third_of(n: Column) -> Column:
    """Cells of each table for so many digests."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(LEAST))))).cast("int")


def _entries(keys: Column, sign: int, third: Column, seed: Column) -> Column:
    """The three cells of each key."""

    def at(key: Column, chk: Column, table: int) -> Column:
        cell = F.pmod(F.xxhash64(key, F.lit(table), seed), third.cast("bigint")) + third * F.lit(table)
        return F.struct(cell.cast("int").alias("cell"), F.lit(sign).alias("n"), key.alias("key"), chk.alias("chk"))

    with_check = F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("c")))
    return F.flatten(F.transform(with_check, lambda x: F.array(*[at(x["k"], x["c"], t) for t in range(3)])))


def _sum(entries: Column) -> Column:
    """Entries added up by cell, in the order of cells, without empty cells: sorted, and one slice a cell."""

    def cells(s: Column) -> Column:
        n = F.size(s)
        heads = F.filter(F.sequence(F.lit(1), n), lambda p: (p == 1) | (F.get(s, p - 1)["cell"] != F.get(s, p - 2)["cell"]))

        def added(heads: Column) -> Column:
            def cell(at: Column, k: Column) -> Column:
                part = F.slice(s, at, F.coalesce(F.get(heads, k + 1), n + 1) - at)
                first = F.element_at(part, 1)
                more = lambda a, e: F.struct(a["cell"].alias("cell"), (a["n"] + e["n"]).alias("n"), a["key"].bitwiseXOR(e["key"]).alias("key"), a["chk"].bitwiseXOR(e["chk"]).alias("chk"))
                return F.when(F.size(part) == 1, first).otherwise(F.aggregate(F.slice(part, F.lit(2), F.size(part)), first, more))

            return F.filter(F.transform(heads, cell), lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0))

        return F.when(n == 0, s).otherwise(_let(heads, added))

    return _let(F.sort_array(entries), cells)


def sketch(keys: Column, third: Column | None = None, seed: Column | None = None) -> Column:
    """The cells of a set's sketch."""
    return _sum(_entries(keys, 1, third_of(F.size(keys)) if third is None else third, F.lit(0) if seed is None else seed))


def shown(keys: Column) -> Column:
    """The sketch as text."""
    cells = F.transform(sketch(keys), lambda c: F.concat_ws(".", F.hex(c["cell"]), F.hex(c["n"]), F.hex(c["key"]), F.hex(c["chk"])))
    return F.lower(F.concat(F.hex(F.size(keys)), F.lit("/"), F.hex(third_of(F.size(keys))), F.lit(":"), F.array_join(cells, ",")))


def _peeled(left: Column, right: Column, third: Column, seed: Column) -> Column:
    """(rest, plus, minus): cells that peeling left, and the digests that only one side has."""

    def state(rest: Column, plus: Column, minus: Column, stuck: Column) -> Column:
        return F.struct(rest.alias("rest"), plus.alias("plus"), minus.alias("minus"), stuck.alias("stuck"))

    def step(s: Column) -> Column:
        bare = F.filter(s["rest"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"])))

        def found(bare: Column) -> Column:
            side = lambda sign: F.array_distinct(F.transform(F.filter(bare, lambda c: c["n"] == sign), lambda c: c["key"]))
            return F.struct(side(1).alias("mine"), side(-1).alias("theirs"))

        def taken(f: Column) -> Column:
            rest = _sum(F.concat(s["rest"], _entries(f["mine"], -1, third, seed), _entries(f["theirs"], 1, third, seed)))
            return state(rest, s["plus"] + F.size(f["mine"]), s["minus"] + F.size(f["theirs"]), F.lit(False))

        none = state(s["rest"], s["plus"], s["minus"], F.lit(True))
        return _let(bare, lambda b: F.when(F.size(b) == 0, none).otherwise(_let(found(b), taken)))

    start = state(_sum(F.concat(_entries(left, 1, third, seed), _entries(right, -1, third, seed))), F.lit(0), F.lit(0), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["stuck"] | (F.size(s["rest"]) == 0), s).otherwise(step(s)))


def difference(left: Column, right: Column) -> Column:
    """(tries, plus, minus) of two digest sets: peeled, with larger tables after each failure; an error if that never ends."""

    def attempt(third: Column) -> Column:
        def on(s: Column, k: Column) -> Column:
            got = _peeled(left, right, third * F.pow(F.lit(2), F.least(k, F.lit(8))).cast("int"), k)
            new = _let(got, lambda g: F.struct(F.when(F.size(g["rest"]) == 0, k + 1).otherwise(F.lit(0)).alias("tries"), g["plus"].alias("plus"), g["minus"].alias("minus")))
            return F.when(s["tries"] > 0, s).otherwise(new)

        start = F.struct(F.lit(0).alias("tries"), F.lit(0).alias("plus"), F.lit(0).alias("minus"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), start, on)

    never = F.raise_error(F.lit("sketches do not peel")).cast("struct<tries:int,plus:int,minus:int>")
    return _let(_let(F.greatest(third_of(F.size(left)), third_of(F.size(right))), attempt), lambda s: F.when(s["tries"] > 0, s).otherwise(never))


def likeness(left: Column, right: Column) -> Column:
    def ratio(d: Column) -> Column:
        union = F.size(left) + d["minus"]
        return F.when(union == 0, F.lit(1.0)).otherwise((F.size(left) - d["plus"]) / union)

    return _let(difference(left, right), ratio).cast("double")


def with_next(df: DataFrame, id_col: str, text_col: str, rows: int = 1000, most: int = 16384, add: dict | None = None) -> DataFrame:
    """(id, text, next_text), and name and next_name for each function of the text in ``add``.

    Next is the row that follows by descending id; after the last row comes the
    first. Ids are cut into ranges of about ``rows`` rows (``most`` ranges at most,
    the bound of what the driver holds). An id that fills several ranges, null
    too, is apart from the others and cut by the hash of the text. A range gets a
    copy of the row that heads the next one, so each window is of one range.
    """
    spark, kind, id_ = df.sparkSession, df.schema[id_col].dataType.simpleString(), F.col("id")
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    n = base.count()
    rows = max(rows, -(-n // most))
    many = {r[0]: -(-r[1] // rows) for r in base.groupBy("id").count().where(F.col("count") > 2 * rows).collect()}  # most / 2 of them at most
    parts = max(1, -(-n // rows))
    cuts = base.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 4 * parts))).first()[0] if parts > 1 else None
    cuts = sorted({*(cuts or []), *(i for i in many if i is not None)})
    at = F.lit(0)
    if cuts:  # how many cuts are not above the id
        bounds, width = F.lit(cuts).cast(f"array<{kind}>"), 1 << (len(cuts).bit_length() - 1)
        steps = F.array(*[F.lit(width >> k) for k in range(width.bit_length())])
        at = F.aggregate(steps, F.lit(0), lambda at, w: F.when(F.coalesce(F.try_element_at(bounds, at + w) <= id_, F.lit(False)), at + w).otherwise(at))
    slices = F.when(id_.isNull(), F.lit(many.get(None, 1)))
    known = [F.lit(x) for i, c in many.items() if i is not None for x in (i, c)]
    slices = slices.otherwise(F.coalesce(F.try_element_at(F.create_map(*known), id_), F.lit(1)) if known else F.lit(1))
    part = F.when(id_.isNull(), -1).when(slices > 1, 2 * at).otherwise(2 * at + 1)
    base = base.withColumn("part", part.cast("int")).withColumn("slice", F.floor(F.col("h") / F.lit(float(1 << 63)) * slices).cast("int"))
    heads = base.groupBy("part", "slice").agg(F.max(F.struct("id", (-F.col("h")).alias("h"))).alias("m")).collect()
    heads = sorted(((r["part"], r["slice"], r["m"]["id"], -r["m"]["h"]) for r in heads), key=lambda r: (-r[0], r[1]))
    to = [(i, h, *heads[k - 1][:2]) for k, (_, _, i, h) in enumerate(heads)]
    to = spark.createDataFrame(to, f"head {kind}, head_h long, to_part int, to_slice int")
    met = base.join(F.broadcast(to), id_.eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    place = lambda part, slice_, copy: F.struct(F.col(part).alias("part"), F.col(slice_).alias("slice"), F.lit(copy).alias("copy"))
    places = F.filter(F.array(place("part", "slice", False), place("to_part", "to_slice", True)), lambda x: x["part"].isNotNull())
    dealt = met.select("id", "text", "h", F.explode(places).alias("at")).select("id", "text", "h", "at.part", "at.slice", "at.copy").repartition("part", "slice")
    add = add or {}
    dealt = dealt.select("*", *[f(F.col("text")).alias(name) for name, f in add.items()])
    down = Window.partitionBy("part", "slice").orderBy("copy", id_.desc_nulls_last(), "h", "text")
    columns = ["text", *add]
    return dealt.select("id", *columns, "copy", *[F.lead(c).over(down).alias(f"next_{c}") for c in columns]).filter(~F.col("copy")).drop("copy")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like its own is to the edited and to the next one's.

    Edited: the last third of the code points gives way to as many from the
    beginning of the next document (all of it, if shorter).
    """
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(texts, "id", "text", add={"keys": digests})
    n = F.length("text").cast("long")
    cut = F.floor(n / 3)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut.cast("int")))
    rows = pairs.select("id", "keys", "next_keys", n.alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_keys", digests(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    keys = F.col("keys")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", shown(keys).alias("fingerprint"), shown(F.col("edited_keys")).alias("edited_fingerprint"),
        likeness(keys, F.col("edited_keys")).alias("near_edited"), likeness(keys, F.col("next_keys")).alias("near_next"), F.size(keys).alias("n_paragraphs"),
    )

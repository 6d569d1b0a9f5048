"""Top-k by inner product.

One query: scores as a column expression, then sort and limit, which Spark runs
as a bounded heap a task (TakeOrderedAndProject). A batch of queries goes to
the executors as one matrix, if it is within ``MOST_QUERIES``; each Arrow batch
of rows is scored by one matrix product, and a task gives its k best rows a query, so
that what is shuffled does not depend on the number of rows but on the number
of tasks. More queries are taken in blocks of that size.

Where the query table has a column ``again`` and a second vector of the rows is
given, the k best are scored once more, by that vector, in the task that found
them, so that no vector is read twice or shuffled; the result is the column ``again``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from quiverlake.functions import vectors as V
from quiverlake.schema import total_order

MOST_QUERIES = 4096
#: Queries that are scored at once against a batch of rows.
QUERY_ROWS = 512
METRICS: dict[str, Callable[[Column, Column], Column]] = {"dot_product": V.dot, "cosine": V.cosine, "l2": lambda a, b: -V.squared_l2(a, b)}


def _ranked(df: DataFrame, k: int, by: list[str], key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*total_order(key=key)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(rows: DataFrame, query, k: int, vector: str = "embedding", key: str = "vector_id", metric: str = "dot_product") -> DataFrame:
    """The k best rows for one query, with score, best first. None for k below 1."""
    scored = rows.withColumn("score", METRICS[metric](F.col(vector), V.literal(query)))
    return scored.where("score is not null").orderBy(*total_order(key=key)).limit(max(k, 0))


def top_k_scored(scored: DataFrame, k: int, by: list[str], key: str = "vector_id") -> DataFrame:
    """The k best rows of each group by score, with their rank."""
    return _ranked(scored.where("score is not null"), k, by, key)


def query_matrices(queries: DataFrame, most: int = MOST_QUERIES) -> Iterator[tuple[list, np.ndarray, np.ndarray | None]]:
    """Ids and vectors of the query set, and its vectors ``again`` if it has any, in blocks of at most ``most``, dealt by hash where there are more."""
    names = [c for c in ("query", "again") if c in queries.columns]
    read = lambda df: df.select("qid", *names).limit(most + 1).collect()
    vectors = lambda got, c: np.array([r[c] for r in got], np.float64) if c in names else None
    matrix = lambda got: ([r["qid"] for r in got], vectors(got, "query"), vectors(got, "again"))
    got = read(queries)
    if len(got) <= most:
        yield matrix(got)
        return
    parts = -(-2 * queries.count() // most)
    dealt = lambda p: F.pmod(F.xxhash64("qid"), F.lit(p)).cast("int")
    while queries.groupBy(dealt(parts).alias("p")).count().agg(F.max("count")).first()[0] > most:
        parts *= 2
    for p in range(parts):
        yield matrix(read(queries.where(dealt(parts) == p)))


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) scores by one matrix product; what is not finite counts as no score."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        s = q @ x.T
        if metric == "cosine":
            s = s / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((x * x).sum(1))
        elif metric == "l2":
            s = 2 * s - (x * x).sum(1) - (q * q).sum(1)[:, None]
    return np.where(np.isfinite(s), s, -np.inf)


def best(q: np.ndarray, x: np.ndarray, metric: str, k: int, tops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows a query, and of all that tie with them.

    ``tops``: the k best scores of each query in what was seen before; rows below them are left out, and it is brought up to date.

    The matrix product only finds them: what it gives for a pair depends on
    where in the matrix it is, by a rounding. Their scores are summed once more pair
    by pair, so that equal vectors have equal scores.
    """
    tops = np.full((len(q), k), -np.inf) if tops is None else tops
    found = [sifted(scores(q[at : at + QUERY_ROWS], x, metric), tops[at : at + QUERY_ROWS]) for at in range(0, len(q), QUERY_ROWS)]
    qi = np.concatenate([f[0] + at * QUERY_ROWS for at, f in enumerate(found)]) if found else np.zeros(0, np.int64)
    ri = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return qi, ri, paired(q, x, metric, qi, ri)


def sifted(s: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the scores that are, but for a rounding, among each query's best of this matrix and of what was seen before; brings ``tops`` up to date."""
    k = tops.shape[1]
    if np.isinf(tops).any():
        n = min(k, s.shape[1])
        seen = np.concatenate([tops, np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n :]], axis=1)
        tops[:] = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k :]
        qi, ri = np.nonzero((s >= _near(tops)[:, None]) & (s > -np.inf))
        return qi, ri
    qi, ri = np.nonzero(s >= _near(tops)[:, None])
    if qi.size:
        who, own, many = np.unique(qi, return_inverse=True, return_counts=True)
        more = np.full((who.size, int(many.max())), -np.inf)
        more[own, np.arange(qi.size) - np.repeat(np.cumsum(many) - many, many)] = s[qi, ri]
        seen = np.concatenate([tops[who], more], axis=1)
        tops[who] = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k :]
    return qi, ri


def _near(tops: np.ndarray) -> np.ndarray:
    limit = tops.min(axis=1)
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(limit), limit - 1e-9 * np.maximum(1.0, np.abs(limit)), limit)


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c with one rounding. The product's error is found exactly, and the small parts are added rounding to odd (Boldo and Melquiond)."""
    p = a * b
    (ah, al), (bh, bl) = _split(a), _split(b)
    low = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    u, ul = _two_sum(c, low)
    t, tl = _two_sum(p, u)
    v, r = _two_sum(tl, ul)
    bits = v.view(np.int64)
    odd = np.where((r != 0) & (bits & 1 == 0), np.where((r > 0) == (v > 0), 1, -1), 0)
    z = t + (bits + odd).view(np.float64)
    return np.where(np.isfinite(z), z, p + c)


def fused_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, each component's product added with one rounding, in their order: as DuckDB has them."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out = fused(np.ascontiguousarray(a[:, j]), np.ascontiguousarray(b[:, j]), out)
    return out


def paired(q: np.ndarray, x: np.ndarray, metric: str, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Scores of single pairs, in double precision."""
    out = np.empty(qi.size)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for at in range(0, qi.size, 65_536):
            a, b = q[qi[at : at + 65_536]], x[ri[at : at + 65_536]].astype(np.float64, copy=False)
            if metric == "l2":
                out[at : at + 65_536] = -((a - b) ** 2).sum(1)
            else:
                dot = fused_dot(a, b)
                out[at : at + 65_536] = dot if metric == "dot_product" else dot / (np.sqrt(fused_dot(a, a)) * np.sqrt(fused_dot(b, b)))
    return out


def table_of(column, rows: int, width: int) -> np.ndarray:
    """A column of vectors as a matrix, after a check of their length."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    if x.shape[1] != width:
        raise ValueError(f"vectors of {x.shape[1]} components, queries of {width}")
    return x


def with_again(hits, column, queries: np.ndarray, metric: str, qi: np.ndarray, ri: np.ndarray):
    """The rows of hits with their second score; null where it is not finite."""
    import pyarrow as pa

    score = paired(queries, table_of(column, len(column), queries.shape[1]), metric, qi, ri)
    return pa.RecordBatch.from_arrays([*hits.columns, pa.array(score, mask=~np.isfinite(score))], names=[*hits.schema.names, "again"])


class Running:
    """The k best rows of each query that a task has seen, by score and then by key; so a task gives k rows a query, however many it reads or tie."""

    def __init__(self, k: int, queries: int, key: str):
        self.k, self.key, self.most, self.held, self.rows = k, key, max(1 << 16, 4 * k * queries), [], 0
        self.tops = np.full((queries, k), -np.inf)

    def add(self, qi: np.ndarray, rows, score: np.ndarray) -> None:
        """``rows``: a record batch with the key first."""
        import pyarrow as pa

        if qi.size:
            self.held.append(pa.Table.from_batches([rows]).append_column("__qi", pa.array(qi.astype(np.int64))).append_column("score", pa.array(score)))
            self.rows += qi.size
            if self.rows > self.most:
                self.held = [self.kept()]
                self.rows = self.held[0].num_rows

    def kept(self):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.concat_tables(self.held).combine_chunks()
        key = table[self.key]
        parts = [pc.struct_field(key, [j]) for j in range(key.type.num_fields)] if pa.types.is_struct(key.type) else [key]
        order = pa.table({"q": table["__qi"], "s": table["score"]} | {f"k{j}": c for j, c in enumerate(parts)})
        table = table.take(pc.sort_indices(order, sort_keys=[("q", "ascending"), ("s", "descending"), *((f"k{j}", "ascending") for j in range(len(parts)))]))
        q = table["__qi"].to_numpy()
        first = np.concatenate([[True], q[1:] != q[:-1]])
        place = np.arange(q.size) - np.maximum.accumulate(np.where(first, np.arange(q.size), 0))
        return table.filter(pa.array(place < self.k))

    def out(self, ids: list, qid_type) -> Iterator:
        """Record batches: qid, the columns of the rows, score."""
        import pyarrow as pa

        if self.held:
            table = self.kept()
            qid = pa.array(ids, qid_type).take(table["__qi"].combine_chunks())
            columns = [c for c in table.column_names if c not in ("__qi", "score")]
            done = pa.Table.from_arrays([qid, *[table[c] for c in columns], table["score"]], names=["qid", *columns, "score"])
            yield from done.combine_chunks().to_batches(max_chunksize=1 << 16)


def _block(
    rows: DataFrame, ids: list, matrix: np.ndarray, second: np.ndarray | None, qid_type: DataType, k: int, vector: Column, key: str, metric: str, carry: tuple[str, ...], again: Column | None
) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((ids, matrix, second))
    columns = [key, *carry]
    arrow_qid = to_arrow_type(qid_type)

    def score(batches):
        names, q, second = sent.value
        found = Running(k, len(names), key)
        for b in batches:
            b = b.filter(b.column(0).is_valid()) if b.num_rows else b
            if not b.num_rows:
                continue
            qi, ri, s = best(q, table_of(b.column(0), b.num_rows, q.shape[1]), metric, k, found.tops)
            hits = b.select(columns).take(ri)
            found.add(qi, hits if second is None else with_again(hits, b.column("__again"), second, metric, qi, ri), s)
        yield from found.out(names, arrow_qid)

    return rows.select(vector.cast("array<double>").alias("__x"), *columns, *seconds(again)).mapInArrow(score, f"qid {qid_type.simpleString()}, {kinds_of(rows, columns, again)}, score double")


def seconds(again: Column | None) -> list[Column]:
    return [] if again is None else [again.alias("__again")]


def kinds_of(rows: DataFrame, columns: list[str], again: Column | None) -> str:
    """Names and types of what a search carries."""
    return ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), *([] if again is None else ["again double"])])


def top_k_again(found: DataFrame, k: int, key: str = "vector_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Of each query's candidates the k best by ``again``, which becomes the score."""
    return top_k_scored(found.select("qid", key, *carry, F.col("again").alias("score")), k, ["qid"], key).select("qid", "rank", key, *carry, "score")


def top_k_batch(
    rows: DataFrame, queries: DataFrame, k: int, vector: Column | None = None, key: str = "vector_id", metric: str = "dot_product", most: int = MOST_QUERIES, carry: tuple[str, ...] = (),
    again: Column | None = None,
) -> DataFrame:
    """(qid, rank, key, carried columns, score) for a table of (qid, query), by matrix products; ``again``, a second vector, adds the column of that name before the score."""
    vector = F.col("embedding") if vector is None else vector
    qid_type = queries.schema["qid"].dataType
    found = None
    for ids, matrix, second in query_matrices(queries, most) if k >= 1 else ():
        if ids:
            one = _block(rows, ids, matrix, second, qid_type, k, vector, key, metric, carry, again)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"qid {qid_type.simpleString()}, rank int, {kinds_of(rows, [key, *carry], again)}, score double")
    return _ranked(found, k, ["qid"], key).select("qid", "rank", key, *carry, *([] if again is None else ["again"]), "score")


def checked(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """The query set, after a check of its size, for plans that send it to all executors."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries; take them in blocks")
    return queries


def top_k_native(rows: DataFrame, queries: DataFrame, k: int, key: str = "vector_id", vector: str = "embedding", metric: str = "dot_product", most: int = MOST_QUERIES) -> DataFrame:
    """The same on the JVM: rows meet the broadcast queries, within the checked size, and few pairs are kept to be ranked.

    A share of the rows, one in the root of rows / k, is ranked first. A query's k best of any rows are no better than
    those of all, so pairs below them are left out of the second pass where they are made.
    """
    n = queries.count()
    if n > most:
        raise ValueError(f"more than {most} queries; take them in blocks")
    first = queries.select("query").limit(1).first()
    width = len(first["query"]) if first and first["query"] is not None else 0
    narrow, asked = spread(rows, vector, width, "v", key), spread(queries, "query", width, "q", "qid")
    score = _of_columns(width, metric)

    def scored(some: DataFrame, asked: DataFrame) -> DataFrame:
        return some.join(F.broadcast(asked)).select("qid", key, score.alias("score"), *[c for c in asked.columns if c == "__limit"])

    share = isqrt(max(1, rows.count() // max(1, k)))
    if share > 1:
        some = narrow.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0)
        limits = _ranked(scored(some, asked).where("score is not null"), k, ["qid"], key).where(F.col("rank") == k).select("qid", F.col("score").alias("__limit")).collect()
        table = rows.sparkSession.createDataFrame(limits, T.StructType([queries.schema["qid"], T.StructField("__limit", T.DoubleType())]))
        asked = asked.join(F.broadcast(table), "qid", "left")
        # A comparison that a null score or limit leaves open: null scores go, null limits keep all.
        kept = scored(narrow, asked).where("score is not null and score >= coalesce(__limit, double('-infinity'))")
    else:
        kept = scored(narrow, asked).where("score is not null")
    return _ranked(kept, k, ["qid"], key).select("qid", "rank", key, "score")


def spread(rows: DataFrame, vector: str, width: int, name: str, key: str) -> DataFrame:
    """(key, a column for each component): rows without a vector or with a null in it go, as they have no score; another length is an error.

    Columns of numbers that are never null make a product over them so short that the JVM compiles it; over arrays it does not.
    """
    v = F.col(vector)
    wrong = F.raise_error(F.concat(F.lit("vectors of "), F.size(v).cast("string"), F.lit(f" and {width} components"))).cast("boolean")
    there = v.isNotNull() & F.when(F.size(v) == width, ~F.exists(v, lambda x: x.isNull())).otherwise(wrong)
    return rows.where(there).select(key, *[F.coalesce(v.getItem(j).cast("double"), F.lit(0.0)).alias(f"__{name}{j}") for j in range(width)])


def _of_columns(width: int, metric: str) -> Column:
    """``METRICS`` of the columns that ``spread`` makes as v and q."""
    at = lambda name, j: F.col(f"__{name}{j}")

    def total(f) -> Column:
        out = F.lit(0.0)
        for j in range(width):
            out = out + f(j)
        return out

    dot = lambda a, b: total(lambda j: at(a, j) * at(b, j))
    if metric == "l2":
        return -total(lambda j: (at("v", j) - at("q", j)) * (at("v", j) - at("q", j)))
    return dot("v", "q") if metric == "dot_product" else dot("v", "q") / F.nullif(F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q")), F.lit(0.0))


def top_k_native_blocks(rows: DataFrame, queries: DataFrame, k: int, most: int = MOST_QUERIES, **how) -> DataFrame:
    """``top_k_native`` for query sets of any size, dealt by hash into blocks within ``most``."""
    n = queries.count()
    if n <= most:
        return top_k_native(rows, queries, k, most=most, **how)
    parts = -(-2 * n // most)
    dealt = lambda p: F.pmod(F.xxhash64("qid"), F.lit(p)).cast("int")
    while queries.groupBy(dealt(parts).alias("p")).count().agg(F.max("count")).first()[0] > most:
        parts *= 2
    found = [top_k_native(rows, queries.where(dealt(parts) == p), k, most=most, **how) for p in range(parts)]
    return reduce(DataFrame.unionByName, found)


def first_rows(rows: DataFrame, budget: int, by: list[str], order: list[str]) -> DataFrame:
    """The search budget: the first ``budget`` qualifying rows of each segment in reading order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") <= budget).drop("__n")

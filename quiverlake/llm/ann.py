"""Approximate nearest neighbours by cosine: inverted file, product quantiser, exact reranking.

Fit, on a sample of at most ``sample`` distinct vectors (a fixed bound, chosen
by hash): coarse centroids of the unit vectors, codebooks of the residuals for
each of ``parts`` slices, and the number of cells to probe, which is the
smallest that holds 995 of 1000 true neighbours within the sample. Every vector
is indexed. For a query and a cell, the score of a residual code is a sum of
look-ups in the query's table (asymmetric distances). It is off by at most the
length of what the code leaves of the residual, which is kept with each entry;
so an entry is passed over only if k + 1 others of its block are certainly
better. All the rest, however many, are scored exactly on the original vectors,
in double precision, and so ranked: within the probed cells nothing is lost.

Equal vectors are one entry with its smallest ids, so that a vector with a
third of all rows costs as much as any other. A cell is dealt to blocks of
about ``block`` entries; a task keeps one block and streams the queries that
probe it. The driver holds the sample, the centroids and the count of each cell.

Rows: vectors that are null, zero, or have null or non-finite components take
no part. Vectors of different lengths are no neighbours. Rows with null id take
no part. Ties go to the smaller id. A repeated id with the same vector
counts once. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverlake.llm._common import cut_lineage


#: Coarse cells at most: what a driver and its executors hold of centroids. Cells grow with the root of the vectors up to this and to a tenth of the sample.
MOST_CELLS = 65_536
#: Lengths of query vectors at most.
MOST_DIMS = 16
#: More than the rounding of a product of unit vectors.
ROUNDING = 1e-9


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, total / np.maximum(n, 1), centres)
    return centres


def _distance(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance less what is the same for all centres."""
    return (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = _distance(x[at : at + 4096], centres).argmin(1)
    return out


@dataclass
class IvfPq:
    """A fitted index: centroids (cells, dim), codebooks (parts, codes, dim / parts), cells to probe."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    @classmethod
    def fit(cls, vectors: np.ndarray, total: int, parts: int = 16, codes: int = 256, seed: int = 11, k: int = 5, exact: bool = False) -> IvfPq:
        rng = np.random.default_rng(seed)
        x = cls.unit(vectors.astype(np.float64))
        cells = 1 if total < 512 else max(2, min(int(total**0.5) // 4, len(x) // 10, MOST_CELLS))
        centroids = _kmeans(x, cells, 10, rng)
        own = _nearest(x, centroids)
        dim = x.shape[1]
        parts = max(p for p in range(1, min(parts, dim) + 1) if dim % p == 0)
        rest = (x - centroids[own])[:8192].reshape(-1, parts, dim // parts)
        book = [_kmeans(rest[:, p], codes, 6, rng) for p in range(parts)]
        books = np.stack([np.concatenate([b, np.repeat(b[:1], codes - len(b), axis=0)]) for b in book])
        ask = x[:256]
        score = ask @ x.T
        score[np.arange(len(ask)), np.arange(len(ask))] = -2
        best = np.argsort(-score, axis=1)[:, : min(k, max(1, len(x) - 1))]
        rank = np.argsort(np.argsort(_distance(ask, centroids), axis=1), axis=1)
        found = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
        probes = int(found[max(0, int(np.ceil(0.995 * found.size)) - 1)]) + 1
        return cls(centroids, books, cells if exact else min(cells, probes))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and residual code of each unit vector."""
        own = _nearest(x, self.centroids)
        parts, _, width = self.books.shape
        rest = (x - self.centroids[own]).reshape(len(x), parts, width)
        return own, np.stack([_nearest(np.ascontiguousarray(rest[:, p]), self.books[p]) for p in range(parts)], axis=1).astype(np.uint8)

    def misses(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what centroid and code leave of each unit vector: the most by which an approximate score is off."""
        parts, _, width = self.books.shape
        rest = (x - self.centroids[own]).reshape(len(x), parts, width) - self.books[np.arange(parts), codes]
        return np.sqrt((rest * rest).sum(axis=(1, 2)))

    def cells_of(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(_distance(queries, self.centroids), axis=1)[:, : self.probes]

    def table(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's slices with all codes: (queries, parts, codes)."""
        parts, _, width = self.books.shape
        return np.einsum("qpw,pcw->qpc", queries.reshape(len(queries), parts, width), self.books)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine in double precision; equal rows give equal bits. Where sums of squares leave the range of doubles, vectors are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        squares, own = (vectors * vectors).sum(axis=1), (query * query).sum()
        out = (vectors * query).sum(axis=1) / (np.sqrt(squares) * np.sqrt(own))
    far = (squares > 1e150) | (squares < 1e-150) | (own > 1e150) | (own < 1e-150)
    if far.any():
        scaled = vectors[far] / np.abs(vectors[far]).max(axis=1, keepdims=True)
        asked = query / np.abs(query).max()
        out[far] = (scaled * asked).sum(axis=1) / (np.sqrt((scaled * scaled).sum(axis=1)) * np.sqrt((asked * asked).sum()))
    return out


def survivors(rough: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Where a score that is off by at most ``off`` may be among the k best of its row, ties included."""
    if k >= rough.shape[1]:
        return np.ones(rough.shape, bool)
    least = np.partition(rough - off, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
    return rough + off >= least[:, None] - ROUNDING


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :][: len(column) * dim].reshape(len(column), dim).astype(np.float64)


def nearest(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    sample: int = 20_000, parts: int = 16, block: int = 4096, exact: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each query row. ``exact``: all cells are probed, so that nothing is missed.

    Cells are as many as a tenth of the sample at most, so a larger corpus wants a larger ``sample``.
    Vectors meet only queries of their own length; each length that queries have is an index of its own.
    """
    raw = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    raw = raw.filter(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("dim", F.size("v"))
    schema = f"query_id {df.schema[id_col].dataType.simpleString()}, rank int, vec_id {df.schema[id_col].dataType.simpleString()}, score double"
    dims = [r[0] for r in raw.filter("q").groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_DIMS + 1).collect()]
    if len(dims) > MOST_DIMS:
        raise ValueError(f"queries of more than {MOST_DIMS} lengths")
    out = df.sparkSession.createDataFrame([], schema)
    for k_dim, dim in enumerate(dims):
        one = _nearest_of(raw.filter(F.col("dim") == dim).select("id", "v", "q"), dim, k, sample, parts, block, exact)
        out = one if k_dim == 0 else out.unionByName(one)
    return out


def _nearest_of(rows: DataFrame, dim: int, k: int, sample: int, parts: int, block: int, exact: bool) -> DataFrame:
    """``nearest`` for (id, v, q) rows whose vectors have ``dim`` components."""
    id_type = rows.schema["id"].dataType.simpleString()
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))
    total = classes.count()
    share = min(1.0, sample / total)
    pick = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    some = classes.filter(pick).select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select("v") if total > sample else classes.select("v")
    model = IvfPq.fit(np.array([r[0] for r in some.collect()]), total, parts, k=k, exact=exact)

    def index(batches):
        import pyarrow as pa

        for b in batches:
            x = model.unit(_matrix(b.column("v"), dim))
            own, codes = model.encode(x)
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("ids"), b.column("v"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(model.misses(x, own, codes))], names=["cid", "ids", "v", "cell", "code", "off"])

    def probe(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                cells = model.cells_of(model.unit(_matrix(b.column("v"), dim)))
                take = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("cid").take(take), b.column("v").take(take), pa.array(cells.ravel().astype(np.int32))], names=["cid", "v", "cell"])

    entries = cut_lineage(classes.select("cid", "ids", "v").mapInArrow(index, f"cid long, ids array<{id_type}>, v array<double>, cell int, code binary, off double"))
    blocks = {r[0]: -(-r[1] // block) for r in entries.groupBy("cell").count().collect()}
    many = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("cell"))
    asked = rows.filter("q").select(F.col("id").alias("query_id"), "v").distinct()
    query_classes = asked.join(classes.select("v", "cid"), "v").select("query_id", "cid")
    query_classes = cut_lineage(query_classes)
    queries = classes.join(query_classes.select("cid").distinct(), "cid", "left_semi").select("cid", "v").mapInArrow(probe, "cid long, v array<double>, cell int")
    queries = queries.withColumn("blocks", many).filter("blocks is not null").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = entries.select("cell", F.pmod(F.xxhash64("cid"), many).cast("int").alias("block"), F.lit(0).alias("kind"), "cid", "v", "ids", "code", "off")
    right = queries.select("cell", "block", F.lit(1).alias("kind"), "cid", "v", F.lit(None).cast(f"array<{id_type}>").alias("ids"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("off"))
    met = left.unionByName(right).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")

    def search(batches):
        import pyarrow as pa

        at, held, ready = None, [], None

        def answer(b):
            """The best of the held block for each query of a batch."""
            vectors, near, codes, off, ids, least = ready
            asks = _matrix(b.column("v"), dim)
            unit = model.unit(asks)
            cell = at[0]
            table = model.table(unit)
            out = ([], [], [])
            base = unit @ model.centroids[cell]
            for a in range(0, len(asks), 64):
                rough = np.repeat(base[a : a + 64, None], len(vectors), axis=1)
                for p in range(codes.shape[1]):
                    rough += table[a : a + 64, p][:, codes[:, p]]
                may = survivors(rough, off, k + 1)
                some = np.flatnonzero(may.any(axis=0))
                close = np.where(may[:, some], unit[a : a + 64] @ near[some].T, -2.0)
                for q, row in enumerate(survivors(close, 0.0, k + 1)):
                    best = some[row]
                    score = cosines(asks[a + q], vectors[best])
                    order = np.lexsort((least[best], -score))[: k + 1]
                    out[0].extend([b.column("cid")[a + q].as_py()] * len(order))
                    out[1].extend(ids[j] for j in best[order].tolist())
                    out[2].extend(score[order].tolist())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(id_arrow)), pa.array(out[2], pa.float64())], names=["cid", "ids", "score"])

        for b in batches:
            id_arrow = b.schema.field("ids").type.value_type
            cells, part, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "kind"))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if lo == hi:
                    continue
                if (here := (int(cells[lo]), int(part[lo]))) != at:
                    at, held, ready = here, [], None
                piece = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append(piece)
                    continue
                if ready is None and held:
                    ids = [x for h in held for x in h.column("ids").to_pylist()]
                    codes = np.concatenate([np.frombuffer(b"".join(h.column("code").to_pylist()), np.uint8).reshape(h.num_rows, -1) for h in held])
                    off = np.concatenate([h.column("off").to_numpy() for h in held])
                    vectors = np.concatenate([_matrix(h.column("v"), dim) for h in held])
                    ready = vectors, model.unit(vectors), codes, off, ids, np.array([x[0] for x in ids])
                if ready is not None:
                    yield answer(piece)

    found = met.mapInArrow(search, f"cid long, ids array<{id_type}>, score double").select("cid", "score", F.explode("ids").alias("vec_id"))
    by_class = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("n", F.row_number().over(by_class)).filter(F.col("n") <= k + 1).drop("n")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = query_classes.join(top, "cid").filter(F.col("query_id") != F.col("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

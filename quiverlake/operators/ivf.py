"""Clusters of a segment: building, assigning, probing."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quiverlake.functions import vectors as V
from quiverlake.operators.topk import MOST_QUERIES, Running, best, kinds_of, query_matrices, seconds, with_again

ROUNDS = 20
NO_CLUSTER = -1
#: Centroids that a search sends to the executors at most.
MOST_CENTROIDS = 1 << 16
SEED = 42


def cluster_count(rows: int, manual: int | None = None, auto_threshold: int | None = None) -> int | None:
    """Clusters to build for so many live rows: given, or the root within 8 and 4096 from the threshold on, or none."""
    if manual is not None:
        return manual
    if auto_threshold is None or rows < auto_threshold:
        return None
    return min(4096, max(8, isqrt(rows)))


def probe_width(probe_k: int | None, default: int, buckets: int) -> int:
    return min(probe_k or default, buckets)


def lloyd(x: np.ndarray, n_clusters: int, seed: int = SEED, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, assignment) by k-means: seeded choice of rows, first index at ties, empty clusters stay."""
    k = min(n_clusters, len(x))
    centroids = x[np.random.default_rng(seed).choice(len(x), size=k, replace=False)].astype(np.float32)
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        for at in range(0, len(x), 2048):  # bounded blocks, not one (rows, clusters, dim) tensor
            part = x[at : at + 2048, None, :] - centroids[None, :, :] if k * x.shape[1] <= 1 << 14 else None
            if part is not None:
                own[at : at + 2048] = (part * part).sum(-1).argmin(1)
            else:
                p = x[at : at + 2048]
                own[at : at + 2048] = ((centroids * centroids).sum(1) - 2 * (p @ centroids.T)).argmin(1)
        moved = centroids.copy()
        for c in np.unique(own):
            moved[c] = x[own == c].mean(axis=0)
        if np.allclose(moved, centroids):
            centroids = moved
            break
        centroids = moved
    return centroids, own


def build_per_segment(rows: DataFrame, n_clusters: int, vector: str = "embedding") -> DataFrame:
    """(segment_id, cluster_id, centroid) for each segment, by seeded k-means in one task a segment.

    For sets beyond what a task should hold take ``build_distributed``.
    """
    segment_type = rows.schema["segment_id"].dataType.simpleString()

    def build(table):
        import pyarrow as pa

        x = np.stack(table.column(vector).to_numpy(zero_copy_only=False)).astype(np.float32)
        order = np.argsort(np.array(table.column("docno")), kind="stable")
        centroids, _ = lloyd(x[order], n_clusters)
        segment = table.column("segment_id")[0].as_py()
        return pa.table({"segment_id": [segment] * len(centroids), "cluster_id": pa.array(range(len(centroids)), pa.int32()), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float32()))})

    return rows.select("segment_id", "docno", F.col(vector).cast("array<float>").alias(vector)).groupBy("segment_id").applyInArrow(build, f"segment_id {segment_type}, cluster_id int, centroid array<float>")


def build_distributed(rows: DataFrame, n_clusters: int, vector: str = "embedding", seed: int = SEED) -> DataFrame:
    """(cluster_id, centroid) over rows of any number, by the distributed k-means of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = rows.select(array_to_vector(V.doubles(F.col(vector))).alias("features"))
    model = KMeans(k=n_clusters, seed=seed, maxIter=ROUNDS).fit(points)
    centres = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(centres, "cluster_id int, centroid array<float>")


def by_label(rows: DataFrame, label: str, dim: int, vector: str = "embedding") -> DataFrame:
    """(cluster_id, centroid): the mean of each label, for clusters that are given."""
    return rows.groupBy(F.col(label).alias("cluster_id")).agg(V.mean_vector(F.col(vector), dim).alias("centroid"))


def nearest_column(vector: Column, centroids: list[tuple[int, list[float]]]) -> Column:
    """The id of the nearest of a bounded list of centroids, the first at ties."""
    table = F.array(*[F.struct(F.lit(int(c)).alias("c"), V.literal(v).alias("v")) for c, v in centroids])
    distances = F.transform(table, lambda t: F.struct(V.squared_l2(vector, t["v"]).alias("d"), t["c"].alias("c")))
    return F.coalesce(F.array_min(distances)["c"], F.lit(NO_CLUSTER))  # never null, so a join on it is not guarded by working it out once more


def assign(rows: DataFrame, centroids: DataFrame, vector: str = "embedding", most: int = 4096) -> DataFrame:
    """Adds cluster_id: the nearest centroid, ``NO_CLUSTER`` for null vectors. The centroid table is at most ``most`` rows, which is checked."""
    got = centroids.select("cluster_id", "centroid").orderBy("cluster_id").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} centroids")
    if len(got) <= 64:
        return rows.withColumn("cluster_id", nearest_column(F.col(vector), [(r[0], r[1]) for r in got]))
    ids, table = np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)
    sent = rows.sparkSession.sparkContext.broadcast((ids, table))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        names, c = sent.value
        out = np.full(len(v), NO_CLUSTER)
        there = v.notna().to_numpy()
        if there.any():
            x = np.stack(v[there].to_numpy()).astype(np.float64)
            out[there] = names[((c * c).sum(1) - 2 * x @ c.T).argmin(1)]
        return pd.Series(out)

    return rows.withColumn("cluster_id", nearest(F.col(vector)))


def probes(queries: DataFrame, centroids: DataFrame, probe_k: int, by: list[str] | None = None) -> DataFrame:
    """(qid, by, cluster_id, probe): the probe_k nearest clusters of each query and segment by L2, ties to the smaller id.

    The centroid table, a few thousand rows a segment at most, meets the query set only.
    """
    by = by or []
    met = queries.select("qid", "query").join(centroids.select(*by, "cluster_id", "centroid"))
    scored = met.withColumn("d", V.squared_l2(F.col("query"), F.col("centroid")))
    rank = F.row_number().over(Window.partitionBy("qid", *by).orderBy("d", "cluster_id"))
    return scored.withColumn("probe", rank).where(F.col("probe") <= probe_k).select("qid", *by, "cluster_id", "probe", "d")


def probe_lists(names: list[tuple], centroids: np.ndarray, queries: np.ndarray, probe_k: int) -> dict[tuple, np.ndarray]:
    """The queries (their places) that probe each cluster. ``names``: (segment key, cluster id) of each centroid; ties to the smaller id."""
    out: dict[tuple, np.ndarray] = {}
    segments: dict = {}
    for at, (segment, _) in enumerate(names):
        segments.setdefault(segment, []).append(at)
    for segment, at in segments.items():
        at = sorted(at, key=lambda a: names[a][1])
        c = centroids[at]
        d = np.concatenate([((c[None] - queries[a : a + 64, None]) ** 2).sum(-1) for a in range(0, len(queries), 64)])
        near = np.argsort(d, axis=1, kind="stable")[:, :probe_k]
        for j, a in enumerate(at):
            out[segment, names[a][1]] = np.flatnonzero((near == j).any(axis=1))
    return out


def top_k_probed(
    rows: DataFrame, queries: DataFrame, names: list[tuple[str, int]], centroids: np.ndarray, probe_k: int, k: int, by: list[str], vector: Column, key: str = "vector_id", metric: str = "dot_product",
    most: int = MOST_QUERIES, carry: tuple[str, ...] = (), again: Column | None = None,
) -> DataFrame | None:
    """(qid, key, carried columns, ``again`` if given, score): a task's k best rows a query, of the clusters that the query probes; rows of segments without clusters meet every query.

    ``names``: (``by`` joined by a slash, cluster id) of each row of ``centroids``,
    at most ``MOST_CENTROIDS``. In each Arrow batch a cluster is one matrix
    product with the queries that probe it; clusters that none probes are not read.
    """
    if len(names) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    columns, found = [key, *carry], None
    qid_type = queries.schema["qid"].dataType
    arrow_qid = to_arrow_type(qid_type)
    for ids, matrix, second in query_matrices(queries, most):
        if not ids:
            continue
        asked = probe_lists(names, centroids, matrix, probe_k)
        wanted = sorted({c for (_, c), q in asked.items() if q.size})
        sent = rows.sparkSession.sparkContext.broadcast((ids, matrix, second, asked, {s for s, _ in names}))

        def score(batches, sent=sent):
            ids, q, second, asked, held = sent.value
            every, out = np.arange(len(ids)), Running(k, len(ids), key)
            for b in batches:
                b = b.filter(b.column(0).is_valid()) if b.num_rows else b
                if not b.num_rows:
                    continue
                segment, cluster = b.column(1).dictionary_encode(), b.column(2).fill_null(NO_CLUSTER).to_numpy(zero_copy_only=False)
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                code = segment.indices.to_numpy().astype(np.int64) * (1 << 32) + cluster
                order = np.argsort(code, kind="stable")
                hits = []
                for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                    name = segment.dictionary[int(segment.indices[int(part[0])].as_py())].as_py()
                    who = asked.get((name, int(cluster[part[0]])), every[:0]) if name in held else every
                    if who.size:
                        tops = out.tops[who]
                        qi, ri, s = best(q[who], x[part], metric, k, tops)
                        out.tops[who] = tops
                        hits.append((who[qi], part[ri], s))
                if hits:
                    qi, ri, s = (np.concatenate(z) for z in zip(*hits, strict=True))
                    taken = b.select(columns).take(ri)
                    out.add(qi, taken if second is None else with_again(taken, b.column("__again"), second, metric, qi, ri), s)
            yield from out.out(ids, arrow_qid)

        reach = rows.where(F.col("cluster_id").isNull() | F.col("cluster_id").isin(wanted)) if names else rows
        one = reach.select(vector.cast("array<double>").alias("__x"), F.coalesce(F.concat_ws("/", *by), F.lit("")).alias("__segment"), F.col("cluster_id").cast("int").alias("__cluster"), *columns, *seconds(again))
        one = one.mapInArrow(score, f"qid {qid_type.simpleString()}, {kinds_of(rows, columns, again)}, score double")
        found = one if found is None else found.unionByName(one)
    return found


def probed_rows(rows: DataFrame, probe_table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of the probed clusters, once for each query; with files partitioned by cluster_id, other clusters are not read."""
    return rows.join(F.broadcast(probe_table.select("qid", *(by or []), "cluster_id")), [*(by or []), "cluster_id"])

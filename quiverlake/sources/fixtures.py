"""Vector datasets for tests and benchmarks: a JSON reader and generators by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, queries) of a file {name, items: [{vector_id, embedding, metadata}], queries: [[...]]}."""
    whole = spark.read.json(path, multiLine=True)
    items = whole.select(F.explode("items").alias("i")).select("i.vector_id", F.col("i.embedding").cast("array<float>").alias("embedding"), *(["i.metadata"] if "metadata" in whole.schema["items"].dataType.elementType.names else [F.lit(None).cast("struct<>").alias("metadata")]))
    queries = whole.select(F.posexplode("queries").alias("qid", "query")).select("qid", F.col("query").cast("array<double>").alias("query"))
    return items, queries


def _grid(spark: SparkSession, n: int, components: list[Column], metadata: dict[str, Column]) -> DataFrame:
    rows = spark.range(n)
    return rows.select(
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("vector_id"),
        F.array(*components).cast("array<float>").alias("embedding"),
        F.struct(*[c.alias(k) for k, c in metadata.items()]).alias("metadata"),
    )


# The two smallest datasets, as (items, queries).
TINY = (
    [("a", [1.0, 0.0], ("us", "gold")), ("b", [0.0, 1.0], ("ca", "silver")), ("c", [0.8, 0.2], ("us", "platinum")), ("d", [0.2, 0.8], ("ca", "gold"))],
    [[0.9, 0.1], [0.1, 0.9], [0.75, 0.25]],
)
FILTER = (
    [("p1", [1.0, 0.0], ("payments", 3)), ("p2", [0.9, 0.1], ("payments", 1)), ("r1", [0.0, 1.0], ("risk", 3)), ("r2", [0.1, 0.9], ("risk", 1))],
    [[0.95, 0.05], [0.05, 0.95]],
)


def _given(spark: SparkSession, data: tuple, metadata: str) -> tuple[DataFrame, DataFrame]:
    items, queries = data
    return spark.createDataFrame(items, f"vector_id string, embedding array<float>, metadata struct<{metadata}>"), spark.createDataFrame(list(enumerate(queries)), "qid int, query array<double>")


def tiny(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return _given(spark, TINY, "region:string, tier:string")


def filtered(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return _given(spark, FILTER, "product:string, priority:int")


def xlarge(spark: SparkSession, n: int = 512) -> DataFrame:
    """The lattice with 32 points a side and three families."""
    i = F.col("id")
    family = F.element_at(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma")]), F.pmod(i, F.lit(3)).cast("int") + 1)
    rows = _grid(spark, n, [F.pmod(i, F.lit(32)) / 31, F.pmod(11 * i, F.lit(32)) / 31], {"bucket": F.pmod(i, F.lit(8)).cast("int"), "family": family})
    return rows.withColumn("vector_id", F.concat(F.lit("doc-"), F.substring("vector_id", 2, 20)))


def scale(spark: SparkSession, n: int, dim: int = 128, clusters: int = 20, seed: int = 42) -> DataFrame:
    """``gaussian`` at any size, made on the executors, in batches of a thousand."""
    return gaussian(spark, n, dim, clusters, seed=seed).withColumn("metadata", F.struct("metadata.cluster", F.floor(F.substring("vector_id", 2, 20).cast("long") / 1000).cast("int").alias("batch")))


def lattice(spark: SparkSession, n: int = 256, side: int = 16, stride: int = 7, buckets: int = 4) -> DataFrame:
    """Points (i mod side, stride * i mod side) over side - 1: few distinct vectors, many ties."""
    i = F.col("id")
    return _grid(spark, n, [F.pmod(i, F.lit(side)) / (side - 1), F.pmod(stride * i, F.lit(side)) / (side - 1)], {"bucket": F.pmod(i, F.lit(buckets)).cast("int"), "family": F.when(F.pmod(i, F.lit(2)) == 0, "even").otherwise("odd")})


def highdim(spark: SparkSession, n: int = 256, dim: int = 8, modulus: int = 17) -> DataFrame:
    """Component j of row i: (i * (j + 3) mod modulus) over modulus - 1."""
    i = F.col("id")
    return _grid(spark, n, [F.pmod(i * (j + 3), F.lit(modulus)) / (modulus - 1) for j in range(dim)], {"bucket": F.pmod(i, F.lit(4)).cast("int"), "dim": F.lit(dim)})


def clustered(spark: SparkSession, per_cluster: int = 32, centres: tuple[tuple[float, float], ...] = ((0.9, 0.1), (0.1, 0.9), (0.5, 0.5))) -> DataFrame:
    """Points on a small grid around each centre, within 0 and 1."""
    i = F.col("id")
    c = F.pmod(i, F.lit(len(centres))).cast("int")
    k = F.floor(i / len(centres))
    pick = lambda axis: F.element_at(F.array(*[F.lit(x[axis]) for x in centres]), c + 1)
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return _grid(
        spark, per_cluster * len(centres),
        [inside(pick(0) + (F.pmod(k, F.lit(3)) - 1) * 0.005), inside(pick(1) + (F.pmod(F.floor(k / 3), F.lit(3)) - 1) * 0.015)],
        {"family": F.concat(F.lit("family-"), c.cast("string")), "cluster": c.cast("string")},
    )


def gaussian(spark: SparkSession, n: int = 5000, dim: int = 128, clusters: int = 10, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Unit vectors around seeded unit centres, generated on the executors; row i is in cluster i mod clusters."""
    import numpy as np

    centres = np.random.default_rng(seed).standard_normal((clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def make(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_numpy()
            x = np.stack([centres[i % clusters] + noise * np.random.default_rng([seed, int(i)]).standard_normal(dim) for i in ids])
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            meta = pa.StructArray.from_arrays([pa.array((ids % clusters).astype(np.int32)), pa.array((ids // 100).astype(np.int32))], names=["cluster", "batch"])
            yield pa.RecordBatch.from_arrays([pa.array([f"v{i}" for i in ids]), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32())), meta], names=["vector_id", "embedding", "metadata"])

    return spark.range(n).mapInArrow(make, "vector_id string, embedding array<float>, metadata struct<cluster:int, batch:int>")


def scenario(spark: SparkSession, n: int, dim: int, shards: int = 1, delete_ratio: float = 0.0, clusters: int = 8, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows with shard_id and an ordinal, ids to delete): every round(1 / ratio)-th id goes."""
    rows = gaussian(spark, n, dim, clusters, seed=seed).withColumn("ordinal", F.substring("vector_id", 2, 20).cast("long"))
    rows = rows.withColumn("shard_id", F.concat(F.lit("shard-"), F.pmod("ordinal", F.lit(shards)).cast("string")))
    every = round(1 / delete_ratio) if delete_ratio > 0 else 0
    gone = rows.where(F.pmod("ordinal", F.lit(every)) == 0) if every else rows.limit(0)
    return rows, gone.select("shard_id", "vector_id")

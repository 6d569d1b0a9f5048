"""Names, states and row types that all modules share."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SHARD = "shard-0"

# States and operations.
OPERATIONS = ("upsert", "delete")
SEGMENT_STATES = ("building", "sealed", "active", "compacting", "retired")
SHARD_STATES = ("active", "draining", "rebalancing", "offline")
COLLECTION_STATES = ("creating", "ready", "draining", "deleting")
METRICS = ("dot_product", "cosine", "l2")
DURABILITY = ("memory", "log_sync")

VECTOR = T.ArrayType(T.FloatType())
CODES = T.ArrayType(T.ByteType())
ENCODED = T.StructType([T.StructField("codes", CODES), T.StructField("scale", T.DoubleType())])


def log_schema(metadata: T.DataType, id_type: T.DataType | None = None) -> T.StructType:
    """A write log: one row a write, in the order of epochs."""
    return T.StructType(
        [
            T.StructField("operation", T.StringType()),
            T.StructField("collection_id", T.StringType()),
            T.StructField("shard_id", T.StringType()),
            T.StructField("vector_id", id_type or T.StringType()),
            T.StructField("write_epoch", T.LongType()),
            T.StructField("embedding", VECTOR),
            T.StructField("metadata", metadata),
            T.StructField("ts", T.TimestampType()),
        ]
    )


MANIFEST = T.StructType(
    [
        T.StructField("segment_id", T.StringType()),
        T.StructField("collection_id", T.StringType()),
        T.StructField("shard_id", T.StringType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("live_row_count", T.LongType()),
        T.StructField("deleted_row_count", T.LongType()),
        T.StructField("quantizer", T.StringType()),
        T.StructField("min_write_epoch", T.LongType()),
        T.StructField("max_write_epoch", T.LongType()),
        T.StructField("sealed_at", T.StringType()),
        T.StructField("activated_at", T.StringType()),
        T.StructField("n_clusters", T.IntegerType()),
        T.StructField("content_sha256", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Collection:
    """What a namespace of vectors holds. ``filter_schema`` gives the typed metadata keys."""

    collection_id: str
    dim: int
    filter_schema: dict[str, str] = field(default_factory=dict)
    metric: str = "dot_product"
    quantizer: str = "scalar"
    state: str = "ready"

    def __post_init__(self):
        object.__setattr__(self, "collection_id", self.collection_id.strip())
        if not self.collection_id:
            raise ValueError("collection_id is empty")
        if self.dim <= 0:
            raise ValueError("dim must be positive")
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")

    def metadata_type(self) -> T.StructType:
        kinds = {"keyword": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "timestamp": T.TimestampType()}
        return T.StructType([T.StructField(k, kinds[v]) for k, v in sorted(self.filter_schema.items())])


def checked_dim(embedding: Column, dim: int) -> Column:
    """The vector, or an error at run time if it has another length. Null stays null (a tombstone)."""
    bad = F.raise_error(F.concat(F.lit(f"embedding must have {dim} components, not "), F.size(embedding).cast("string"))).cast(VECTOR)
    return F.when(embedding.isNull() | (F.size(embedding) == dim), embedding).otherwise(bad)


def total_order(score: str = "score", key: str = "vector_id") -> list[Column]:
    """Best score first, ties to the smaller id."""
    return [F.col(score).desc(), F.col(key).asc()]


def as_rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]

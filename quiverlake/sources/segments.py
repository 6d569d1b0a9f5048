"""Sealed segments as Parquet, and the versions of a shard's manifest.

A segment is a folder: ``rows`` (partitioned by cluster_id if clustered) and,
if clustered, ``centroids``. A shard's state is a series of numbered JSON files;
the highest number is the current one, and a new one is published by creating
the next number, which one writer alone can do. Data folders are never
overwritten; a folder that no version names was never published.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.functions.quantizers import Quantizer
from quiverlake.operators import ivf
from quiverlake.schema import MANIFEST
from quiverlake.sources.cache import SegmentCache
from quiverlake.sources.log import numbered
from quiverlake.sources.storage import Storage

#: Rows that k-means takes in one task; beyond, it is distributed.
ONE_TASK = 200_000
#: What ``write`` writes. Segments of an earlier or later format are an error, not misread.
FORMAT_VERSION = 2

STORED_MANIFEST = T.StructType([*MANIFEST.fields, T.StructField("stored_shard", T.StringType())])


@dataclass
class ShardState:
    """One version of a shard: active ids in order, all segment manifests, and the epoch from which the log counts."""

    version: int = 0
    active: list[str] = field(default_factory=list)
    segments: dict[str, dict[str, Any]] = field(default_factory=dict)
    replay_from: int = 0


class SegmentStore:
    def __init__(self, storage: Storage, folder: str, cached_segments: int = 0):
        self.storage, self.folder, self.spark = storage, folder, storage.spark
        self.cache = SegmentCache(cached_segments)
        self._centroids: dict[tuple[str, str], np.ndarray] = {}

    # ---- versions ------------------------------------------------------------

    def shards(self) -> list[str]:
        return [n.removeprefix("shard=") for n in self.storage.names(self.folder) if n.startswith("shard=")]

    def _versions(self, shard_id: str) -> str:
        return f"{self.folder}/shard={shard_id}/versions"

    def load(self, shard_id: str) -> ShardState:
        names = [n for n in self.storage.names(self._versions(shard_id)) if n.endswith(".json") and not n.startswith(".")]
        for name in reversed(names):  # one that is just being written is not yet a version
            if (value := self.storage.read_json(f"{self._versions(shard_id)}/{name}")) is not None:
                return ShardState(**value)
        return ShardState()

    def publish(self, shard_id: str, state: ShardState) -> ShardState:
        """Makes ``state`` the version after the one it was loaded as."""
        new = ShardState(state.version + 1, list(state.active), dict(state.segments), state.replay_from)
        if not self.storage.create_json(f"{self._versions(shard_id)}/{new.version:012d}.json", new.__dict__):
            raise RuntimeError(f"shard {shard_id} changed meanwhile; load it again")
        return new

    def manifests(self, shard_ids: list[str] | None = None) -> DataFrame:
        """All segment manifests, with the shard they are stored under."""
        rows = []
        for shard in shard_ids or self.shards():
            for m in self.load(shard).segments.values():
                rows.append((*[m.get(f.name) for f in MANIFEST], shard))
        return self.spark.createDataFrame(rows, STORED_MANIFEST)

    def active(self, shard_ids: list[str] | None = None) -> DataFrame:
        rows = [(s, i, k) for s in shard_ids or self.shards() for k, i in enumerate(self.load(s).active)]
        return self.spark.createDataFrame(rows, "shard_id string, segment_id string, segment_pos int")

    # ---- data ------------------------------------------------------------------

    def path(self, shard_id: str, segment_id: str) -> str:
        return f"{self.folder}/shard={shard_id}/segments/{segment_id}"

    def write(self, shard_id: str, segment_id: str, rows: DataFrame, q: Quantizer, generation: int, collection_id: str, n_clusters: int | None, now: str) -> dict[str, Any]:
        """Writes (vector_id, embedding, metadata, write_epoch, is_deleted) rows and returns the manifest.

        Raw vectors stay beside the codes. Rows lie in the order of ids, and
        tombstones at the end, in cluster -1.
        """
        path = self.path(shard_id, segment_id)
        if self.storage.exists(path):
            raise ValueError(f"segment {segment_id} exists")
        ordered, _, held = numbered(rows, ["is_deleted", "vector_id"], -1, "docno")
        encoded = F.when(F.col("embedding").isNotNull(), q.encode(F.col("embedding")))
        coded = ordered.withColumn("docno", F.col("docno").cast("int")).withColumn("__e", encoded).withColumn("codes", F.col("__e.codes")).withColumn("scale", F.col("__e.scale")).drop("__e").persist()
        try:
            if n_clusters:
                alive = coded.where("not is_deleted").withColumn("decoded", q.decode(F.struct("codes", "scale"))).withColumn("segment_id", F.lit(segment_id))
                if alive.count() <= ONE_TASK:
                    centroids = ivf.build_per_segment(alive, n_clusters, "decoded")
                else:
                    centroids = ivf.build_distributed(alive, n_clusters, "decoded").withColumn("segment_id", F.lit(segment_id))
                centroids.write.parquet(f"{path}/centroids")
                centroids = self.spark.read.parquet(f"{path}/centroids")
                dealt = ivf.assign(alive, centroids, "decoded").drop("decoded", "segment_id").unionByName(coded.where("is_deleted").withColumn("cluster_id", F.lit(-1)))
                dealt.repartition("cluster_id").sortWithinPartitions("cluster_id", "docno").write.partitionBy("cluster_id").parquet(f"{path}/rows")
            else:
                coded.sortWithinPartitions("docno").write.parquet(f"{path}/rows")
            n = coded.agg(F.count("*"), F.count_if(F.col("is_deleted")), F.min("write_epoch"), F.max("write_epoch")).first()
        finally:
            coded.unpersist()
            held.unpersist()
        return {
            "segment_id": segment_id, "collection_id": collection_id, "shard_id": shard_id, "generation": generation, "state": "active",
            "row_count": n[0], "live_row_count": n[0] - n[1], "deleted_row_count": n[1], "quantizer": q.name, "min_write_epoch": n[2], "max_write_epoch": n[3],
            "sealed_at": now, "activated_at": now, "n_clusters": n_clusters or 0, "content_sha256": self.checksum(shard_id, segment_id), "format_version": FORMAT_VERSION,
        }

    def read(self, state: ShardState, shard_id: str, metadata_type, id_type) -> DataFrame | None:
        """Rows of the active segments with segment_id, segment_pos, cluster_id; None without any.

        Clustered segments keep cluster_id as a partition column of the scan.
        """
        out = None
        for pos, segment_id in enumerate(state.active):
            if (got := state.segments[segment_id].get("format_version", FORMAT_VERSION)) != FORMAT_VERSION:
                raise ValueError(f"segment {segment_id} has format {got}, not {FORMAT_VERSION}")
            path = f"{self.path(shard_id, segment_id)}/rows"
            one = self.cache.get(path, lambda path=path: self.spark.read.parquet(path))
            if "cluster_id" not in one.columns:
                one = one.withColumn("cluster_id", F.lit(None).cast("int"))
            one = one.select(
                F.lit(shard_id).alias("shard_id"), F.lit(segment_id).alias("segment_id"), F.lit(pos).alias("segment_pos"), "cluster_id", "docno", F.col("vector_id").cast(id_type).alias("vector_id"),
                "embedding", F.col("metadata").cast(metadata_type).alias("metadata"), "write_epoch", "is_deleted", "codes", "scale",
            )
            out = one if out is None else out.unionByName(one)
        return out

    def centroids(self, state: ShardState, shard_id: str) -> DataFrame | None:
        """(segment_id, cluster_id, centroid) of the active clustered segments."""
        paths = [f"{self.path(shard_id, s)}/centroids" for s in state.active if state.segments[s].get("n_clusters")]
        return self.spark.read.parquet(*paths) if paths else None

    def centroid_tables(self, state: ShardState, shard_id: str) -> dict[str, np.ndarray]:
        """The centroids of the active clustered segments, by cluster id. A segment never changes, so what was read is kept."""
        for segment_id in state.active:
            at = (shard_id, segment_id)
            if state.segments[segment_id].get("n_clusters") and at not in self._centroids:
                got = self.spark.read.parquet(f"{self.path(shard_id, segment_id)}/centroids").select("cluster_id", "centroid").orderBy("cluster_id").limit(ivf.MOST_CENTROIDS + 1).collect()
                self._centroids[at] = np.array([r["centroid"] for r in got], np.float64)
        here = {s for s in state.active if (shard_id, s) in self._centroids}
        for at in [a for a in self._centroids if a[0] == shard_id and a[1] not in here]:
            del self._centroids[at]
        return {s: self._centroids[shard_id, s] for s in state.active if s in here}

    def checksum(self, shard_id: str, segment_id: str) -> str:
        """SHA-256 over the number of rows and two order-free sums of row hashes: one streaming pass on the executors, whatever the size of a file."""
        out = []
        for part in ("rows", "centroids"):
            path = f"{self.path(shard_id, segment_id)}/{part}"
            if self.storage.exists(path):
                rows = self.spark.read.parquet(path)
                one = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*rows.columns)), F.bit_xor(F.xxhash64(F.lit(1), *rows.columns)), F.sum(F.hash(*rows.columns).cast("long"))).first()
                out.append(":".join(map(str, one)))
        return hashlib.sha256(",".join(out).encode()).hexdigest()

    def verify(self, shard_id: str) -> list[dict[str, str]]:
        """Active segments whose files are missing or differ from their manifest; segments without a checksum are passed over."""
        state, bad = self.load(shard_id), []
        for segment_id in state.active:
            want = state.segments.get(segment_id, {}).get("content_sha256")
            if want is None:
                continue
            if not self.storage.exists(f"{self.path(shard_id, segment_id)}/rows"):
                bad.append({"segment_id": segment_id, "issue": "missing"})
            elif self._readable_checksum(shard_id, segment_id) != want:
                bad.append({"segment_id": segment_id, "issue": "checksum"})
        return bad

    def _readable_checksum(self, shard_id: str, segment_id: str) -> str | None:
        try:
            return self.checksum(shard_id, segment_id)
        except Exception as e:  # a file that Parquet refuses; anything else goes on
            if "parquet" not in str(e).lower():
                raise
            return None

    def footprint(self, shard_id: str) -> list[dict[str, Any]]:
        """Files and bytes of each active segment, as a full read would open them, and the vectors it would decode."""
        state = self.load(shard_id)
        sizes = ((s, *self.storage.count(self.path(shard_id, s))) for s in state.active)
        return [{"segment_id": s, "files": files, "bytes": size, "vectors": state.segments[s]["live_row_count"]} for s, files, size in sizes]

    def remove(self, shard_id: str, segment_id: str) -> bool:
        self.cache.invalidate(self.path(shard_id, segment_id) + "/")
        return self.storage.remove(self.path(shard_id, segment_id))


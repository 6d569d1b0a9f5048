"""A bounded cache of segments: the least recently used one is unpersisted."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class SegmentCache:
    """Persisted DataFrames by key; ``capacity`` 0 turns it off. Blocks live on the executors and spill to their disks."""

    def __init__(self, capacity: int = 8):
        self.capacity = capacity
        self._held: OrderedDict[str, DataFrame] = OrderedDict()
        self.hits = self.misses = self.evictions = self.invalidations = 0

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key]
        self.misses += 1
        df = make()
        if self.capacity < 1:
            return df
        self._held[key] = df.persist(StorageLevel.MEMORY_AND_DISK)
        while len(self._held) > self.capacity:
            self._held.popitem(last=False)[1].unpersist()
            self.evictions += 1
        return self._held[key]

    def invalidate(self, prefix: str) -> int:
        """Drops the entries whose key begins so."""
        gone = [k for k in self._held if k.startswith(prefix)]
        for k in gone:
            self._held.pop(k).unpersist()
        self.invalidations += len(gone)
        return len(gone)

    def clear(self) -> None:
        self.invalidate("")

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"entries": len(self._held), "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "invalidations": self.invalidations, "hit_rate": self.hits / asked if asked else 0.0}

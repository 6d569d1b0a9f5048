"""Small files and folders through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import json
import tempfile
from typing import Any

from pyspark.sql import SparkSession


class Storage:
    """File operations below a root, for the driver only: manifests, listings, removal of folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Sorted names in a folder; none if it is not there."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def count(self, path: str) -> tuple[int, int]:
        """Files and bytes below a folder."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return 0, 0
        got = fs.getContentSummary(p)
        return got.getFileCount(), got.getLength()

    def remove(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        """Renames a folder to a name that is not there yet."""
        fs, a = self._at(source)
        _, b = self._at(target)
        fs.mkdirs(b.getParent())
        if fs.exists(b) or not fs.rename(a, b):
            raise RuntimeError(f"cannot move {source} to {target}")

    def partition_name(self, column: str, value: str) -> str:
        """The folder that ``partitionBy`` gives a value."""
        return self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)

    def read_json(self, path: str) -> Any:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def create_json(self, path: str, value: Any) -> bool:
        """Creates a file that must not exist yet. False if another writer was first.

        The file system's exclusive create is the arbiter, with no check before
        it. Readers take a file that is not whole yet for one that is not there.
        """
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        try:
            stream = fs.create(p, False)
        except Exception as e:  # py4j wraps what Java throws
            if fs.exists(p):
                return False
            raise e
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        return True


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors both see: ``spark.checkpoint.dir``, or on one machine only a temporary one."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set, and executors may not see the driver's folders")
    return tempfile.mkdtemp(prefix="quiverlake-")

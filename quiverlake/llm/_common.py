"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a maximal run of code points other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder of the cluster."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder on one machine (as in tests), and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set, and executors may not see the driver's folders")
    return tempfile.mkdtemp(prefix="quiverlake-llm-")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes ``df`` as a table in the shared folder; the table, and its path for ``remove``.

    Unlike a checkpoint it does not bring along what Spark knows of the plan
    behind it; in a loop that renames columns, those constraints grow exponentially.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running_position(
    df: DataFrame, group: list[str], order: list[Column], weight: Column, out: str, slices: int = 1024, slice_of: Column | None = None
) -> DataFrame:
    """Exclusive running sum of ``weight`` within ``group``, in a shuffled order.

    The order is (slice, ``order``), where the slice is ``slice_of`` or else a
    hash of ``order``; so a group of any size is summed in ``slices`` windows, whose totals make
    a table of at most ``slices`` rows a group. No window holds a whole group.
    """
    cut = F.pmod(F.xxhash64(F.lit(7), *order), F.lit(slices)) if slice_of is None else slice_of
    tagged = df.withColumn("__slice", cut.cast("int")).withColumn("__w", weight)
    key = [*group, "__slice"]
    totals = tagged.groupBy(*key).agg(F.sum("__w").alias("__total"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = tagged.withColumn("__inside", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    on = None
    for c in key:
        same = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        on = same if on is None else on & same
    joined = summed.join(offsets, on, "inner")
    return joined.withColumn(out, (F.col("__offset") + F.col("__inside")).cast("long")).drop(
        "__slice", "__w", "__inside", "__offset", *[f"__k_{c}" for c in key]
    )

"""The host's table of documents: (document_id, title, body, region, status)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quiverlake.operators.visibility import sent_if_few
from quiverlake.sources.storage import Storage

DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("document_id", "title", "body", "region", "status")])
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


class ParquetHost:
    """Documents as an append-only log of versions; the last version of an id counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.storage = spark, path, Storage(spark, path)

    def _versions(self) -> DataFrame:
        kind = T.StructType([*DOCUMENT.fields, T.StructField("version", T.LongType()), T.StructField("removed", T.BooleanType())])
        parts = [n for n in self.storage.names(self.path) if n.startswith("v")]
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], kind)

    def _write(self, rows: DataFrame, removed: bool) -> None:
        names = [n for n in self.storage.names(self.path) if n.startswith("v")]
        version = int(names[-1][1:]) + 1 if names else 1
        rows.withColumn("version", F.lit(version).cast("long")).withColumn("removed", F.lit(removed)).write.parquet(f"{self.path}/v{version:012d}")

    def upsert(self, documents: DataFrame) -> None:
        full = documents.withColumn("status", F.coalesce("status", F.lit("published"))) if "status" in documents.columns else documents.withColumn("status", F.lit("published"))
        self._write(full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENT]), False)

    def set_status(self, ids: DataFrame, status: str) -> None:
        changed = self.documents().join(ids.select("document_id").distinct(), "document_id", "left_semi").withColumn("status", F.lit(status))
        self._write(changed.select(*DOCUMENT.names), False)

    def delete(self, ids: DataFrame) -> None:
        gone = ids.select(F.col("document_id").cast("string").alias("document_id")).distinct()
        self._write(gone.select("document_id", *[F.lit(None).cast("string").alias(c) for c in DOCUMENT.names[1:]]), True)

    def get(self, ids: DataFrame) -> DataFrame:
        return self.documents().join(ids.select("document_id").distinct(), "document_id", "left_semi")

    def listed(self) -> DataFrame:
        """All ids in order."""
        return self.documents().select("document_id").orderBy("document_id")

    def truncate(self) -> None:
        """Removes all documents and their versions."""
        for n in self.storage.names(self.path):
            self.storage.remove(f"{self.path}/{n}")

    def documents(self, include_unpublished: bool = True) -> DataFrame:
        """The last version of each document. Which rows are older is found on ids and places in files, so texts are read only where they are asked for."""
        rows = self._versions()
        if not [n for n in self.storage.names(self.path) if n.startswith("v")]:
            return rows.select(*DOCUMENT.names)
        place = ["version", "__file", "__row"]
        rows = rows.select(*rows.columns, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        order = Window.partitionBy("document_id").orderBy(F.col("version").desc(), "__file", "__row")
        older = rows.select("document_id", *place).withColumn("__n", F.row_number().over(order)).where("__n > 1").select(*place)
        last = rows.join(sent_if_few(older), place, "left_anti").where("not removed").select(*DOCUMENT.names)
        return last if include_unpublished else last.where("status = 'published'")


class JdbcHost:
    """Documents in a database, read in ranges where bounds are given. The driver's jar is the user's to supply."""

    def __init__(self, spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None):
        if not _NAME.fullmatch(table):
            raise ValueError(f"not a table name: {table!r}")
        self.spark, self.url, self.table, self.properties = spark, url, table, properties or {}

    def ddl(self) -> str:
        return f"create table if not exists {self.table} (document_id text primary key, title text not null, body text not null, region text not null, status text not null default 'published')"

    def upsert_sql(self) -> str:
        changed = ", ".join(f"{c} = excluded.{c}" for c in DOCUMENT.names[1:])
        return f"insert into {self.table} ({', '.join(DOCUMENT.names)}) values (?, ?, ?, ?, ?) on conflict (document_id) do update set {changed}"

    def documents(self, include_unpublished: bool = True) -> DataFrame:
        got = self.spark.read.jdbc(self.url, self.table, properties=self.properties).select(*[F.col(c).alias(c) for c in DOCUMENT.names])
        return got if include_unpublished else got.where("status = 'published'")

    # ---- writing: executors fill a table of their own, and one transaction on the driver takes it over ----

    def _run(self, *statements: tuple[str, ...]) -> int:
        """Statements in one transaction, each with its string parameters; returns the rows that the last one changed."""
        jvm = self.spark._jvm
        known = jvm.java.util.Properties()
        for k, v in self.properties.items():
            known.setProperty(k, v)
        c = jvm.java.sql.DriverManager.getConnection(self.url, known)
        try:
            c.setAutoCommit(False)
            n = 0
            for sql, *values in statements:
                s = c.prepareStatement(sql)
                for k, v in enumerate(values, 1):
                    s.setString(k, v)
                n = s.executeUpdate()
                s.close()
            c.commit()
            return n
        except Exception:
            c.rollback()
            raise
        finally:
            c.close()

    def _create(self, rows: DataFrame, name: str, mode: str) -> None:
        short = ", ".join(f"{c} VARCHAR(256)" for c in rows.columns if c in ("document_id", "region", "status"))
        rows.write.option("createTableColumnTypes", short).jdbc(self.url, name, mode=mode, properties=self.properties)

    def _staged(self, rows: DataFrame, *statements: str) -> int:
        stage = f"{self.table}_stage_{uuid.uuid4().hex[:12]}"
        self._create(rows, stage, "error")
        try:
            return self._run(*[(s.format(t=self.table, s=stage, all=", ".join(f'"{c}"' for c in DOCUMENT.names)),) for s in statements])
        finally:
            self._run((f"drop table {stage}",))

    def ensure_table(self) -> None:
        """Creates the table if it is not there, with the database's own type for long text."""
        self._create(self.spark.createDataFrame([], DOCUMENT), self.table, "ignore")

    def upsert(self, documents: DataFrame) -> int:
        """New documents are inserted and known ones replaced; of several rows with an id one counts."""
        full = documents.withColumn("status", F.coalesce("status", F.lit("published"))) if "status" in documents.columns else documents.withColumn("status", F.lit("published"))
        rows = full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENT]).dropDuplicates(["document_id"])
        return self._staged(rows, 'delete from {t} where "document_id" in (select "document_id" from {s})', "insert into {t} ({all}) select {all} from {s}")

    def set_status(self, ids: DataFrame, status: str) -> int:
        if not re.fullmatch(r"[a-z_]+", status):
            raise ValueError(f"not a status: {status!r}")
        return self._staged(ids.select(F.col("document_id").cast("string").alias("document_id")).distinct(), f"update {{t}} set \"status\" = '{status}' where \"document_id\" in (select \"document_id\" from {{s}})")

    def delete(self, ids: DataFrame) -> int:
        return self._staged(ids.select(F.col("document_id").cast("string").alias("document_id")).distinct(), 'delete from {t} where "document_id" in (select "document_id" from {s})')

    def get(self, document_id: str) -> DataFrame:
        """One document; the condition goes to the database."""
        return self.documents().where(F.col("document_id") == document_id)

    def listed(self) -> DataFrame:
        return self.documents().select("document_id").orderBy("document_id")

    def truncate(self) -> int:
        return self._run((f"delete from {self.table}",))

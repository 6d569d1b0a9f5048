import json

import pytest

from quiverlake import settings
from quiverlake.plans.engine import Engine, EngineOptions
from quiverlake.plans.sidecar import Sidecar, demo
from quiverlake.schema import Collection
from quiverlake.sources.host import JdbcHost, ParquetHost
from quiverlake.sources.log import as_json_lines, from_json_lines
from quiverlake.streaming import ingest, outbox

DOCS = [("1", "Postgres search", "sidecar with sql database", "us"), ("2", "Python sdk", "pytest script and postgres", "us"), ("3", "Music", "song playlist", "ca")]


@pytest.fixture
def side(spark, tmp_path):
    host = ParquetHost(spark, f"{tmp_path}/host")
    host.upsert(spark.createDataFrame(DOCS, "document_id string, title string, body string, region string"))
    return Sidecar(spark, f"{tmp_path}/index", host, options=EngineOptions(ivf_auto_threshold=None))


def _ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "document_id string")


def _search(spark, side, text, **how):
    got = side.search(spark.createDataFrame([(0, text)], "qid int, text string"), **how)
    return [r["document_id"] for r in got.orderBy("rank").collect()]


def test_flow(spark, side):
    side.backfill()
    assert _search(spark, side, "postgres search sidecar", top_k=2, region="us") == ["1", "2"]
    side.host.set_status(_ids(spark, "1"), "unpublished")
    assert _search(spark, side, "postgres", top_k=2, region="us") == ["2"]  # the host wins before the sync
    assert [r["document_id"] for r in side.drift().collect()] == ["1"]
    side.repair()
    assert side.drift().count() == 0
    assert side.flush() and side.compact() == []
    side.host.delete(_ids(spark, "2"))
    hits = side.candidates(spark.createDataFrame([(0, "postgres")], "qid int, text string"), region="us")
    assert [r["vector_id"] for r in hits.collect()] == ["document:2"] and _search(spark, side, "postgres", region="us") == []
    side.repair(_ids(spark, "2"))
    assert side.candidates(spark.createDataFrame([(0, "postgres")], "qid int, text string"), region="us").count() == 0
    assert sorted(r["document_id"] for r in side.known().collect()) == ["1", "2", "3"]


def test_outbox_as_a_stream(spark, side, tmp_path):
    box, check = outbox.Outbox(spark, f"{tmp_path}/outbox"), f"{tmp_path}/check"
    put = lambda *rows: box.enqueue(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, document_id string, operation string"), ["n"])
    state = lambda: {r["event_id"]: (r["status"], r["attempts"]) for r in box.events().collect()}
    assert box.pending().count() == 0 and put(("1", "upsert"), ("3", "backfill")) == 2
    outbox.start(side, box, check).awaitTermination()
    assert sorted(r["vector_id"] for r in side.engine.visible().collect()) == ["document:1", "document:3"]
    assert state() == {1: ("processed", 1), 2: ("processed", 1)}
    assert outbox.unpublish_with_event(side, box, _ids(spark, "3")) == 3
    outbox.start(side, box, check).awaitTermination()
    before = side.engine.last_epoch()
    outbox.start(side, box, check).awaitTermination()
    assert side.engine.last_epoch() == before and [r["vector_id"] for r in side.engine.visible().collect()] == ["document:1"]
    assert put(("2", "upsert"), ("2", "explode"), ("1", "delete")) == 6
    with pytest.raises(outbox.UnknownOperation):
        outbox.process(side, box)
    assert sorted(r["vector_id"] for r in side.engine.visible().collect()) == ["document:1", "document:2"]
    assert [state()[k] for k in (4, 5, 6)] == [("processed", 1), ("failed", 1), ("pending", 0)]
    assert outbox.process(side, box) == 1 and outbox.process(side, box) == 0  # goes on behind the failed one
    assert box.events().where("event_id = 5").first()["error"] == "unknown operation explode"
    box.retry(box.events().where("event_id = 5"))
    assert state()[5] == ("pending", 2)
    put(("1", "explode"), ("2", "repair"))
    outbox.start(side, box, check).awaitTermination()  # a stream marks failures and does not end
    assert [state()[k] for k in (5, 7, 8)] == [("failed", 3), ("failed", 1), ("processed", 1)]


def test_host_write_with_event(spark, side, tmp_path):
    box = outbox.Outbox(spark, f"{tmp_path}/box")
    new = spark.createDataFrame([("9", "New", "sql song", "ca")], "document_id string, title string, body string, region string")
    assert outbox.write_with_event(side, box, new) == 1
    assert side.engine.visible().count() == 0 and json.loads(box.pending().first()["payload"]) == {"status": "published"}
    assert outbox.drain(side, box) == 1 and _search(spark, side, "song", region="ca") == ["9"]
    side.delete(_ids(spark, "9"))
    assert side.engine.visible().count() == 0 and side.host.get(_ids(spark, "9")).count() == 0
    side.write(new)
    side.unpublish(_ids(spark, "9"))
    assert side.engine.visible().count() == 0
    assert [r["document_id"] for r in side.host.listed().collect()] == ["1", "2", "3", "9"]
    side.host.truncate()
    assert side.host.documents().count() == 0


def test_demo(spark, tmp_path):
    assert _search(spark, demo(spark, f"{tmp_path}/demo"), "postgres", top_k=1) == ["1"]


def test_jdbc_host(spark, tmp_path):
    """Against the embedded database that comes with Spark."""
    host = JdbcHost(spark, f"jdbc:derby:{tmp_path}/db;create=true", "docs", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    host.ensure_table()
    host.ensure_table()
    new = lambda *rows: spark.createDataFrame(list(rows), "document_id string, title string, body string, region string")
    host.upsert(new(("1", "a", "x", "us"), ("2", "b", "y", "ca")))
    host.upsert(new(("2", "c", "z", "ca"), ("3", "it's", "w", "us")))
    assert {r["document_id"]: (r["title"], r["status"]) for r in host.documents().collect()} == {"1": ("a", "published"), "2": ("c", "published"), "3": ("it's", "published")}
    assert host.set_status(_ids(spark, "2", "9"), "unpublished") == 1 and [r["document_id"] for r in host.documents(False).orderBy("document_id").collect()] == ["1", "3"]
    assert host.delete(_ids(spark, "1")) == 1 and host.get("1").count() == 0 and host.get("3").first()["body"] == "w"
    assert [r["document_id"] for r in host.listed().collect()] == ["2", "3"]
    side = Sidecar(spark, f"{tmp_path}/jdbc-index", host, options=EngineOptions(ivf_auto_threshold=None))
    side.backfill()
    assert [r["vector_id"] for r in side.engine.visible().collect()] == ["document:3"]
    host.truncate()
    assert host.documents().count() == 0


def test_write_stream_and_auto_flush(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/e", Collection("c", 2), EngineOptions(ivf_auto_threshold=None))
    now = [0.0]
    flush = ingest.AutoFlush(engine, rows=3, seconds=10, clock=lambda: now[0])
    source = f"{tmp_path}/in"
    for k in range(2):
        spark.createDataFrame([(3 * k + j, f"v{j}", [1.0 * k, float(j)]) for j in range(2 + k)], "seq int, vector_id string, embedding array<float>").write.mode("append").parquet(source)
        writes = spark.readStream.schema("seq int, vector_id string, embedding array<float>").parquet(source)
        ingest.write_stream(engine, writes, ["seq"], f"{tmp_path}/check", flush).awaitTermination()
        assert len(engine.store.load("shard-0").active) == k
    assert {r["vector_id"]: r["embedding"][0] for r in engine.visible().collect()} == {"v0": 1.0, "v1": 1.0, "v2": 1.0}
    engine.upsert([("w", [0, 0], None)])
    assert flush.poll() == []
    now[0] = 11.0
    assert len(flush.poll()) == 1


def test_rate_limit_stream(spark, tmp_path):
    source = f"{tmp_path}/req"
    spark.createDataFrame([("a", k, float(k)) for k in range(6)], "identifier string, seq long, ts double").write.parquet(source)
    stream = ingest.rate_limited_stream(spark.readStream.schema("identifier string, seq long, ts double").parquet(source), 2, 3.0)
    stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert [r["allowed"] for r in spark.table("limited").orderBy("seq").collect()] == [True, True, False, True, True, False]


def test_json_lines(spark, tmp_path):
    path = f"{tmp_path}/wal"
    engine = Engine(spark, f"{tmp_path}/e", Collection("c", 2, {"region": "keyword"}), EngineOptions(ivf_auto_threshold=None))
    engine.upsert([("a", [1, 2], {"region": "us"})])
    as_json_lines(engine.log.replay(), path)
    with open(f"{tmp_path}/wal/part-extra.json", "w") as f:
        f.write(json.dumps({"operation": "delete", "vector_id": "a", "write_epoch": 2, "unknown": 1}) + "\n")
    back = from_json_lines(spark, path, engine.metadata_type).orderBy("write_epoch").collect()
    assert [(r["operation"], r["shard_id"], r["embedding"]) for r in back] == [("upsert", "shard-0", [1.0, 2.0]), ("delete", "shard-0", None)]


def test_jdbc_names(spark):
    with pytest.raises(ValueError):
        JdbcHost(spark, "jdbc:x", "a; drop table b")
    host = JdbcHost(spark, "jdbc:x", "public.documents")
    assert "on conflict (document_id)" in host.upsert_sql() and "create table" in host.ddl()
    with pytest.raises(ValueError):
        host.set_status(None, "x' or 1=1")


def test_settings():
    got = settings.settings({"QUIVERLAKE_TENANTS": " a:x , b: y,", "QUIVERLAKE_RATE_LIMIT": "5", "QUIVERLAKE_IVF_AUTO_THRESHOLD": "none", "OTHER": "1"})
    assert [(t.api_key, t.collection_id) for t in got.tenants] == [("a", "x"), ("b", "y")]
    assert (got.rate_limit, got.ivf_auto_threshold, got.options().flush_threshold) == (5, None, 10_000)
    assert (got.collection_of("b"), got.collection_of("c"), settings.settings({}).collection_of(None)) == ("y", None, "documents")
    for bad in ("a", "a:", ":b"):
        with pytest.raises(ValueError):
            settings.parse_tenants(bad)


def test_versions_are_settled_without_their_texts(spark, tmp_path):
    host = ParquetHost(spark, f"{tmp_path}/host")
    kind = "document_id string, title string, body string, region string"
    assert host.documents().collect() == []
    host.upsert(spark.createDataFrame([("1", "a", "x", "us"), ("1", "a", "x", "us"), ("2", "b", "y", "us"), (None, "n", "z", "us")], kind).repartition(3))
    host.upsert(spark.createDataFrame([("2", "c", "w", "ca")], kind))
    host.delete(spark.createDataFrame([("3",)], "document_id string"))
    assert sorted(map(str, host.documents().select("document_id", "body").collect())) == sorted(["Row(document_id='1', body='x')", "Row(document_id='2', body='w')", "Row(document_id=None, body='z')"])
    plan = host.documents(False).select("document_id")._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "title" not in plan


def test_a_sync_embeds_each_text_once(spark, side, monkeypatch):
    from pyspark.sql import functions as F

    from quiverlake.functions import text as X

    read = spark.sparkContext.accumulator(0)

    def seen(text, groups):
        @F.udf("array<double>")
        def one(t):
            read.add(1)
            return [1.0] + [0.0] * (len(groups) - 1)

        return one(text)

    plain = X.embed_text
    monkeypatch.setattr(X, "embed_text", seen)
    side.backfill()
    assert read.value == len(DOCS)
    side.sync(_ids(spark, "1"))
    assert read.value == len(DOCS) + 1
    monkeypatch.undo()
    low = plain(F.col("id").cast("string"), X.DEFAULT_GROUPS)
    assert spark.range(1).select(low)._jdf.queryExecution().analyzed().toString().count("lower(") <= 2  # in the column and in its name


def test_an_append_to_the_log_holds_no_rows(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    log = Engine(spark, f"{tmp_path}/e", Collection("c", 2)).log
    row = ("upsert", "c", "s", "a", 1, [1.0, 2.0], None, None)
    rows = spark.createDataFrame([row, (*row[:2], "t", "b", 2, *row[5:])], log.schema)
    monkeypatch.setattr(DataFrame, "persist", lambda *_: pytest.fail("held"))
    log.append(rows)
    log.append(rows.limit(0))
    assert log.shards() == ["s", "t"]
    assert log.last_epoch() == 2 and log.replay().agg(F.count("*")).first()[0] == 2
    assert not [n for n in log.storage.names(log.folder) if n.startswith(".draft")]

"""Versioned tables, changes of collections, files and streams."""

from datetime import datetime

import gzip

import pytest
from pyspark.sql import functions as F

from tarnlake.errors import InvalidArgument, NotFound
from tarnlake.operators import mutations as M
from tarnlake.schemas import DDL, conform, dto, schema
from tarnlake.sources import files
from tarnlake.sources.tables import Store
from tarnlake.streaming import jobs

NOW = datetime(2024, 1, 2)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(spark, name, *items):
    kinds = {f.name: f.dataType for f in schema(name)}
    keys = sorted({k for i in items for k in i})
    from pyspark.sql.types import StructField, StructType

    return conform(spark.createDataFrame([tuple(i.get(k) for k in keys) for i in items], StructType([StructField(k, kinds[k]) for k in keys])), name)


def point(id_, k, d, c):
    return {"id": id_, "knowledge_id": k, "embedding": [1.0], "payload": ("t", (c, d, k, True), True)}


def test_versions(store, spark):
    store.bootstrap()
    assert all(r.available for r in store.health().collect()) and store.read("settings").first().top_k == 5
    assert store.read("documents").count() == 0
    store.append("documents", rows(spark, "documents", {"_id": "1", "title": "a"}))
    assert store.read("documents").first().is_active is True
    assert store.write("documents", M.delete(store.read("documents"), F.col("_id") == "1")) == 2
    assert store.read("documents").count() == 0 and store.versions("documents") == [1, 2]
    store.vacuum("documents", 1)
    assert store.versions("documents") == [2] and dto(store.read("documents"), "documents").columns[0] == "_id"
    store.drop("documents")
    with pytest.raises(NotFound):
        store.read("documents")


def test_unfinished_version_is_ignored(store, spark, tmp_path):
    store.write("x", spark.range(3))
    (tmp_path / "store" / "x" / "v2").mkdir()
    assert store.read("x").count() == 3


def test_points_of_a_wrong_size_stop_the_write(store, spark):
    store.insert_points(rows(spark, "points", point(None, "k", "d", "c")), size=1)
    assert store.read("points").first().id
    with pytest.raises(Exception, match="wrong size"):
        store.insert_points(rows(spark, "points", point(None, "k", "d", "c")), size=2)


def test_upsert_and_insert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, M.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, M.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_document_life(spark):
    k = rows(spark, "knowledges", {"_id": "k1", "name": "one"}, {"_id": "k2", "name": "two"})
    d = rows(spark, "documents", {"_id": "d1", "knowledge_id": "k1", "title": "t1", "file_size_bytes": 10}, {"_id": "d2", "knowledge_id": "k1", "title": "t2", "file_size_bytes": 5})
    c = rows(spark, "document_chunks", {"_id": "c1", "document_id": "d1", "knowledge_id": "k1"}, {"_id": "c2", "document_id": "d2", "knowledge_id": "k1"})
    p = rows(spark, "points", point("p1", "k1", "d1", "c1"), point("p2", "k1", "d2", "c2"))
    j = rows(spark, "document_jobs", {"_id": "j1", "document_id": "d1", "knowledge_id": "k1", "title": "t1", "file": ("bucket/a/b.txt", 1, "b.txt", ".txt")})
    s = rows(spark, "settings", {"_id": "s", "list_knowledge_ids": ["k1", "k2"]})
    tables = {"knowledges": k, "documents": d, "document_chunks": c, "points": p, "document_jobs": j, "settings": s}
    new = M.delete_document(tables, "d1")
    assert [new[n].count() for n in ("documents", "document_chunks", "points")] == [1, 1, 1]
    assert new["document_jobs"].first().document_status == "deleted"
    assert {r._id: (r.document_count, r.total_size_bytes) for r in new["knowledges"].collect()} == {"k1": (1, 5), "k2": (0, 0)}
    gone = M.delete_knowledge(tables, "k1")
    assert [gone[n].count() for n in ("knowledges", "documents", "points", "document_jobs")] == [1, 0, 0, 0] and gone["settings"].first().list_knowledge_ids == ["k2"]
    assert M.files_of_knowledge(j, "k1").first() == ("bucket", "a/b.txt")
    chunks, points = M.toggle_chunks(c, p, ["c1"])
    assert {r._id: r.is_active for r in chunks.collect()} == {"c1": False, "c2": True}
    assert {r.id: r.payload.metadata.is_active for r in points.collect()} == {"p1": False, "p2": True}
    docs, points = M.update_document(d, p, "d2", title="new", is_active=False)
    assert {r._id: (r.title, r.is_active) for r in docs.collect()} == {"d1": ("t1", True), "d2": ("new", False)}
    assert {r.id: r.payload.document_is_active for r in points.collect()} == {"p1": True, "p2": False}
    batch = rows(spark, "documents", {"_id": "n1", "knowledge_id": "k1", "title": "t1"}, {"_id": "n2", "knowledge_id": "k1", "title": "x"}, {"_id": "n3", "knowledge_id": "k2", "title": "y"}, {"_id": "n4", "knowledge_id": "k2", "title": "y"})
    pending = M.create_documents(j, d, batch.select("knowledge_id", "title")).filter("processing_status.status = 'pending'")
    assert [r.title for r in pending.collect()] == ["x"]
    assert M.add_training_jobs(j, d).filter("type = 'training_document'").count() == 2
    settings, flagged = M.update_settings(s, k, ["k2"], top_k=9)
    assert settings.first().top_k == 9 and {r._id: r.select_training for r in flagged.collect()} == {"k1": False, "k2": True}
    assert M.update_settings(s, k, [])[1].filter("select_training").count() == 0
    assert M.create_knowledge(k, rows(spark, "knowledges", {"_id": "k3", "name": "two"}, {"_id": "k4", "name": "four"})).count() == 3
    assert M.update_knowledge(k, "k1", name="uno").filter("name = 'uno'").count() == 1
    for bad in (lambda: M.delete_points(p), lambda: M.set_payload(p, {"content": "x"})):
        with pytest.raises(InvalidArgument):
            bad()


def test_sessions_and_messages(spark):
    s = rows(spark, "chat_sessions", {"_id": "s1", "user_id": "u", "title": "a"})
    m = rows(spark, "chat_histories", {"_id": "m1", "session_id": "s1", "user_id": "u", "content": "x", "role": "user"})
    assert M.create_session(s, rows(spark, "chat_sessions", {"_id": "s2", "user_id": "u", "title": "a"}, {"_id": "s3", "user_id": "u", "title": "b"})).count() == 2
    assert M.update_session(s, "s1", title="z").first().title == "z"
    messages, sessions = M.append_messages(m, s, rows(spark, "chat_histories", {"_id": "m2", "session_id": "s1", "user_id": "u", "created_at": NOW}))
    assert messages.count() == 2 and sessions.first().updated_at == NOW
    assert [x.count() for x in M.delete_session(s, m, "s1")] == [0, 0] and M.delete_user_messages(m, "u").count() == 0
    from tarnlake.operators.dialogue import sessions_for

    asked = spark.createDataFrame([("u", "s1", "hi"), ("u", "nope", "long text"), ("admin", None, "q")], "user_id string, session_id string, content string")
    got = {(r.user_id, r.session_id): (r.target_session, r.is_new) for r in sessions_for(asked, s).collect()}
    assert got["u", "s1"] == ("s1", False) and got["u", "nope"][1] and got["admin", None][1]


def test_profiles_and_readings(spark):
    p = rows(spark, "user_profiles", {"_id": "1", "user_id": "u"})
    assert M.add_profiles(p, rows(spark, "user_profiles", {"_id": "2", "user_id": "u"}, {"_id": "3", "user_id": "v"})).count() == 2
    r = rows(spark, "health_records", {"_id": "1", "value": 1.0})
    new = M.add_readings(r, rows(spark, "health_records", {"_id": "2", "value": -1.0}, {"_id": "3", "value": 2.0, "subtype": "Tâm thu"}))
    assert {x.subtype for x in new.collect()} == {None, "tâm thu"} and new.count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Xin chào".encode())
    (tmp_path / "b.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"not a pdf")
    parsed = {r.path.rsplit("/", 1)[1]: r for r in files.parse_files(files.objects(spark, f"file://{tmp_path}")).collect()}
    assert parsed["a.txt"].content == "Xin chào" and parsed["b.TXT"].content == "café" and "UNSUPPORTED" in parsed["c.exe"].error and parsed["d.pdf"].error
    assert ".txt" in files.supported_extensions() and files.parser_for("x/y.txt?z=1") is files.parse_txt
    with pytest.raises(InvalidArgument):
        files.parser_for("none")
    text = spark.createDataFrame([("TIÊU ĐỀ\nmột dòng",)], "t string")
    assert text.select(files.marked_lines(F.col("t"), per_line=True)).first()[0] == "[HEADING]TIÊU ĐỀ[/HEADING]\nmột dòng"
    b = files.Bucket(spark, f"file://{tmp_path}/bucket")
    b.ensure()
    b.put("x/y.html", b"<p>hi</p>")
    assert b.get("x/y.html") == b"<p>hi</p>" and b.stat("x/y.html") == {"size": 9, "name": "y.html", "content_type": "text/html"}
    big = bytes(range(256)) * 1000
    b.put("big.txt", big)
    assert [len(c) for c in b.chunks("big.txt", 100_000)] == [100_000, 100_000, 56_000] and b"".join(b.chunks("big.txt")) == big
    assert b"".join(b.chunks("big.txt", 7, 5, 20)) == big[5:25] and list(b.chunks("big.txt", start=300_000)) == []
    plain, packed = b.download("big.txt"), b.download("big.txt", "gzip, deflate")
    assert plain["encoding"] is None and b"".join(plain["stream"]) == big and packed["encoding"] == "gzip"
    parts = list(packed["stream"])
    assert gzip.decompress(b"".join(parts)) == big and sum(map(len, parts)) < len(big)
    assert b.download("x/y.html", "gzip")["encoding"] is None  # too small to gain
    b.delete("x/y.html")
    with pytest.raises(Exception):
        b.get("x/y.html")


def test_stream_of_jobs(spark, tmp_path):
    queue, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("queue", "out", "checkpoint"))
    make = lambda *r: spark.createDataFrame([(i, t, NOW) for i, t in r], jobs.MESSAGE)
    handlers = {"upload_document": lambda b: jobs.status_rows(b), "training_document": lambda b: jobs.status_rows(b, jobs.TRAINING_STAGES)}
    jobs.enqueue(make(("1", "upload_document"), ("1", "upload_document"), ("2", "training_document"), ("3", "strange")), queue)
    jobs.run_jobs(spark, queue, out, checkpoint, handlers).awaitTermination()
    jobs.enqueue(make(("1", "upload_document"), ("4", "upload_document")), queue)
    jobs.run_jobs(spark, queue, out, checkpoint, handlers).awaitTermination()
    log = spark.read.parquet(f"{out}/results")
    assert {r.id: r.status for r in jobs.current_status(log).collect()} == {"1": "completed", "2": "completed", "4": "completed"}
    assert log.filter("id = '1'").count() == len(jobs.UPLOAD_STAGES)
    assert [r.id for r in spark.read.parquet(f"{out}/dead").collect()] == ["3"]


def test_stream_deduplicates_like_batch(spark, tmp_path, sf_small):
    events = spark.read.parquet(f"{sf_small}/events.parquet").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("created_at"))
    jobs.enqueue(events, f"file://{tmp_path}/q")
    q = jobs.fresh_jobs(jobs.read_jobs(spark, f"file://{tmp_path}/q"), "60 days").select("id").writeStream.format("parquet").option("path", f"file://{tmp_path}/o").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/o").collect()) == sorted(r.id for r in events.select("id").distinct().collect())


def test_contents_and_progress(spark):
    f = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"2")], "path string, content binary")
    new, duplicates = jobs.dedupe_contents(f, spark.createDataFrame([("c81e728d9d4c2f636f067f89cc14862c",)], "file_hash string"))
    assert [r.path for r in new.collect()] == ["a"] and sorted(r.path for r in duplicates.collect()) == ["b", "c"]
    p = spark.createDataFrame([(0.3,), (0.0,), (80.0,)], "p double")
    assert [r[0] for r in p.select(jobs.normal_progress(F.col("p"))).collect()] == [30.0, 0.0, 80.0]
    assert set(DDL) >= {"documents", "points"}

"""Ingestion, training and chat from end to end."""

from datetime import datetime

from pyspark.sql import functions as F

from tarnlake.functions.registry import embedder, generator
from tarnlake.plans.chat import answers
from tarnlake.plans.ingestion import ingest, train
from tarnlake.schemas import conform
from tarnlake.sources import fixtures
from tarnlake.sources.files import objects
from tarnlake.sources.tables import Store

ANCHOR = datetime(2024, 5, 8, 12)


def test_ingest_and_train(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    long = " ".join(f"Câu số {i} nói về insulin và đường huyết của người bệnh." for i in range(12))
    (folder / "a.txt").write_text(long)
    (folder / "b.txt").write_text(long)
    (folder / "c.txt").write_text("quá ngắn")
    (folder / "d.bin").write_bytes(b"\x00")
    store = Store(spark, f"file://{tmp_path}/store")
    store.bootstrap()
    out = ingest(objects(spark, f"file://{folder}"), store.read("documents"), "k1", embedder(size=16))
    for name in ("documents", "document_chunks", "points"):
        store.append(name, conform(out[name], name))
    assert [r.path.rsplit("/", 1)[1] for r in out["duplicates"].collect()] == ["b.txt"]
    assert [r.path.rsplit("/", 1)[1] for r in out["failed"].collect()] == ["d.bin"]
    documents = {r.title: r for r in store.read("documents").collect()}
    assert set(documents) == {"a.txt", "c.txt"} and documents["a.txt"].priority_diabetes > 0 and documents["c.txt"].priority_diabetes == 0
    chunks, points = store.read("document_chunks"), store.read("points")
    assert chunks.count() == points.count() > 0 and points.first().payload.metadata.document_id == documents["a.txt"]._id
    again = ingest(objects(spark, f"file://{folder}"), store.read("documents"), "k1")
    assert again["document_chunks"].count() == 0 and again["duplicates"].count() == 3
    ids = [documents["a.txt"]._id]
    assert train(chunks, points, ids).count() == 0
    assert train(chunks, points.limit(0), ids, embedder(size=4)).count() == chunks.count()


def test_answers(spark):
    rows = [("user_001", "s1", "đường huyết gần đây thế nào"), ("user_002", "s2", "xin chào"), ("user_002", "s3", "insulin hoạt động ra sao"), ("nobody", "s4", "ung thư chữa thế nào")]
    messages = spark.createDataFrame(rows, "user_id string, session_id string, question string")
    history = spark.createDataFrame([("s1", "ai", "xu hướng tăng", 1), ("s3", "user", "chào", 1)], "session_id string, role string, text string, position int")
    contexts = spark.createDataFrame([("s3", ["tài liệu một"])], "session_id string, contexts array<string>")
    out = answers(messages, history, contexts, fixtures.profiles(spark), fixtures.readings(spark, ANCHOR), F.lit(ANCHOR), generator(lambda: (lambda p: "### Trả lời\n" + p), "x"))
    got = {r.session_id: r for r in out.collect()}
    assert (got["s1"].kind, got["s1"].route, got["s1"].case) == ("trend", "status", "glucose")
    assert got["s1"].prompt.startswith("Lần trước") and "Đường huyết trung bình: 9.1" in got["s1"].prompt
    assert got["s2"].route == "greeting" and got["s3"].route == "rag" and got["s3"].answer.startswith("### Trả lời") and "tài liệu một" in got["s3"].prompt
    assert got["s4"].route == "guidance" and got["s4"].prompt == "ung thư"

"""The queue as a data source: byte ranges, offsets, restarts, purging, lines that aren't jobs."""

import json

import pytest
from pyspark.sql import functions as F

from tarnlake.sources import queue
from tarnlake.sources.queue import JobQueue, Range, lines, opened, ranges


@pytest.fixture
def jobs(spark, tmp_path):
    spark.dataSource.register(JobQueue)
    path = str(tmp_path / "queue")

    def put(first, count, parts=2):
        rows = spark.range(first, first + count, numPartitions=parts).selectExpr("cast(id as string) as id", "if(id % 2 = 0, 'upload_document', 'training_document') as type", "timestamp_seconds(1700000000 + id) as created_at")
        rows.write.format("job_queue").mode("append").save(path)
        return path

    return put


@pytest.mark.parametrize("split", [1, 7, 64, 1000])
def test_ranges_hold_each_line_once(tmp_path, monkeypatch, split):
    monkeypatch.setattr(queue, "BLOCK", 5)
    path = tmp_path / "x"
    want = [b"a", b"bb" * 40, b"c", "é".encode() * 9, b"last"]
    path.write_bytes(b"\n\n".join(want))
    fs, _ = opened(str(path))
    parts = ranges([(0, str(path), path.stat().st_size)], split)
    assert [x for p in parts for x in lines(fs, p)] == want
    assert list(lines(fs, Range(str(path), 0, 0, path.stat().st_size))) == want


def test_batch_reads_all_segments_by_ranges(spark, jobs):
    path = jobs(0, 100)
    jobs(100, 50, 1)
    df = spark.read.format("job_queue").option("split", "500").load(path)
    assert df.rdd.getNumPartitions() > 10
    got = df.collect()
    assert sorted(int(r.id) for r in got) == list(range(150)) and {r.segment for r in got} == {0, 1} and not any(r.error for r in got)
    assert spark.read.format("job_queue").load(path + "-none").count() == 0


@pytest.mark.parametrize("purge", ["false", "true"])
def test_no_job_twice_over_restarts(spark, jobs, tmp_path, purge):
    """Batches, a restart with nothing new, one with more, and one after a batch that failed: every job is worked on once."""
    path, out = jobs(0, 30), tmp_path / "out"
    fail = iter([False, True])

    def work(batch, number):
        batch.write.mode("overwrite").parquet(f"file://{out}/batch={number}")
        if next(fail, False):
            raise OSError("lost")

    def run():
        stream = spark.readStream.format("job_queue").option("purge", purge).load(path)
        stream.writeStream.foreachBatch(work).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    jobs(30, 20)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    run()
    jobs(50, 5)
    run()
    ids = sorted(int(r.id) for r in spark.read.parquet(f"file://{out}").collect())
    assert ids == list(range(55))
    left = queue.segments(path)
    assert (len({n for n, _, _ in left}) == 3) if purge == "false" else (len({n for n, _, _ in left}) <= 1)


def test_lines_that_are_no_jobs(spark, jobs, tmp_path):
    path = jobs(0, 2)
    (tmp_path / "queue" / "000000000001-00000.jsonl").write_text('{"id": "x"}\nnot json\n[1]\n\n' + json.dumps({"id": "y", "type": "upload_document", "created_at": "2024-01-01T00:00:00", "more": {"a": 1}}))
    assert spark.read.format("job_queue").load(path).count() == 2  # not yet whole
    (tmp_path / "queue" / "000000000001.ready").write_text("")
    got = spark.read.format("job_queue").load(path).filter(F.col("segment") == 1).collect()
    assert [r.id for r in got if not r.error] == ["y"] and len([r for r in got if r.error]) == 3


def test_a_write_that_fails_leaves_no_segment(spark, jobs):
    path = jobs(0, 4)
    bad = spark.range(4).selectExpr("cast(if(id = 3, raise_error('stop'), id) as string) as id", "'t' as type", "current_timestamp() as created_at")
    with pytest.raises(Exception, match="stop"):
        bad.write.format("job_queue").mode("append").save(path)
    assert spark.read.format("job_queue").load(path).count() == 4

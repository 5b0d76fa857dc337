"""Streams over several batches: late rows, restarts, failures between two writes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnlake.streaming import states
from tarnlake.streaming.history import HashHistory, deduplicate
from tarnlake.streaming.windows import followed_by, route_late, run_once, session_counts, sliding_counts

START = datetime(2024, 1, 1)
EVENTS = "id long, event_id long, at timestamp, event string"


def hours(h):
    return START + timedelta(hours=h)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes rows as one file, which a stream of one file a batch takes as its next batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    number = iter(range(100))

    def put(rows, schema):
        k = next(number)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/made-{k}")
        (part,) = (tmp_path / f"made-{k}").glob("part-*.parquet")
        part.rename(folder / f"{k:03}.parquet")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")

    return put


def log_of(df):
    return sorted((r.id, str(r.at), r.event_id if r.event_id is not None else -1, r.status, r.accepted, r.reason) for r in df.collect())


def test_job_machine_over_batches_and_a_restart(spark, feed, tmp_path):
    """Illegal steps are told apart, a silent job times out by its timer, one that speaks too late finds itself failed, and
    what a restart adds starts from the state before it."""
    stream = feed([(1, 1, hours(0), "pending"), (1, 2, hours(1), "processing"), (2, 3, hours(1), "processing"), (3, 4, hours(1), "pending"), (3, 5, hours(2), "processing"), (None, 6, hours(2), "pending"), (4, 60, hours(2), None)], EVENTS)
    run = lambda: run_once(states.job_log(stream, 3600 * 5, "1 hour"), f"file://{tmp_path}/out")
    first = log_of(run().filter("id is not null"))
    assert (2, str(hours(1)), 3, None, False, "nothing to processing") in first and (4, str(hours(2)), 60, None, False, "nothing to None") in first
    assert not [r for r in first if r[5] == "timed out"]
    feed([(1, 7, hours(3), "completed"), (1, 8, hours(3), "failed"), (3, 9, hours(7.5), "completed")], EVENTS)  # 3 was silent for five hours and a half
    second = log_of(run().filter("id is not null"))
    assert set(first) < set(second)
    assert (3, str(hours(7)), -1, "failed", True, "timed out") in second and (3, str(hours(7.5)), 9, "failed", False, "failed to completed") in second
    assert (1, str(hours(3)), 8, "completed", False, "completed to failed") in second
    feed([(5, 10, hours(20), "pending"), (5, 11, hours(21), "processing")], EVENTS)
    feed([(6, 12, hours(40), "pending")], EVENTS)  # moves the watermark past the time-out of 5
    done = run()
    assert (5, str(hours(26)), -1, "failed", True, "timed out") in log_of(done.filter("id is not null"))
    got = {r.id: (r.status, str(r.at), r.accepted, r.rejected) for r in states.final_states(done).collect()}
    assert got == {1: ("completed", str(hours(3)), 3, 1), 2: (None, "None", 0, 1), 3: ("failed", str(hours(7)), 2, 1), 4: (None, "None", 0, 1), 5: ("failed", str(hours(26)), 2, 0), 6: ("pending", str(hours(40)), 1, 0), None: ("pending", str(hours(2)), 1, 0)}


def test_cached_values_expire(spark, feed, tmp_path):
    """Over batches and a restart, each lookup is what a replay of one dictionary gives."""
    lookups = [(k, 10 * h + k, hours(h)) for h in range(0, 30, 2) for k in range(3) if (h + k) % 4]
    schema = "id long, event_id long, at timestamp"
    run = lambda: run_once(states.cached_lookups(stream, lambda k: f"v{k}", 3600 * 6, "1 hour"), f"file://{tmp_path}/out")
    for part in (lookups[:12], lookups[12:20], lookups[20:]):
        stream = feed(part, schema)
        found = run()
    held, want = {}, []
    for k, e, at in lookups:
        hit = k in held and at - held[k] <= timedelta(hours=6)
        held[k] = held[k] if hit else at
        want.append((k, e, str(at), hit, str(held[k]), f"v{k}"))
    assert sorted((r.id, r.event_id, str(r.at), r.hit, str(r.computed_at), r.value) for r in found.collect()) == sorted(want)
    assert {h for _, _, _, h, _, _ in want} == {True, False}


def test_late_rows_have_a_table_of_their_own(spark, feed, tmp_path):
    """What comes later than the delay is kept apart, the same way when a batch runs again, and windows over the rest lose nothing."""
    schema, out = "k long, ts timestamp", f"file://{tmp_path}/routed"
    stream = feed([(1, hours(10)), (2, hours(9))], schema)
    feed([(3, hours(8.5)), (4, hours(9.5)), (5, None), (6, hours(14))], schema)  # 3 is later than an hour behind 10
    feed([(7, hours(12)), (8, hours(13.5))], schema)
    route_late(stream, "ts", "1 hour", out, f"{out}/checkpoint").awaitTermination()
    rows = lambda name: sorted(r.k for r in spark.read.parquet(f"{out}/{name}").collect())
    assert rows("late") == [3, 7] and rows("on_time") == [1, 2, 4, 5, 6, 8]
    import shutil

    (tmp_path / "routed/checkpoint/commits/2").unlink()  # as if the last batch had failed after its writes
    (tmp_path / "routed/checkpoint/commits/.2.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "routed/on_time/batch=2")
    route_late(stream, "ts", "1 hour", out, f"{out}/checkpoint").awaitTermination()
    assert rows("late") == [3, 7] and rows("on_time") == [1, 2, 4, 5, 6, 8]


def test_windows_over_batches(spark, feed, tmp_path):
    """Windows, sessions and joins over several batches and restarts give what one batch does."""
    rows = [(i % 4, i, hours(i * 0.7 + (i % 3) * 0.2), "view" if i % 2 else "purchase") for i in range(60)]
    schema = "user_id long, event_id long, ts timestamp, kind string"
    kinds = {
        "slide": lambda s: sliding_counts(s, "ts", ["kind"], "6 hours", "2 hours", "2 hours"),
        "session": lambda s: session_counts(s, "ts", ["user_id"], "174 minutes", "2 hours"),
        "join": lambda s: followed_by(s.filter("kind = 'view'"), s.filter("kind = 'purchase'"), "user_id", "ts", "event_id", "3 hours", "2 hours"),
    }
    for part in (rows[:25], rows[25:40], rows[40:]):
        stream = feed(part, schema)
        got = {k: run_once(f(stream), f"file://{tmp_path}/{k}") for k, f in kinds.items()}
    feed(rows[:0] or [(9, 999, hours(-5), "view")], schema)  # far too late: no window changes
    got = {k: sorted(map(str, run_once(f(stream), f"file://{tmp_path}/{k}").collect())) for k, f in kinds.items()}
    table = spark.createDataFrame(rows, schema)
    whole = {k: {str(r) for r in f(table).collect()} for k, f in kinds.items()}  # all windows, those still open too
    for k, own in got.items():
        assert len(own) == len(set(own)) and set(own) <= whole[k] and len(own) >= 0.7 * len(whole[k]), k


def test_history_of_contents(spark, feed, tmp_path, monkeypatch):
    """Duplicates within a batch and of all history; history is read only for ranges that the filter lets through; a batch that
    fails between two writes runs again without a trace; contents never meet a shuffle."""
    schema = "path string, content string"
    history = HashHistory(f"file://{tmp_path}/history", bits=1 << 12)
    stream = feed([("a", "x"), ("b", "y"), ("c", "x"), ("n", None), ("e", "")], schema)
    run = lambda: deduplicate(stream, history, f"file://{tmp_path}/history/checkpoint").awaitTermination()
    run()
    feed([(f"new{i}", f"text {i}") for i in range(20)], schema)
    run()
    assert history.read[0] == [] and len(history.read[1]) <= 2  # new contents alone: hardly any range is read
    feed([("d", "y"), ("f", "text 7"), ("g", "z"), ("h", "z"), ("m", None)], schema)
    original, fails = HashHistory._bits_of, iter([False, True])
    monkeypatch.setattr(HashHistory, "_bits_of", lambda self, h: (_ for _ in ()).throw(OSError("lost")) if next(fails, False) else original(self, h))
    with pytest.raises(Exception, match="lost"):
        run()  # after its results and hashes are written
    run()
    got = {r.path: r.duplicate_of for r in history.results(spark).collect()}
    assert got == {"a": None, "b": None, "c": "a", "n": None, "e": None, "d": "b", "f": "new7", "g": None, "h": "g", "m": None} | {f"new{i}": None for i in range(20)}
    assert history.results(spark).count() == len(got)
    many = HashHistory(f"file://{tmp_path}/full", bits=64)  # an overfull filter lets all through and changes nothing
    files = spark.createDataFrame([(str(i), str(i % 30)) for i in range(200)], schema)
    many.add(files, 0)
    assert many.add(files.limit(5).withColumn("path", F.concat(F.lit("z"), "path")), 1).filter("duplicate_of is null").count() == 0


def test_state_goes_by_rows():
    """No frame of pandas is made for a key: a key's rows are put in order as rows, nulls last."""
    from pyspark.sql import Row

    rows = [Row(us=2, event_id=1), Row(us=1, event_id=None), Row(us=1, event_id=5), Row(us=None, event_id=0), Row(us=1, event_id=4)]
    assert [tuple(r) for r in states.in_order(iter(rows))] == [(1, 4), (1, 5), (1, None), (2, 1), (None, 0)]

"""A queue of jobs as a data source of Spark: segments of JSON lines, read by byte ranges, with offsets and commits.

    spark.dataSource.register(JobQueue)
    jobs.write.format("job_queue").mode("append").save("/shared/queue")
    spark.readStream.format("job_queue").load("/shared/queue")

Each write adds numbered segments, which appear only when all tasks have written theirs. A stream's offset is the last segment
it has planned; Spark keeps offsets in its checkpoint, so a restart goes on where it stopped. With option purge, segments are
deleted once the stream has committed what lies in them, as a pop would; a batch that failed before runs again (at least once; with a sink
that replaces a batch's rows, exactly once). The driver lists names and sizes, never bytes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "id string, type string, created_at timestamp, segment long, error string"
SEGMENT = re.compile(r"(\d{12})-\d{5}\.jsonl$")
#: Bytes that a task reads, and that it asks for at once.
SPLIT, BLOCK = 32 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """The lines of a segment that begin at bytes start to before end."""

    path: str
    segment: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; a plain path is one of a folder that all machines share."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def segments(path: str) -> list[tuple[int, str, int]]:
    """Number, path and size of the segments' parts, in their order; a segment counts once its last part is there."""
    fs, folder = opened(path)
    found = [f for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file]
    ready = {int(f.base_name[:12]) for f in found if f.base_name.endswith(".ready")}
    return sorted((int(m[1]), f.path, f.size) for f in found if (m := SEGMENT.search(f.base_name)) and int(m[1]) in ready)


def ranges(found: list[tuple[int, str, int]], split: int) -> list[Range]:
    return [Range(p, number, at, min(size, at + split)) for number, p, size in found for at in range(0, size, split)]


def lines(fs: pafs.FileSystem, part: Range) -> Iterator[bytes]:
    """Lines that begin in the range: what comes before the first line's begin belongs to the range before."""
    with fs.open_input_file(part.path) as f:
        at = max(0, part.start - 1)
        f.seek(at)
        rest, skip = b"", part.start > 0
        while True:
            data = f.read(BLOCK)
            *whole, rest = (rest + data).split(b"\n")
            if not data:
                whole, rest = [rest] if rest else [], b""
            for line in whole:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif begin >= part.end:
                    return
                elif line.strip():
                    yield line
            if not data or at >= part.end and not skip:
                return


def parsed(line: bytes, segment: int) -> tuple:
    """A job, or what is wrong with its line."""
    try:
        job = json.loads(line)
        when = job.get("created_at")
        return job["id"], job["type"], None if when is None else datetime.fromisoformat(when), segment, None
    except (ValueError, KeyError, AttributeError, TypeError) as e:
        return None, None, None, segment, f"{type(e).__name__}: {line[:200].decode(errors='replace')}"


class _Reads:
    def __init__(self, options: dict):
        self.path, self.split, self.purge = options["path"], int(options.get("split", SPLIT)), options.get("purge", "false").lower() == "true"

    def read(self, partition: Range) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for line in lines(fs, partition):
            yield parsed(line, partition.segment)


class QueueReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(segments(self.path), self.split) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return super().read(partition) if partition.path else iter(())


class QueueStreamReader(_Reads, DataSourceStreamReader):
    """Offsets are {"segment": number of the last one taken}; -1 before any."""

    def initialOffset(self) -> dict:
        return {"segment": -1}

    def latestOffset(self) -> dict:
        return {"segment": max((n for n, _, _ in segments(self.path)), default=self.floor())}

    def floor(self) -> int:
        """The last number ever purged, so that offsets never fall."""
        fs, folder = opened(self.path)
        if fs.get_file_info(f"{folder}/purged").type == pafs.FileType.NotFound:
            return -1
        with fs.open_input_stream(f"{folder}/purged") as f:
            return int(f.read())

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges([s for s in segments(self.path) if start["segment"] < s[0] <= end["segment"]], self.split)

    def commit(self, end: dict) -> None:
        if self.purge and end["segment"] > self.floor():
            fs, folder = opened(self.path)
            with fs.open_output_stream(f"{folder}/purged") as f:
                f.write(str(end["segment"]).encode())
            for number, path, _ in segments(self.path):
                if number <= end["segment"]:
                    fs.delete_file(path)
            for f in fs.get_file_info(pafs.FileSelector(folder)):
                if f.base_name.endswith(".ready") and int(f.base_name[:12]) <= end["segment"]:
                    fs.delete_file(f.path)


class QueueWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        """The rows as one file under a name that readers don't see yet."""
        fs, folder = opened(self.path)
        fs.create_dir(f"{folder}/written")
        path, some = f"{folder}/written/{uuid.uuid4().hex}", False
        with fs.open_output_stream(path) as f:
            for row in rows:
                some = True
                job = row.asDict()
                f.write(json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in job.items()}, ensure_ascii=False).encode() + b"\n")
        if not some:
            fs.delete_file(path)
        return Written(path if some else None)

    def commit(self, messages: list) -> None:
        """All tasks' files become the next segment's parts. One job writes to a queue at a time."""
        fs, folder = opened(self.path)
        reader = QueueStreamReader({"path": self.path})
        number = reader.latestOffset()["segment"] + 1
        for f in fs.get_file_info(pafs.FileSelector(folder)):  # parts of a write that was lost before its mark
            if f.is_file and f.base_name.startswith(f"{number:012}-"):
                fs.delete_file(f.path)
        for i, path in enumerate(sorted(m.path for m in messages if m and m.path)):
            fs.move(path, f"{folder}/{number:012}-{i:05}.jsonl")
        with fs.open_output_stream(f"{folder}/{number:012}.ready") as f:
            f.write(b"")

    def abort(self, messages: list) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path)


class JobQueue(DataSource):
    """Options: path; split (bytes a task reads); purge (delete what a stream has committed)."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> QueueReader:
        return QueueReader(self.options)

    def streamReader(self, schema) -> QueueStreamReader:
        return QueueStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> QueueWriter:
        return QueueWriter(self.options)

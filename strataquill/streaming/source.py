"""The event log of jobs as a streaming source: one file of lines for each job, and an offset in bytes for each.

A job appends lines to ``<path>/<job>.jsonl``. An offset of the stream is the number of bytes read of each job's file, always at
the end of a line, so a line that is being written waits for the next batch. The stream's checkpoint keeps the offsets; a
restarted stream goes on where the last batch ended and reads nothing twice. Files can be on any file system that Arrow opens. The
driver looks at the names and sizes of files and at the end of those that grew; events are read in tasks, many small files to one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

ENDING, TAIL = ".jsonl", 1 << 16
TASK_BYTES = 16 << 20


@dataclass
class Slices(InputPartition):
    """(job, first byte, byte after the last) of some jobs."""

    parts: list[tuple[str, int, int]]


class JobEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_events"

    def schema(self) -> str:
        return "job_id string, position long, event string"

    def streamReader(self, schema: StructType) -> JobEventsReader:  # noqa: N802  Spark's name
        return JobEventsReader(self.options["path"])


class JobEventsReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.known = path, {}

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        where, top = self._open()
        for f in where.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            job = f.base_name.removesuffix(ENDING)
            if f.is_file and f.base_name.endswith(ENDING) and f.size > self.known.get(job, 0):
                self.known[job] = self._last_line(where, f.path, self.known.get(job, 0), f.size)
        return dict(self.known)

    @staticmethod
    def _last_line(where: fs.FileSystem, path: str, start: int, end: int) -> int:
        """The place after the last line that is whole, from the end backwards."""
        with where.open_input_file(path) as f:
            while end > start:
                a = max(start, end - TAIL)
                at = f.read_at(end - a, a).rfind(b"\n")
                if at >= 0:
                    return a + at + 1
                end = a
        return start

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out, held = [Slices([])], 0
        for job in sorted(end):
            a, z = start.get(job, 0), end[job]
            if z > a:
                if held and held + z - a > TASK_BYTES:
                    out.append(Slices([]))
                    held = 0
                out[-1].parts.append((job, a, z))
                held += z - a
        return [p for p in out if p.parts]

    def read(self, partition: Slices) -> Iterator[tuple]:
        where, top = self._open()
        for job, a, z in partition.parts:
            with where.open_input_file(f"{top}/{job}{ENDING}") as f:
                f.seek(a)
                left, at = z - a, a
                rest = b""
                while left > 0:
                    data = f.read(min(left, 1 << 20))
                    left -= len(data)
                    *whole, rest = (rest + data).split(b"\n")
                    for line in whole:
                        yield job, at, line.decode("utf-8", "replace")
                        at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all jobs below ``path`` as a stream: job_id, position (first byte of the line), event (its text)."""
    spark.dataSource.register(JobEvents)
    return spark.readStream.format("job_events").option("path", path).load()


def append(path: str, job: str, events: list[dict]) -> None:
    """Appends events to the log of a job; for one writer per job."""
    where, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    where.create_dir(top)
    with where.open_append_stream(f"{top}/{job}{ENDING}") as f:
        f.write(b"".join(json.dumps(e, sort_keys=True).encode() + b"\n" for e in events))

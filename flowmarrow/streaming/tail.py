"""Text files that grow, as a stream: every complete line once, whenever it is written and however often the query restarts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
CHUNK = 1 << 20
BATCH_LINES = 10_000


def place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(path)


def line_end(file, start: int, stop: int) -> int:
    """The place after the last line break in [start, stop), or ``start``."""
    while stop > start:
        begin = max(start, stop - CHUNK)
        at = file.read_at(stop - begin, begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        stop = begin
    return start


def next_line(file, at: int, stop: int) -> int:
    """The first place at or after ``at`` where a line begins, ``stop`` if there is none before."""
    if at == 0:
        return 0
    at -= 1
    while at < stop:
        data = file.read_at(min(CHUNK, stop - at), at)
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return stop


@dataclass
class Lines(InputPartition):
    """The lines of a file that begin in [start, end); ``stop`` is the end of its complete lines."""

    path: str
    start: int
    end: int
    stop: int


class GrowingReader(DataSourceStreamReader):
    """Offsets are the bytes taken of every file, always at the end of a line."""

    def __init__(self, path: str, header: bool, range_bytes: int):
        self.path, self.header, self.range_bytes = path, header, range_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, at = place(self.path)
        info = fs.get_file_info(at)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        found = {}
        for f in files:
            if f.is_file and not f.base_name.startswith((".", "_")):
                with fs.open_input_file(f.path) as file:
                    found[f.path] = line_end(file, 0, f.size)
        return found

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for path, stop in sorted(end.items()):
            taken = start.get(path, 0)
            if stop < taken:
                raise ValueError(f"{path} has become shorter: {taken} bytes were taken, {stop} are left")
            out += [Lines(path, a, min(a + self.range_bytes, stop), stop) for a in range(taken, stop, self.range_bytes)]
        return out

    def read(self, part: Lines) -> Iterator[pa.RecordBatch]:
        fs, _ = place(self.path)
        with fs.open_input_file(part.path) as file:
            at, rest, lines = next_line(file, part.start, part.stop), b"", []
            begin = at
            while begin < part.end:
                data = file.read_at(min(CHUNK, part.stop - at), at)
                if not data:
                    break
                at += len(data)
                *whole, rest = (rest + data).split(b"\n")
                for line in whole:
                    if begin < part.end and (begin or not self.header):
                        lines.append(line.removesuffix(b"\r"))
                    begin += len(line) + 1
                if len(lines) >= BATCH_LINES:
                    yield self._batch(lines)
                    lines = []
            if lines:
                yield self._batch(lines)

    @staticmethod
    def _batch(lines: list[bytes]) -> pa.RecordBatch:
        text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
        return pa.RecordBatch.from_arrays([text], ["value"])


class GrowingText(DataSource):
    """``spark.readStream.format("growing")`` with options ``path`` (a file or a folder), ``header`` and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> GrowingReader:
        options = self.options
        header = options.get("header", "false").lower() == "true"
        return GrowingReader(options["path"], header, int(options.get("range_bytes", RANGE_BYTES)))


def tail_growing_csv(
    spark: SparkSession, path: str, schema: str, header: bool = True, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Rows of CSV files that are appended to, as a stream.

    A line counts when its line break is there, so a half-written one waits. The checkpoint holds the bytes taken of every
    file; a restart goes on from there. Cells do not contain line breaks. A file that becomes shorter fails the query.
    """
    spark.dataSource.register(GrowingText)
    reader = spark.readStream.format("growing").option("header", header).option("range_bytes", range_bytes)
    return reader.load(path).select(F.from_csv("value", schema).alias("row")).select("row.*")

"""A log as a stream of its own offsets: format("cue_log").

A log is a folder of files of JSON lines, each named by the sequence number of its first line (000...042.jsonl) and appended to;
lines are numbered on from there. The stream's offset is the last sequence number delivered: `after` says where to begin, a
batch opens only the files that its numbers lie in, and a restart goes on after what its checkpoint holds. A last line without
an end is still being written and waits. Rows: sequence, line. The path is one that pyarrow's file systems reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cueflow.sources.files import _place


@dataclass
class Part(InputPartition):
    path: str
    first: int
    after: int
    until: int


def _files(path: str) -> list[tuple[int, str]]:
    where, root = _place(path)
    found = [x for x in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".jsonl") and x.base_name[:-6].isdigit()]
    return sorted((int(x.base_name[:-6]), x.path) for x in found)


def _lines(path: str, file: str) -> Iterator[str]:
    """The whole lines of a file, a piece at a time."""
    left = b""
    with _place(path)[0].open_input_stream(file) as f:
        while piece := f.read(1 << 20):
            *whole, left = (left + piece).split(b"\n")
            yield from (x.decode("utf-8", "replace") for x in whole)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.after = options["path"], int(options.get("after", 0))

    def initialOffset(self) -> dict:
        return {"sequence": self.after}

    def latestOffset(self) -> dict:
        found = _files(self.path)
        last = found[-1][0] - 1 + sum(1 for _ in _lines(self.path, found[-1][1])) if found else 0
        return {"sequence": max(self.after, last)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """The files between two offsets; a file ends where the next begins."""
        found, after, until = _files(self.path), start["sequence"], end["sequence"]
        ends = [n - 1 for n, _ in found[1:]] + [until]
        return [Part(path, first, after, until) for (first, path), last in zip(found, ends) if last > after and first <= until]

    def read(self, partition: Part) -> Iterator[tuple]:
        for sequence, line in enumerate(_lines(self.path, partition.path), partition.first):
            if sequence > partition.until:
                return
            if sequence > partition.after:
                yield sequence, line

    def commit(self, end: dict) -> None:
        pass


class LogTable(DataSourceReader):
    """The same, read once."""

    def __init__(self, options: dict):
        self.stream = LogStream(options)

    def partitions(self) -> list[Part]:
        return self.stream.partitions(self.stream.initialOffset(), self.stream.latestOffset()) or [Part("", 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.path:
            yield from self.stream.read(partition)


class CueLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cue_log"

    def schema(self) -> str:
        return "sequence long, line string"

    def reader(self, schema) -> LogTable:
        return LogTable({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> LogStream:
        return LogStream({k.lower(): v for k, v in self.options.items()})


def entries(spark: SparkSession, path: str, after: int = 0, stream: bool = False) -> DataFrame:
    """sequence, line of a log's entries past `after`, as a table or as a stream."""
    spark.dataSource.register(CueLog)
    return (spark.readStream if stream else spark.read).format("cue_log").option("after", after).load(path)

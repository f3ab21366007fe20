"""Subtitle files as a Spark source and sink: format("cues").

Reading gives a row (source, payload) for each file of a folder, source being the name without its ending; files are dealt to
tasks by size, and a filter on source (equal to, or in a list) opens no other file. `read_folder` parses them with the
payload parsers. Writing takes (source, block) with a source's blocks together and in order, streams them to a file of the
task's attempt in a hidden folder, and moves the files to their names when all tasks have ended; a failed job leaves
nothing behind. Neither side holds more than a file (reading) or a block (writing). The path is one that pyarrow's file
systems reach from the driver and the executors alike.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from cueflow.operators import render
from cueflow.sources import parse

PARTITION_BYTES, FILE_BYTES = 32 << 20, 1 << 16


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else f"file://{path[5:]}")


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    files: list


def deal(files: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Files in order of size to the partition with the least in it, as many partitions as their bytes need; a file counts for
    FILE_BYTES more than it has, for its opening."""
    weigh = lambda n: n + FILE_BYTES
    parts = [[0, []] for _ in range(max(1, min(len(files), -(-sum(weigh(n) for _, n in files) // most))))]
    for path, n in sorted(files, key=lambda f: (-f[1], f[0])):
        least = min(parts, key=lambda p: p[0])
        least[0] += weigh(n)
        least[1].append(path)
    return [p[1] for p in parts if p[1]]


class CueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most, self.wanted = options["path"], int(options.get("partitionbytes", PARTITION_BYTES)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source",):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted = some if self.wanted is None else self.wanted & some
            else:
                yield f

    def partitions(self) -> list[Files]:
        where, root = _place(self.path)
        found = [(x.path, x.size) for x in where.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        return [Files(p) for p in deal([f for f in found if self.wanted is None or _source(f[0]) in self.wanted], self.most)]

    def read(self, partition: Files) -> Iterator[tuple]:
        where, _ = _place(self.path)
        for path in partition.paths if partition else []:
            with where.open_input_stream(path) as f:
                yield _source(path), f.read().decode("utf-8-sig", "replace")


def _source(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


class CueWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.ending, self.overwrite = options["path"], options.get("ending", "srt"), overwrite
        self.hidden = f"_cues-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        where, root = _place(self.path)
        task, done, now, out = TaskContext.get(), set(), None, None
        own = f"{root}/{self.hidden}/{task.partitionId()}-{task.taskAttemptId()}"
        try:
            for r in rows:
                if r["source"] != now or out is None:
                    if out is not None:
                        out.close()
                    now = r["source"]
                    if now is None or now in done or "/" in now or now.startswith(("_", ".")):
                        raise ValueError(f"a source needs a name of its own that can be a file's, with its blocks together: {now}")
                    done.add(now)
                    where.create_dir(own)
                    out = where.open_output_stream(f"{own}/{now}.{self.ending}")
                out.write(f"{r['block']}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Written([f"{own}/{name}.{self.ending}" for name in sorted(done)])

    def commit(self, messages: list) -> None:
        where, root = _place(self.path)
        where.create_dir(root)
        files = [path for m in messages if m is not None for path in m.files]
        names = [posixpath.basename(f) for f in files]
        there = {x.base_name for x in where.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File}
        if len(set(names)) < len(names) or (not self.overwrite and there & set(names)):
            self.abort(messages)
            raise ValueError("two files of one name")
        for path, name in zip(files, names):
            where.move(path, f"{root}/{name}")
        for name in (there - set(names)) if self.overwrite else ():
            where.delete_file(f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Removes what is hidden."""
        where, root = _place(self.path)
        if where.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.hidden}")


class CueFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cues"

    def schema(self) -> str:
        return "source string, payload string"

    def reader(self, schema) -> CueReader:
        return CueReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> CueWriter:
        if not {"source", "block"} <= set(schema.names):
            raise ValueError("needs the columns source and block")
        return CueWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("cues") known to a session and turns on Spark's filter push-down for such sources, which it needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CueFiles)


def write_folder(cues: DataFrame, path: str, source: str, order: list[Column], accept: Column | None = None, mode: str = "append") -> None:
    """A numbered SRT file for each source. Its blocks lie together in one task, sorted by Spark; no row holds a file."""
    register(cues.sparkSession)
    blocks = render.srt_blocks(cues, [source], order, accept).select(F.col(source).cast("string").alias("source"), "no", "block")
    blocks.repartition("source").sortWithinPartitions("source", "no").write.format("cues").mode(mode).save(path)


def read_folder(spark: SparkSession, path: str, *conditions: Column, **options) -> DataFrame:
    """source_id (the file's name), ord, start, end, text of a folder's files; conditions on source choose files."""
    register(spark)
    files = spark.read.format("cues").options(**options).load(path)
    for c in conditions:
        files = files.filter(c)
    return parse.read_cues(files.withColumnRenamed("source", "source_id"))

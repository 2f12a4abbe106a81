"""Whole files as rows: a data source that reads a folder by file or by ranges of bytes, and writes files that a job commits together.

A task reads as many neighbouring files or ranges as amount to its share of bytes, so many small files are few tasks and a long one is many.
Tasks write below a folder of the job; only when all of them have ended are files moved to their names, each by one rename. A job that
fails leaves nothing. A name that is there already or stands twice fails the job, unless it overwrites; protected names always do.
"""

from __future__ import annotations

import fnmatch
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from timeloom.sources.srt import is_protected

FORMAT = "timeloom_files"
ROWS = "path string, name string, offset bigint, size bigint, content binary, head binary"
#: Bytes that a task reads at most where its ranges are shorter, and what opening a file counts for.
TASK_BYTES, OPEN_BYTES = 16 << 20, 64 << 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1) if path.startswith("file:/") else path)


@dataclass
class Ranges(InputPartition):
    """(path, size of the file, first, last) of each range that a task reads."""

    parts: list[tuple[str, int, int, int]]


def dealt(parts: list[tuple[str, int, int, int]], head: int, tasks: int) -> list[Ranges]:
    """Ranges in order, put together up to a task's share: all bytes over `tasks`, at most TASK_BYTES."""
    costs = [OPEN_BYTES + min(head, size) + last - first for _, size, first, last in parts]
    share, held, out = min(TASK_BYTES, sum(costs) / tasks), 0, []
    for part, cost in zip(parts, costs):
        if not out or held + cost > share:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(part)
        held += cost
    return out


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern, self.step, self.head = options["path"], options.get("pattern", "*"), int(options.get("rangebytes", 0)), int(options.get("headbytes", 0))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[Ranges]:
        """The ranges of all files, dealt to tasks; only the listing is read here."""
        system, root = opened(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and fnmatch.fnmatch(x.base_name, self.pattern) and not x.base_name.startswith(("_", ".")) and "/_" not in x.path[len(root) :]]
        step = lambda x: self.step or max(x.size, 1)
        parts = [(x.path, x.size, a, min(a + step(x), x.size)) for x in sorted(found, key=lambda x: x.path) for a in range(0, max(x.size, 1), step(x))]
        return dealt(parts, self.head, self.tasks) or [Ranges([])]

    def read(self, task: Ranges) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path, parts in itertools.groupby(task.parts, key=lambda x: x[0]):
            with system.open_input_file(path) as file:
                head = file.read(self.head) if self.head else None
                for _, size, first, last in parts:
                    file.seek(first)
                    yield path, path.rpartition("/")[2], first, size, file.read(last - first), head


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite or options.get("replace", "false").lower() == "true", f"_job-{uuid.uuid4().hex}"
        system, root = opened(self.path)
        system.create_dir(f"{root}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"  # of this attempt alone; not made where the job has been given up
        system.create_dir(folder, recursive=False)
        names = []
        for batch in iterator:
            at = batch.schema.names
            for name, content in zip(batch.column(at.index("name")).to_pylist(), batch.column(at.index("content")).to_pylist()):
                if not name or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"no name for a file: {name!r}")
                if is_protected(name):
                    raise ValueError(f"refusing to write {name}")
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.encode() if isinstance(content, str) else content or b"")
                names.append(name)
        return Written(names, folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        done = [(f"{m.folder}/{name}", f"{root}/{name}") for m in messages if m for name in m.names]
        try:
            targets = [to for _, to in done]
            if len(set(targets)) < len(targets):
                raise ValueError("two rows have one name")
            there = [] if self.overwrite else [x.path for x in system.get_file_info(targets) if x.type != fs.FileType.NotFound] if targets else []
            if there:
                raise FileExistsError(f"{len(there)} files are there already, {there[0]} first")
            for source, to in done:
                system.move(source, to)
        finally:
            self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


class Files(DataSource):
    """Options: path; for reading pattern (of names), rangeBytes, headBytes (of the file's beginning, beside each range) and tasks (as many at least, if there are ranges enough); for writing replace."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def read(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = 0, head_bytes: int = 0) -> DataFrame:
    """Rows of ROWS: each file below a path, or each range of so many bytes of it; size is the whole file's."""
    spark.dataSource.register(Files)
    rows = spark.read.format(FORMAT).option("path", path).option("pattern", pattern).option("rangeBytes", range_bytes).option("headBytes", head_bytes)
    return rows.option("tasks", 4 * spark.sparkContext.defaultParallelism).load()


def write(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Files of rows (name, content: text or bytes), all of them or none."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", "content").write.format(FORMAT).option("path", path).option("replace", str(replace).lower()).mode("append").save()

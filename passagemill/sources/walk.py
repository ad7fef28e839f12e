"""Folders and files in tasks: a listing as a Python data source, and the bytes of files.

Spark's own listing hides every name that begins with an underscore, so the
files of a folder are listed here with pyarrow. The driver opens folders only
until there is one for each task; a task then walks the trees it was given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "source_file string, path string, modificationTime timestamp, length bigint"
ROWS = 10_000
# Bytes of files read by one task and sent in one batch, about.
TASK_BYTES = 128 << 20
BATCH_BYTES = 32 << 20
MOST_TASKS = 100_000

# How Hadoop's schemes are called in pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "hdfs": "hdfs", "viewfs": "viewfs", "gs": "gs", "s3": "s3"}
BUCKETS = {"s3", "gs"}


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark itself would read it by."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path in it; names are taken as they are, without escapes."""
    scheme, _, authority, inside = re.fullmatch(r"([A-Za-z][\w+.-]*):(//([^/]*))?(/.*)?", path, re.DOTALL).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), inside or "/"
    if scheme not in SCHEMES:
        raise ValueError(f"files of {scheme}: cannot be opened in a task")
    store, _ = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{authority or ''}/")
    return store, f"{authority}{inside or ''}" if SCHEMES[scheme] in BUCKETS else inside or "/"


def open_file(path: str) -> pa.NativeFile:
    """A stream that can seek."""
    store, inside = store_of(path)
    return store.open_input_file(inside)


def enters(folder: str) -> bool:
    """Whether a folder of this name is walked."""
    return not folder.startswith(".") and folder.lower() != "__macosx"


def children(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    # A folder may go while it is walked.
    return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))


class Folders(InputPartition):
    """Trees to walk, and folders of which only the files are wanted."""

    def __init__(self, trees: list[str], flat: list[str]):
        super().__init__(None)
        self.trees, self.flat = trees, flat


class FolderReader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root.rstrip("/") or "/", tasks

    def partitions(self) -> list[Folders]:
        store, inside = store_of(self.root)
        waiting, flat = [inside], []
        # One level at a time, until there are trees enough.
        while waiting and len(waiting) < self.tasks and len(flat) < 4 * self.tasks:
            below = [x.path for folder in waiting for x in children(store, folder) if x.type == fs.FileType.Directory and enters(x.base_name)]
            flat += waiting
            waiting = below
        n = max(1, min(self.tasks, len(waiting) + len(flat)))
        return [Folders(waiting[i::n], flat[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, inside = store_of(self.root)
        start = len(inside.rstrip("/")) + 1
        rows: list[tuple[str, str, int, int]] = []
        waiting = [(x, False) for x in partition.flat] + [(x, True) for x in partition.trees]
        while waiting:
            folder, deeper = waiting.pop()
            for x in children(store, folder):
                if x.type == fs.FileType.Directory:
                    if deeper and enters(x.base_name):
                        waiting.append((x.path, True))
                elif x.type == fs.FileType.File:
                    name = x.path[start:]
                    # Whole milliseconds, as Spark's file sources have them.
                    rows.append((name, f"{self.root.rstrip('/')}/{name}", (x.mtime_ns or 0) // 1_000_000 * 1000, x.size))
                    if len(rows) >= ROWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    names, paths, times, sizes = zip(*rows)
    columns = [
        pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(times, pa.timestamp("us", "UTC")), pa.array(sizes, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["source_file", "path", "modificationTime", "length"])


class FolderSource(DataSource):
    """``spark.read.format("passagemill_folder").load(root)``: one row per file, hidden names included."""

    @classmethod
    def name(cls) -> str:
        return "passagemill_folder"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("tasks", "8")))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: ``(source_file, path, modificationTime, length)``; folders that are hidden are not entered."""
    spark.dataSource.register(FolderSource)
    tasks = max(8, 2 * spark.sparkContext.defaultParallelism)
    return spark.read.format("passagemill_folder").option("tasks", tasks).load(qualified(spark, root))


def spread_by_bytes(rows: DataFrame, size: Column | str = "length") -> DataFrame:
    """Rows that stand for ``size`` bytes each, dealt to as many tasks as these need."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    # Small files cost an opening each; no task has more bytes than it must, up to a number of tasks.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(total // TASK_BYTES, n // 10_000, min(n, cores), 1)
    return rows.repartition(int(min(tasks, MOST_TASKS)))


def with_content(files: DataFrame) -> DataFrame:
    """Add ``content``, the bytes of each file, read in the task that holds its row."""
    names = [*files.columns, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            paths = batch.column("path").to_pylist()
            for i, path in enumerate(paths):
                with open_file(path) as stream:
                    held.append(stream.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i == len(paths) - 1:
                    some = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(held, pa.binary())], names)
                    first, held, size = i + 1, [], 0

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return spread_by_bytes(files).mapInArrow(run, f"{kinds}, content binary")

"""Files of a large folder, listed and read by tasks: a data source with a partition for each shard folder.

The driver lists folders only as deep as the shards lie (``depth``); what is in them is listed, and if asked for read,
in tasks, so nothing on the driver grows with the number of files. A folder is listed by one task, however many files are
in it; contents are read by other ones, among which the names are dealt. Names that begin with ``_`` or ``.`` are left
out, as Spark's own readers do.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheaf.functions.paths import SERVICE_SUFFIX
from sheaf.session import durable

FORMAT = "sheaf_files"
FILES = "path string, length bigint, content binary"
BATCH_ROWS = 4_096
BATCH_BYTES = 8 << 20
# Files, and bytes, that one task reads.
TASK_FILES = 20_000
TASK_BYTES = 256 << 20
# Tasks, for each core, that list shard folders whose names are written.
LISTING_TASKS = 4


class Shard(InputPartition):
    """One folder, relative to the root; ``deep`` if what lies under its folders belongs to it, too."""

    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


def _join(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def _open(root: str):
    """The file system of a root, and the root's path in it."""
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root.rstrip("/")
    uri = root if "://" in root else "file://" + root.removeprefix("file:")
    system, base = pafs.FileSystem.from_uri(uri)
    return system, base.rstrip("/")


def reachable(root: str) -> bool:
    """Whether ``pyarrow.fs`` knows the file system of a root; Hadoop may know others."""
    try:
        _open(root)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _children(system, path: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is it a folder, length) of what is in a folder; on a local disk one by one, never all at once."""
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(path) as found:
            for entry in found:
                if entry.name[:1] not in ("_", "."):
                    yield entry.name, entry.is_dir(), entry.stat().st_size
        return
    for info in system.get_file_info(pafs.FileSelector(path)):
        if info.base_name[:1] not in ("_", "."):
            yield info.base_name, info.type == pafs.FileType.Directory, info.size


def _batches(system, base: str, files: Iterable[tuple[str, int]], bodies: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (path, length, content) of files; contents are read of those that end in one of ``bodies``."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
    paths, lengths, contents, size = [], [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((paths, lengths, contents), schema)], schema=schema)

    for name, length in files:
        content = None
        if bodies and name.endswith(tuple(bodies)):
            with system.open_input_stream(_join(base, name), compression=None) as file:
                content = file.read()
        paths.append(name)
        lengths.append(length)
        contents.append(content)
        size += len(content or b"")
        if len(paths) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            paths, lengths, contents, size = [], [], [], 0
    if paths:
        yield batch()


class FileReader(DataSourceReader):
    def __init__(self, root: str, depth: int, prefix: str, suffixes: Sequence[str], bodies: Sequence[str]):
        self.root, self.depth, self.prefix = root, depth, prefix
        self.suffixes, self.bodies = tuple(suffixes), tuple(bodies)

    def _within(self, folder: str) -> bool:
        """Whether names that begin with the prefix may lie in the folder."""
        inside = folder + "/"
        return inside.startswith(self.prefix) or self.prefix.startswith(inside)

    def partitions(self) -> list[Shard]:
        system, base = _open(self.root)
        level, shards = [""], []
        for _ in range(self.depth):
            shards += [Shard(folder, False) for folder in level]
            below = []
            for folder in level:
                for child, is_folder, _ in _children(system, _join(base, folder) if folder else base):
                    name = _join(folder, child)
                    if is_folder and self._within(name):
                        below.append(name)
            level = below
        return shards + [Shard(folder, True) for folder in level]

    def _listed(self, system, base: str, partition: Shard) -> Iterator[tuple[str, int]]:
        # Folder by folder: never the names of a whole shard at once.
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            for child, is_folder, length in _children(system, _join(base, folder) if folder else base):
                name = _join(folder, child)
                if is_folder:
                    if partition.deep and self._within(name):
                        todo.append(name)
                elif name.startswith(self.prefix) and (not self.suffixes or name.endswith(self.suffixes)):
                    yield name, length

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        system, base = _open(self.root)
        return _batches(system, base, self._listed(system, base, partition), self.bodies)


class FileSource(DataSource):
    """Options: ``path``, ``depth``, ``prefix``, ``suffixes`` and ``bodies`` (comma-separated; an empty one ends every name)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> FileReader:
        def parts(option: str) -> list[str]:
            value = self.options.get(option)
            return [] if value is None else value.split(",")

        return FileReader(self.options["path"], int(self.options["depth"]), self.options["prefix"], parts("suffixes"), parts("bodies"))


def _files(spark: SparkSession, folder: str, prefix: str, depth: int, suffixes: Sequence[str]) -> DataFrame:
    if depth < 0:
        raise ValueError(f"depth {depth}")
    spark.dataSource.register(FileSource)
    reader = spark.read.format(FORMAT).option("path", folder).option("depth", depth).option("prefix", prefix)
    if suffixes:
        reader = reader.option("suffixes", ",".join(suffixes))
    return reader.load().select("path", "length")


def _with_contents(files: DataFrame, folder: str, bodies: Sequence[str]) -> DataFrame:
    """Adds ``content`` to listed files, null for those that do not end in one of ``bodies``.

    The listing is written, so that the names of a large folder can be dealt among tasks by their number and bytes; a task
    lists several shard folders if there are many, and its names are one file.
    """
    files = durable(files.coalesce(LISTING_TASKS * files.sparkSession.sparkContext.defaultParallelism), "listing")
    sizes = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(ceil(sizes["n"] / TASK_FILES), ceil(sizes["bytes"] / TASK_BYTES), files.sparkSession.sparkContext.defaultParallelism)

    def read(batches):
        system, base = _open(folder)
        listed = (pair for batch in batches for pair in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()))
        return _batches(system, base, listed, bodies)

    return files.repartition(tasks).mapInArrow(read, FILES)


def list_files(spark: SparkSession, folder: str, prefix: str = "", depth: int = 1, suffixes: Sequence[str] = ()) -> DataFrame:
    """``(path, length)`` of the files under a folder, paths relative to it; folders off the prefix are not listed."""
    return _files(spark, folder, prefix, depth, suffixes)


def read_files(spark: SparkSession, folder: str, prefix: str = "", depth: int = 1, suffixes: Sequence[str] = ()) -> DataFrame:
    """``(path, length, content)`` of the files under a folder; a batch holds about 8 MB or one file.

    The folder is listed while the plan is being made.
    """
    return _with_contents(_files(spark, folder, prefix, depth, suffixes), folder, suffixes or ("",))


def read_service_outputs(spark: SparkSession, folder: str, depth: int = 1) -> DataFrame:
    """``(path, body)`` of all services' output files, from one listing; GROBID bodies are not read."""
    bodies = [suffix for service, suffix in SERVICE_SUFFIX.items() if service != "grobid"]
    files = _with_contents(_files(spark, folder, "", depth, list(SERVICE_SUFFIX.values())), folder, bodies)
    return files.select("path", F.decode("content", "utf-8").alias("body"))

"""Real files by path, made from the given tables; the queries run on one machine."""

from __future__ import annotations

import os
import shutil
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from math import ceil

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import delete_path, scratch

# Files and folders on the disk at once, of a lane: a file of a few bytes takes a block, and so does each folder above it.
FILES_AT_ONCE = 150_000
# Leading names of a path that say which task writes the file: what lies below them is that task's alone.
OWNED = 2


def _put(path: str, content: bytes) -> None:
    """Writes a file; one that is there keeps its blocks."""
    file = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        done = 0
        while done < len(content):
            done += os.pwrite(file, content[done:], done)
        if os.fstat(file).st_size != len(content):
            os.ftruncate(file, len(content))
    finally:
        os.close(file)


def _make(path: str, content: bytes) -> None:
    try:
        _put(path, content)
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        _put(path, content)


def _own(paths: Iterable[str]) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(path, highest folder on it that no other path has, names from there on); the folder is the file if all are shared.

    Of a path that comes twice there is no such folder, and it is left out.
    """
    parts = [(path, path.split("/")) for path in paths]
    seen = Counter("/".join(names[:level]) for _, names in parts for level in range(OWNED, len(names) + 1))
    for path, names in parts:
        for level in range(OWNED, len(names) + 1):
            top = "/".join(names[:level])
            if seen[top] == 1:
                yield path, top, tuple(names[level:])
                break


def _drop(path: str) -> None:
    if os.path.isdir(path):
        shutil.rmtree(path)
    elif os.path.lexists(path):
        os.remove(path)


def _renamed(root: str, old: tuple, new: tuple) -> bool:
    """Whether a file, and the folders that only it is in, became those of another one; if not, it is deleted."""
    (_, old_top, old_names), (_, new_top, new_names) = old, new
    at = f"{root}/{new_top}"
    try:
        try:
            os.rename(f"{root}/{old_top}", at)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(at), exist_ok=True)
            os.rename(f"{root}/{old_top}", at)
        for before, after in zip(old_names, new_names):
            os.rename(f"{at}/{before}", f"{at}/{after}")
            at = f"{at}/{after}"
    except OSError:
        _drop(f"{root}/{old_top}")
        return False
    return True


def _replace(root: str, gone: list[str], wanted: dict[str, bytes]) -> None:
    """Files that go become wanted ones where as many folders are theirs alone; others are deleted, and made.

    To make and free inodes and blocks costs a disk far more than to rename them. A task that runs again may find any of
    its files renamed, in whole or in part: what it cannot rename it makes, in place of what is there.
    """
    spare = defaultdict(list)
    owners = {path: (path, top, names) for path, top, names in _own([*gone, *wanted])}
    for path in gone:
        if path in owners:
            spare[len(owners[path][2])].append(owners[path])
        else:
            _drop(f"{root}/{path}")
    for path, content in wanted.items():
        own = owners.get(path)
        if own:
            old = spare[len(own[2])]
            if not (old and _renamed(root, old.pop(), own)):
                _drop(f"{root}/{own[1]}")
        _make(f"{root}/{path}", content)
    for _, top, _ in (old for left in spare.values() for old in left):
        _drop(f"{root}/{top}")


def write_files(rows: DataFrame, folder: str, gone: DataFrame | None = None) -> None:
    """The files of ``(path, content)`` under a folder; those of the paths ``gone`` are there, and go."""
    root = folder.removeprefix("file:")

    def write(part):
        for row in part:
            _make(f"{root}/{row.path}", bytes(row.content))

    def replace(part):
        old, new = [], {}
        for row in part:
            if row.gone:
                old.append(row.path)
            else:
                new[row.path] = bytes(row.content)
        _replace(root, old, new)

    rows = rows.select("path", "content")
    if gone is None:
        rows.foreachPartition(write)
        return
    both = rows.withColumn("gone", F.lit(False)).unionByName(
        gone.select("path", F.lit(b"").alias("content"), F.lit(True).alias("gone"))
    )
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    both.repartition(tasks, F.substring_index("path", "/", OWNED)).foreachPartition(replace)


def drop_files(spark: SparkSession, folder: str) -> None:
    """Deletes what is in a folder, by tasks: folders two levels down, then what is left."""
    root = folder.removeprefix("file:")

    def drop(part):
        for row in part:
            shutil.rmtree(row.path)

    below = [e.path for d in os.scandir(root) if d.is_dir() for e in os.scandir(d.path) if e.is_dir()] if os.path.isdir(root) else []
    if below:
        spark.createDataFrame([(path,) for path in below], "path string").repartition(len(below)).foreachPartition(drop)
    shutil.rmtree(root, ignore_errors=True)


def in_parts(spark: SparkSession, rows: DataFrame, label: str, read: Callable[[str], DataFrame], lanes: int = 1) -> DataFrame:
    """What ``read`` gives of folders with the files of ``(path, content)``: of one with all, or of parts one after the other.

    Above ``FILES_AT_ONCE`` files and folders the files are in parts, drawn by a hash of the path, and those of one part
    become those of the next in its folder. The rows are dealt to the parts once. With more ``lanes`` as many folders have
    a part each, so that files of one are made while those of another are read: of use where few tasks list.
    """
    rows = rows.select("path", "content")
    levels = F.greatest(F.size(F.split("path", "/")) - (OWNED - 1), F.lit(1))
    entries = rows.agg(F.sum(levels)).first()[0] or 0
    if entries <= FILES_AT_ONCE:
        folder = scratch(spark, label)
        write_files(rows, folder)
        return read(folder)
    parts = ceil(entries / FILES_AT_ONCE)
    number = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part")
    dealt = scratch(spark, f"{label}-dealt")
    rows.select("*", number).repartition(parts, "part").write.partitionBy("part").parquet(dealt, compression="zstd")
    table = spark.read.schema("path string, content binary, part int").parquet(dealt)

    def run(lane):
        # Jobs that append to one folder at a time would delete each other's temporary files.
        folder, found = scratch(spark, label), scratch(spark, f"{label}-found")
        gone = schema = None
        for part in range(lane, parts, lanes):
            wanted = table.where(F.col("part") == part)
            write_files(wanted, folder, gone)
            seen = read(folder)
            seen.write.mode("append").parquet(found)
            gone, schema = wanted, seen.schema
        drop_files(spark, folder)
        return found, schema

    with ThreadPoolExecutor(lanes) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(run), lane) for lane in range(min(lanes, parts))]
    found, schemas = zip(*(lane.result() for lane in done))
    delete_path(spark, dealt)
    return spark.read.schema(schemas[0]).parquet(*found)

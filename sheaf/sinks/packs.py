"""Payloads packed many to a file, an index of which file has which path, and reads by path.

``root/data/batch=N`` has the packs, Parquet files of (path, length, content); ``root/index/batch=N`` says which path
is in which of them, and is written last: a batch without it is not there for readers, so that a write that broke
off is simply done again. A path may come again in a later batch, which holds then; twice in one batch is an error.
Payloads without path are left out; a null content is kept.

Appending sends no contents over the network and makes a file for each task. Compaction takes packs with few bytes
that hold and writes them as packs of a chosen size, ordered by path, under a name between the last batch and the
next. It deletes nothing: ``vacuum_packs`` does, when no reader needs the old packs. One writer at a time.

Reading by path looks the paths up in the index and opens only the packs that have them. The driver has the names
of packs, never those of payloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import _file_system, delete_path, lookup_side
from sheaf.sinks.version_log import _folders

PACK = "path string, length bigint, content binary"
ENTRY = "path string, length bigint, pack string, batch string"
PACK_BYTES = 256 << 20


def _publish(spark: SparkSession, root: str, batch: str) -> None:
    """Write the index of a batch whose packs are there; contents are not read."""
    rows = spark.read.schema(PACK).parquet(f"{root}/data/batch={batch}")
    pack = F.concat(F.lit(f"batch={batch}/"), F.col("_metadata.file_name"))
    entries = rows.select("path", "length", pack.alias("pack"))
    twice = entries.groupBy("path").count().where("count > 1").select("path").first()
    if twice:
        raise ValueError(f"{twice.path} is twice in batch {batch}")
    entries.write.mode("overwrite").parquet(f"{root}/index/batch={batch}")


def append_packs(payloads: DataFrame, root: str, batch_id: int) -> None:
    """Write a batch of ``(path, content)``; the same batch again replaces itself."""
    spark, batch = payloads.sparkSession, f"{batch_id:012d}"
    delete_path(spark, f"{root}/index/batch={batch}")
    rows = payloads.where(F.col("path").isNotNull())
    rows = rows.select("path", F.octet_length("content").cast("bigint").alias("length"), "content")
    rows.write.mode("overwrite").parquet(f"{root}/data/batch={batch}")
    _publish(spark, root, batch)


def pack_entries(spark: SparkSession, root: str) -> DataFrame:
    """All entries of the index: (path, length, pack, batch), some of them replaced by later ones."""
    if not _folders(spark, f"{root}/index", "batch"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{root}/index")


def newest_entries(entries: DataFrame) -> DataFrame:
    """One entry for each path: that of the last batch."""
    last = entries.groupBy("path").agg(F.max(F.struct("batch", "pack", "length")).alias("last"))
    return last.select("path", "last.length", "last.pack", "last.batch")


def pack_use(spark: SparkSession, root: str) -> DataFrame:
    """By pack: payloads and bytes in it, and how many of them still hold."""
    entries = pack_entries(spark, root)
    all_ = entries.groupBy("pack").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    held = newest_entries(entries).groupBy("pack").agg(F.count("*").alias("held_n"), F.sum("length").alias("held_bytes"))
    joined = all_.join(held, "pack", "left")
    return joined.na.fill(0, ["held_n", "held_bytes"])


def _open(spark: SparkSession, root: str, packs: list[str]) -> DataFrame:
    """The rows of some packs, with the pack each is in."""
    if not packs:
        return spark.createDataFrame([], f"{PACK}, pack string")
    rows = spark.read.schema(PACK).parquet(*(f"{root}/data/{pack}" for pack in packs))
    pack = F.regexp_extract(F.col("_metadata.file_path"), "(batch=[^/]+/[^/]+)$", 1)
    return rows.select("path", "length", "content", pack.alias("pack"))


def _holding(spark: SparkSession, root: str, packs: list[str]) -> DataFrame:
    """The payloads of some packs that no later batch has replaced.

    Only the replaced ones are looked up, so contents stay where they are read while those are few.
    """
    entries = pack_entries(spark, root)
    last = entries.groupBy("path").agg(F.max("batch").alias("last"))
    inside = entries.where(F.split("pack", "/")[0].isin(sorted({p.split("/")[0] for p in packs})))
    replaced = inside.join(last, "path").where("batch < last").select("path", "pack")
    return _open(spark, root, packs).join(lookup_side(replaced), ["path", "pack"], "left_anti")


def scan_packs(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, content)`` of all payloads; packs of which nothing holds are not opened."""
    packs = [r.pack for r in pack_use(spark, root).where("held_n > 0").select("pack").collect()]
    return _holding(spark, root, sorted(packs)).select("path", "length", "content")


def read_packed(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``(path, length, content)`` of the wanted paths (column ``path``) that are there."""
    paths = lookup_side(wanted.select("path").where(F.col("path").isNotNull()).distinct())
    found = lookup_side(newest_entries(pack_entries(spark, root).join(paths, "path", "left_semi")).select("path", "pack"))
    packs = [r.pack for r in found.select("pack").distinct().collect()]
    return _open(spark, root, sorted(packs)).join(found, ["path", "pack"], "left_semi").select("path", "length", "content")


def compact_packs(spark: SparkSession, root: str, pack_bytes: int = PACK_BYTES) -> int:
    """Write the payloads of packs with less than half of ``pack_bytes`` that hold anew; how many packs that were."""
    due = pack_use(spark, root).where((F.col("held_n") > 0) & (F.col("held_bytes") * 2 < pack_bytes)).collect()
    if len(due) < 2 and all(r.n == r.held_n for r in due):
        return 0
    batch = max(_folders(spark, f"{root}/index", "batch")) + "c"
    number = max(1, -(-sum(r.held_bytes for r in due) // pack_bytes))
    rows = _holding(spark, root, sorted(r.pack for r in due)).select("path", "length", "content")
    if number > 1:
        rows = rows.repartitionByRange(number, "path")
    else:
        rows = rows.repartition(1)
    rows.sortWithinPartitions("path").write.mode("overwrite").parquet(f"{root}/data/batch={batch}")
    _publish(spark, root, batch)
    return len(due)


def vacuum_packs(spark: SparkSession, root: str) -> int:
    """Delete packs of which nothing holds, and batches without index; how many files and folders went."""
    known = _folders(spark, f"{root}/index", "batch")
    gone = [f"batch={b}" for b in _folders(spark, f"{root}/data", "batch") if b not in known]
    system, jvm_path = _file_system(spark, root), spark._jvm.org.apache.hadoop.fs.Path
    unused = [r.pack for r in pack_use(spark, root).where("held_n = 0").select("pack").collect()]
    gone += [pack for pack in unused if system.exists(jvm_path(f"{root}/data/{pack}"))]
    for name in gone:
        delete_path(spark, f"{root}/data/{name}")
    return len(gone)

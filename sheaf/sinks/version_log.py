"""Version events as an append-only log beside the status table, merged when it is read.

The log has a folder for each shard and batch, with the newest event of each uuid and service in the batch. What
holds is the event of the greatest ``seq`` (then version), so events may be there twice, and in any order: writing
a batch again, or a compaction that broke off after any of its steps, changes nothing. The status table itself is
not touched, so that a batch writes bytes for its own events only.

Compaction writes the newest events of a shard's batches as one batch of a new name, after the last of them, and
then deletes those. A reader that listed the files before must read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.paths import shard
from sheaf.operators.status import apply_versions
from sheaf.session import _file_system, delete_path, durable, scratch_scope
from sheaf.sources.status import scan_status_shards

LOG = "seq bigint, uuid string, service string, version string, shard string, batch string"
EVENT = ("seq", "uuid", "service", "version")
_COMPACTED = "c"


def newest_events(events: DataFrame) -> DataFrame:
    """One event for each uuid and service: that of the greatest seq."""
    newest = events.groupBy("uuid", "service").agg(F.max(F.struct("seq", "version")).alias("last"))
    return newest.select("last.seq", "uuid", "service", "last.version")


def _write(events: DataFrame, log: str, batch: Column, digits: int) -> None:
    rows = events.select(*EVENT, shard(F.col("uuid"), digits).alias("shard"), batch.alias("batch"))
    (
        rows.hint("rebalance", F.col("shard"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard", "batch")
        .parquet(log)
    )


def append_versions(events: DataFrame, log: str, batch_id: int, digits: int = 1) -> None:
    """Write a batch of events to the log; the same batch again replaces itself. Events without uuid are left out.

    ``digits`` is how many characters of the uuid name a shard of the log; keep it for all batches of a log.
    """
    _write(newest_events(events.where(F.col("uuid").isNotNull())), log, F.lit(f"{batch_id:012d}"), digits)


def version_log(spark: SparkSession, log: str) -> DataFrame:
    """All events the log has now, some of them repeated or out of date."""
    system = _file_system(spark, log)
    if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(log)):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(log)


def scan_status_merged(spark: SparkSession, path: str, log: str) -> DataFrame:
    """The sharded status table with the log folded in."""
    return apply_versions(scan_status_shards(spark, path), newest_events(version_log(spark, log).select(*EVENT)))


def _folders(spark: SparkSession, path: str, key: str) -> list[str]:
    system, jvm_path = _file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path(path)
    if not system.exists(jvm_path):
        return []
    names = [f.getPath().getName() for f in system.listStatus(jvm_path) if f.isDirectory()]
    return sorted(name.removeprefix(f"{key}=") for name in names if name.startswith(f"{key}="))


def log_sizes(spark: SparkSession, log: str) -> dict[str, dict[str, int]]:
    """Bytes by shard and batch. A few hundred shards, and the batches since they were compacted."""
    system, jvm_path = _file_system(spark, log), spark._jvm.org.apache.hadoop.fs.Path
    return {
        part: {
            batch: system.getContentSummary(jvm_path(f"{log}/shard={part}/batch={batch}")).getLength()
            for batch in _folders(spark, f"{log}/shard={part}", "batch")
        }
        for part in _folders(spark, log, "shard")
    }


def compact_versions(spark: SparkSession, log: str, max_bytes: int = 64 << 20, max_batches: int = 100) -> list[str]:
    """Compact the shards whose batches since the last time have more than so many bytes or folders; which those are."""
    due = {}
    for part, batches in log_sizes(spark, log).items():
        open_ = {b: n for b, n in batches.items() if not b.endswith(_COMPACTED)}
        if open_ and (sum(open_.values()) > max_bytes or len(open_) > max_batches):
            # what a broken compaction left under this name is taken in, and never overwritten
            due[part] = max(b for b in batches if b.startswith(max(open_)))
    if not due:
        return []
    through = F.lit(None).cast("string")
    for part, last in due.items():
        through = F.when(F.col("shard") == part, F.lit(last)).otherwise(through)
    rows = version_log(spark, log).where(F.col("shard").isin(list(due))).withColumn("through", through)
    rows = rows.where(F.col("batch") <= F.col("through"))
    newest = rows.groupBy("uuid", "service", "through").agg(F.max(F.struct("seq", "version")).alias("last"))
    with scratch_scope(spark):
        # Written apart first: the log is read and written.
        newest = durable(newest.select("last.seq", "uuid", "service", "last.version", "through"), "newest")
        digits = len(next(iter(due)))
        _write(newest, log, F.concat("through", F.lit(_COMPACTED)), digits)
    for part, last in due.items():
        for batch in _folders(spark, f"{log}/shard={part}", "batch"):
            if batch <= last:
                delete_path(spark, f"{log}/shard={part}/batch={batch}")
    return sorted(due)


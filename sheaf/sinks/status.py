"""Writes of the status table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.paths import SERVICES, shard
from sheaf.operators.status import apply_versions, upsert_status
from sheaf.schemas import STATUS
from sheaf.session import durable
from sheaf.sources.status import scan_status_shards


def export_status_csv(status: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headerless gzipped CSV in the table's column order."""
    (
        status.select(*STATUS.names)
        .write.mode(mode)
        .option("compression", "gzip")
        .option("header", False)
        .option("escape", '"')
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )


DEFAULT_DIGITS = 2


def shard_digits(spark: SparkSession, path: str, digits: int | None = None) -> int:
    """Characters of a shard's name in the table at ``path``; another number in ``digits`` is an error.

    Read from the names of the table's folders. A table that is not there yet gets ``digits``, or two.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    found = {len(name.removeprefix("shard=")) for name in names if name.startswith("shard=") and "__HIVE" not in name}
    if len(found) > 1:
        raise ValueError(f"{path} has shards of different widths: {sorted(found)}")
    (width,) = found or (digits or DEFAULT_DIGITS,)
    if digits and digits != width:
        raise ValueError(f"{path} has shards of {width} characters, not {digits}")
    return width


def write_status_shards(status: DataFrame, path: str, digits: int | None = None) -> None:
    """Write the rows' shards, replacing those shards and no other.

    A table keeps the width of shards it was first written with (two characters by default).
    """
    digits = shard_digits(status.sparkSession, path, digits)
    (
        status.select(*STATUS.names, shard(F.col("uuid"), digits).alias("shard"))
        .hint("rebalance", F.col("shard"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )


def _touched(rows: DataFrame, digits: int) -> list[str]:
    # A few hex characters: 256 values for two.
    shards = rows.select(shard(F.col("uuid"), digits).alias("shard")).distinct()
    return [row["shard"] for row in shards.collect()]


def upsert_status_shards(spark: SparkSession, path: str, incoming: DataFrame, digits: int | None = None) -> None:
    """Upsert into a sharded table, reading and rewriting only the shards of the new rows."""
    digits = shard_digits(spark, path, digits)
    current = scan_status_shards(spark, path, _touched(incoming, digits))
    write_status_shards(upsert_status(current, incoming), path, digits)


LAST_SEQ = [f"{service}_seq" for service in SERVICES]


def apply_versions_shards(
    spark: SparkSession, path: str, events: DataFrame, digits: int | None = None, seqs: str | None = None
) -> None:
    """Fold version events into a sharded table, rewriting only the shards they touch.

    Running the same events again gives the same table. With ``seqs``, the path of a table beside it
    with the same shards, the last ``seq`` taken for each uuid and service is kept, and only events
    after it are folded in, so that events may come in any order. That table is written last: if a run
    breaks off in between, its events are folded in once more.
    """
    digits = shard_digits(spark, path, digits)
    touched = _touched(events, digits)
    current = scan_status_shards(spark, path, touched)
    if seqs is None:
        write_status_shards(apply_versions(current, events), path, digits)
        return
    kind = dict(events.dtypes)["seq"]
    layout = f"uuid string, {', '.join(f'{c} {kind}' for c in LAST_SEQ)}, shard string"
    spark.createDataFrame([], layout.rpartition(",")[0]).write.mode("ignore").parquet(f"{seqs}/shard=none")
    last = spark.read.schema(layout).parquet(seqs).where(F.col("shard").isin(touched)).drop("shard")
    taken = F.coalesce(*[F.when(F.col("service") == s, F.col(f"{s}_seq")) for s in SERVICES])
    newer = events.join(last, "uuid", "left").where(taken.isNull() | (F.col("seq") > taken)).select(*events.columns)
    newer = durable(newer, "newer")
    newest = newer.groupBy("uuid").agg(
        *[F.max(F.when(F.col("service") == s, F.col("seq"))).alias(f"new_{s}") for s in SERVICES]
    )
    merged = last.join(newest, "uuid", "full_outer").select(
        "uuid", *[F.coalesce(f"new_{s}", f"{s}_seq").alias(f"{s}_seq") for s in SERVICES]
    )
    merged = durable(merged.withColumn("shard", shard(F.col("uuid"), digits)), "seqs")
    write_status_shards(apply_versions(current, newer), path, digits)
    merged.hint("rebalance", F.col("shard")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "shard"
    ).parquet(seqs)

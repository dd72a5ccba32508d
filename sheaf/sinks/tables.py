"""Manifests, metadata, ledgers, payloads and class lists as partitioned datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.paths import shard, uuid_from_path
from sheaf.operators.coverage import class_lists
from sheaf.operators.index import slice_ids
from sheaf.schemas import PUBLICATION
from sheaf.sources.publications import parse_lines, scan_lines


def _by_shard(df: DataFrame, column: str) -> DataFrame:
    """Few files per partition value: rows of a value go together, and a value too large for one
    task is split by the adaptive rebalance."""
    return df.hint("rebalance", F.col(column))


def write_manifest(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as gzipped JSON lines."""
    records.write.mode(mode).option("compression", "gzip").option("ignoreNullFields", False).json(path)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Raw lines, unchanged, gzipped."""
    lines.select("value").write.mode(mode).option("compression", "gzip").text(path)


def write_metadata(
    entries: DataFrame, path: str, digits: int = 2, mode: str = "errorifexists"
) -> None:
    """One JSON object per publication, in folders by the first characters of the id."""
    rows = entries.select(
        shard(F.col("id"), digits).alias("shard"), F.to_json(F.struct(*entries.columns)).alias("value")
    )
    _by_shard(rows, "shard").write.mode(mode).partitionBy("shard").option("compression", "gzip").text(path)


def write_payloads(
    payloads: DataFrame,
    path: str,
    codec: str = "gzip",
    digits: int = 2,
    exchange: bool = False,
    mode: str = "errorifexists",
) -> None:
    """``(path, content)`` as compressed binary, in folders by the first characters of the id.

    Every task writes what it holds to all folders, so that contents are not sent over the network;
    ``exchange=True`` sends them first, for fewer and larger files.
    """
    rows = payloads.withColumn("shard", shard(uuid_from_path(F.col("path")), digits))
    if exchange:
        rows = _by_shard(rows, "shard")
    rows.write.mode(mode).partitionBy("shard").option("compression", codec).parquet(path)


def write_dump(
    spark: SparkSession, paths: str | Sequence[str], path: str, schema=PUBLICATION, mode: str = "errorifexists", bad_lines: str = "fail"
) -> None:
    """A dump as Parquet: the raw line, the parsed fields, and the columns that keep its order.

    Lines that are not JSON fail the job; with ``bad_lines="keep"`` they are in a column ``_corrupt_record``.

    A gzip file is read by one task, once; from then on readers take the columns they need from many.
    """
    parse_lines(scan_lines(spark, paths), schema, bad_lines).write.mode(mode).parquet(path)


def write_slices(
    indexed: DataFrame, total: int, path: str, mode: str = "complete", index: str = "idx", save: str = "errorifexists"
) -> None:
    """All slices of indexed rows in one pass, one folder for each; see :func:`sheaf.operators.index.slice_ids`.

    Slices have about equal sizes; one too large for a task is split by the adaptive rebalance.
    """
    _by_shard(slice_ids(indexed, total, mode, index), "slice_id").write.mode(save).partitionBy("slice_id").parquet(path)


def write_class_lists(classified: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """DOIs by class, in one folder per class; with ``append`` a run adds to what is there.

    Parquet, as a CSV of one column cannot tell a null DOI from an empty line.
    """
    _by_shard(class_lists(classified), "class").write.mode(mode).partitionBy("class").parquet(path)


def write_ledgers(
    ledger: DataFrame, failures: DataFrame, folder: str, mode: str = "errorifexists"
) -> None:
    """The ledger of all attempted entries and that of the failed ones."""
    ledger.write.mode(mode).parquet(f"{folder}/entries")
    failures.write.mode(mode).parquet(f"{folder}/failures")

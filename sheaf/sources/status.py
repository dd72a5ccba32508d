"""The status table, as Parquet, as the headerless CSV export, or over JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.schemas import STATUS

# Fixed value: timestamp text of the CSV export.
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
# Stands for an unquoted empty field while parsing, so that a quoted one stays an empty string.
NO_VALUE = "\u0001"


def scan_status(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Status rows from Parquet; columns are read by name and pruned in the scan.

    Files from before a column was added give null in it.
    """
    return spark.read.schema(STATUS).parquet(path).select(*(columns or STATUS.names))


def scan_status_csv(spark: SparkSession, path: str) -> DataFrame:
    """Status rows from a headerless, usually gzipped, CSV export."""
    return (
        spark.read.schema(STATUS)
        .option("header", False)
        .option("escape", '"')
        .option("nullValue", NO_VALUE)
        .option("timestampFormat", CSV_TIMESTAMP)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def uuid_ranges(column: str = "uuid") -> list[str]:
    """Sixteen conditions, one per leading hex digit, that every row meets exactly one of."""
    digits = "0123456789abcdef"
    low = [f"({column} < '1' or {column} is null)"]
    middle = [f"({column} >= '{a}' and {column} < '{b}')" for a, b in zip(digits[1:], digits[2:])]
    return [*low, *middle, f"({column} >= 'f')"]


def scan_status_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    """Status rows over JDBC, in sixteen reads split on the uuid's first digit."""
    return spark.read.jdbc(url, table, predicates=uuid_ranges(), properties=properties or {}).select(
        *STATUS.names
    )


def scan_status_shards(spark: SparkSession, path: str, shards: Sequence[str] | None = None) -> DataFrame:
    """Status rows of a table written by shard; given shards are pruned to their folders."""
    layout = T.StructType([*STATUS, T.StructField("shard", T.StringType())])
    table = spark.read.schema(layout).parquet(path)
    if shards is not None:
        table = table.where(F.col("shard").isin(list(shards)))
    return table.select(*STATUS.names)

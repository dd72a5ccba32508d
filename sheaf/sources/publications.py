"""Publication dumps: JSON lines, plain or compressed, one file or many."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.schemas import PUBLICATION
from sheaf.session import _file_system

CORRUPT = "_corrupt_record"
COUNTRY = "bso_country_corrected"
# Columns that put the records of a positioned scan in dump order: file, block, place in the block.
DUMP_ORDER = ["source_file", "block_start", "scan_seq"]

# Bytes of dump files, mostly compressed, to a partition of spread rows.
SPREAD_BYTES = 16 << 20


def _total_bytes(spark: SparkSession, paths: str | Sequence[str]) -> int:
    total = 0
    for path in [paths] if isinstance(paths, str) else paths:
        system = _file_system(spark, path)
        for found in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) or []:
            total += system.getContentSummary(found.getPath()).getLength()
    return total


def _positions():
    return [
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("scan_seq"),
    ]


def scan_publications(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = PUBLICATION,
    bad_lines: str = "fail",
    spread: int | None = None,
    position: bool = False,
) -> DataFrame:
    """Records of one or more dumps; paths may hold globs.

    Only the fields of ``schema`` are parsed. A country that is not an array is null, so the country
    filter drops the record. ``bad_lines="keep"`` puts lines that are not JSON in
    ``_corrupt_record`` instead of failing. A gzip file is read by one task: ``spread`` shuffles
    its rows over that many partitions before heavier work, or over one for each ``SPREAD_BYTES`` of the files if
    those are more. ``position`` adds the ``DUMP_ORDER``
    columns, which need no shuffle.
    """
    if bad_lines not in ("fail", "keep"):
        raise ValueError(f"unknown treatment of bad lines {bad_lines!r}")
    reader = spark.read
    wanted, schema = schema, T.StructType([T.StructField(f.name, T.StringType()) if f.name == COUNTRY else f for f in schema])
    if bad_lines == "fail":
        reader = reader.schema(schema).option("mode", "FAILFAST")
    else:
        reader = (
            reader.schema(T.StructType([*schema, T.StructField(CORRUPT, T.StringType())]))
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
        )
    records = reader.json(list(paths) if not isinstance(paths, str) else paths)
    if COUNTRY in wanted.names:
        # Read as text first: an array comes as its JSON, anything else does not parse as an array.
        records = records.withColumn(COUNTRY, F.from_json(COUNTRY, wanted[COUNTRY].dataType))
    if position:
        records = records.select("*", *_positions())
    return records.repartition(max(spread, ceil(_total_bytes(spark, paths) / SPREAD_BYTES))) if spread else records


def scan_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw lines with their place: ``value`` and the ``DUMP_ORDER`` columns.

    The raw line is what to write back when records must stay unchanged.
    """
    return spark.read.text(list(paths) if not isinstance(paths, str) else paths).select(
        "value", *_positions()
    )


def parse_lines(lines: DataFrame, schema: T.StructType = PUBLICATION, bad_lines: str = "fail") -> DataFrame:
    """Parse the wanted fields of raw lines, which stay in ``value``; blank lines have null fields.

    Lines that are not JSON fail the job, or are in ``_corrupt_record`` with ``bad_lines="keep"``. The country is
    read as by :func:`scan_publications`.
    """
    if bad_lines not in ("fail", "keep"):
        raise ValueError(f"unknown treatment of bad lines {bad_lines!r}")
    others, options = [c for c in lines.columns], {"mode": "FAILFAST"}
    read = T.StructType([T.StructField(f.name, T.StringType()) if f.name == COUNTRY else f for f in schema])
    if bad_lines == "keep":
        read = T.StructType([*read, T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

    def field(name: str):
        column = F.col(f"__r.{name}")
        return (F.from_json(column, schema[name].dataType) if name == COUNTRY else column).alias(name)

    return lines.withColumn("__r", F.from_json("value", read, options)).select(*others, *map(field, read.names))


def scan_dump(spark: SparkSession, path: str, schema: T.StructType = PUBLICATION) -> DataFrame:
    """A dump written as Parquet: raw line, ``DUMP_ORDER`` columns and parsed fields; unused ones are not read."""
    order = [T.StructField("source_file", T.StringType()), T.StructField("block_start", T.LongType()), T.StructField("scan_seq", T.LongType())]
    return spark.read.schema(T.StructType([T.StructField("value", T.StringType()), *order, *schema])).parquet(path)


def count_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of the dumps; a missing path fails."""
    return spark.read.text(list(paths) if not isinstance(paths, str) else paths).agg(
        F.count("*").alias("n")
    )

"""Object listings, payloads and the files enrichment services wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.paths import SERVICE_SUFFIX
from sheaf.sources import listing


def scan_objects(spark: SparkSession, inventory: str, prefix: str = "") -> DataFrame:
    """Object names from a Parquet inventory with column ``path``; the prefix reaches the scan."""
    objects = spark.read.schema("path string").parquet(inventory)
    return objects.where(F.startswith("path", F.lit(prefix))) if prefix else objects


def scan_folder(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Names of the files under a folder, relative to it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = F.lit(folder.rstrip("/") + "/")
    full = F.col("path")
    relative = F.substring(full, F.locate(folder.rstrip("/") + "/", full) + F.length(root), F.length(full))
    names = files.select(relative.alias("path"))
    return names.where(F.startswith("path", F.lit(prefix))) if prefix else names


def scan_payloads(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, length, content)`` of payload files."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", "content")
    )


def scan_service_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, body)`` of the output files of all services, one row per file.

    GROBID bodies are not needed to know a version, so those files are listed but not read. Tasks list and read, see
    :mod:`sheaf.sources.listing`; where only Hadoop knows the file system, Spark's readers list on the driver.
    """
    if listing.reachable(folder):
        files = listing.read_service_outputs(spark, folder)
        return files.select(F.concat(F.lit(folder.rstrip("/") + "/"), "path").alias("path"), "body")
    parts = []
    for service, suffix in SERVICE_SUFFIX.items():
        reader = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True)
        if service == "grobid":
            files = reader.format("binaryFile").load(folder)
            parts.append(files.select("path", F.lit(None).cast("string").alias("body")))
        else:
            files = reader.format("text").option("wholetext", True).load(folder)
            parts.append(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first

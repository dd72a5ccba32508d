"""Which files each enrichment service still has to process, and in which batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import SERVICES, service_of_path, storage_path, uuid_from_path
from sheaf.operators.index import batch_numbers, global_index, group_index
from sheaf.operators.status import INITIAL_VERSION


def _semver_key(version):
    """Numeric parts of a version as an array, for the optional numeric comparison."""
    numbers = F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1))
    return F.transform(numbers, lambda n: n.cast("bigint"))


def version_backlog(status: DataFrame, spec: dict[str, str], semver: bool = False) -> DataFrame:
    """``(uuid, service, version)`` of rows whose version is lower than the wanted one.

    Versions compare as strings, and a null version counts as never processed. One pass over the
    table serves all services. ``semver=True`` compares the numbers in the version instead.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(service).alias("service"),
                    F.coalesce(f"{service}_version", F.lit(INITIAL_VERSION)).alias("version"),
                    F.lit(spec.get(service, INITIAL_VERSION)).alias("spec"),
                )
                for service in SERVICES
            ]
        )
    )
    columns = ["uuid", *[f"{service}_version" for service in SERVICES]]
    rows = status.select(*columns).select("uuid", pairs.alias("p")).select("uuid", "p.*")
    behind = F.col("version") < F.col("spec")
    if semver:
        behind = _semver_key(F.col("version")) < _semver_key(F.col("spec"))
    return rows.where(behind).select("uuid", "service", "version")


def backlog_files(status: DataFrame, spec: dict[str, str], semver: bool = False) -> DataFrame:
    """``(service, path, position)`` of the payloads to process, in the order of ``position``."""
    return sorted_paths(
        version_backlog(status, spec, semver).select("service", storage_path(F.col("uuid")).alias("path")),
        "service",
        "path",
    )


def sorted_paths(paths: DataFrame, *columns: str) -> DataFrame:
    """Total order on paths, by bytes, as ``position`` from 0; equal rows have neighbouring ones."""
    return global_index(paths, list(columns or ("path",)), "position")


def service_batches(status: DataFrame, spec: dict[str, str], size: int = 1_000) -> DataFrame:
    """``(service, batch_no, idx, path)``: the sorted backlog of each service cut into batches.

    A uuid is in the status table once, so a path is once in a service's backlog.
    """
    files = version_backlog(status, spec).select("service", storage_path(F.col("uuid")).alias("path"))
    return batch_numbers(group_index(files, ["service"], ["path"], "idx", unique=True), size)


def zip_batches(batches: DataFrame) -> DataFrame:
    """Batch i of the three services side by side; a service without one gets an empty list.

    A group holds at most one batch per service, whose size the caller chose.
    """
    lists = batches.groupBy("batch_no").pivot("service", SERVICES).agg(
        F.array_sort(F.collect_list("path"))
    )
    return lists.select(
        "batch_no",
        *[
            F.coalesce(F.col(service), F.array().cast("array<string>")).alias(f"{service}_files")
            for service in SERVICES
        ],
    )


def batch_profile(batches: DataFrame) -> DataFrame:
    """Largest batch per batch number and service, and over the three services."""
    return (
        batches.groupBy("batch_no", "service")
        .count()
        .groupBy("batch_no")
        .agg(F.max("count").alias("largest"))
    )


def output_versions(outputs: DataFrame, grobid_version: str) -> DataFrame:
    """``(path, uuid, service, version)`` of service output files ``(path, body)``.

    Softcite and Datastet write their version in the JSON body; GROBID's is given.
    """
    service = service_of_path(F.col("path"))
    version = F.when(F.col("service") == "grobid", F.lit(grobid_version)).otherwise(
        F.get_json_object("body", "$.version")
    )
    return (
        outputs.withColumn("service", service)
        .where(F.col("service").isNotNull())
        .select("path", uuid_from_path(F.col("path")).alias("uuid"), "service", version.alias("version"))
    )


def service_batch_version(versions: DataFrame) -> DataFrame:
    """One version per service: that of its first file by path, ``"0"`` without files."""
    spark = versions.sparkSession
    services = spark.createDataFrame([(s,) for s in SERVICES], "service string")
    first = versions.groupBy("service").agg(F.min_by("version", "path").alias("version"))
    # Three rows on each side.
    return services.join(first, "service", "left").select(
        "service", F.coalesce("version", F.lit(INITIAL_VERSION)).alias("version")
    )

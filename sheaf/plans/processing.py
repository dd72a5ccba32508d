"""Planning and folding back the work of the enrichment services."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import SERVICES
from sheaf.operators.backlog import (
    output_versions,
    service_batch_version,
    service_batches,
    zip_batches,
)
from sheaf.operators.index import first_batch
from sheaf.operators.status import INITIAL_VERSION, apply_versions, unknown_uuids


def plan_processing(
    status: DataFrame,
    spec: dict[str, str] | None = None,
    size: int = 1_000,
    first_only: bool = False,
) -> DataFrame:
    """Zipped batches of files per service; services not in ``spec`` have nothing to do."""
    wanted = {service: INITIAL_VERSION for service in SERVICES} | (spec or {})
    unknown = set(wanted) - set(SERVICES)
    if unknown:
        raise ValueError(f"unknown services: {sorted(unknown)}")
    batches = service_batches(status, wanted, size)
    return zip_batches(first_batch(batches) if first_only else batches)


def processing_events(outputs: DataFrame, grobid_version: str, versions: str = "batch") -> DataFrame:
    """Version events of a batch of service outputs ``(path, body)``.

    ``versions="batch"`` gives every file of a service the version of its first file by path;
    ``"file"`` keeps each file's own.
    """
    found = output_versions(outputs, grobid_version)
    if versions == "file":
        return found.select(F.col("path").alias("seq"), "uuid", "service", "version")
    if versions != "batch":
        raise ValueError(f"unknown versions {versions!r}")
    one = service_batch_version(found).withColumnRenamed("version", "batch_version")
    # Three rows.
    return found.join(F.broadcast(one), "service").select(
        F.col("path").alias("seq"), "uuid", "service", F.col("batch_version").alias("version")
    )


@dataclass
class ProcessingResult:
    status: DataFrame
    unknown: DataFrame


def apply_processing(
    status: DataFrame, outputs: DataFrame, grobid_version: str, versions: str = "batch"
) -> ProcessingResult:
    """The status table after the outputs of a batch are folded in, and the uuids it does not have."""
    events = processing_events(outputs, grobid_version, versions)
    return ProcessingResult(apply_versions(status, events), unknown_uuids(status, events))

"""The status table: new rows, version updates, upserts and reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import PUBLICATION_PREFIX, SERVICES, storage_path
from sheaf.operators.dedup import keep_values
from sheaf.schemas import STATUS

# Fixed value: version of a service that has not processed a publication yet.
INITIAL_VERSION = "0"
VERSION_COLUMNS = [f"{service}_version" for service in SERVICES]


def status_count(status: DataFrame) -> DataFrame:
    return status.agg(F.count("*").alias("n"))


def select_by_uuids(status: DataFrame, uuids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the listed uuids; an empty list gives no rows."""
    return keep_values(status, "uuid", uuids)


def record_filter(status: DataFrame, condition) -> DataFrame:
    """Rows matching a caller's condition, a Column or SQL text."""
    return status.where(condition)


def confirm_uploaded(pairs: DataFrame, objects: DataFrame, match: str = "exact") -> DataFrame:
    """``(doi, uuid)`` pairs whose payload is in the object listing.

    ``match="prefix"`` also takes an object whose name continues after the expected path. The uuid
    is a component of the object's path, so this too is a join on equality.
    """
    if match == "exact":
        stored = objects.select(F.col("path").alias("__path"))
        return pairs.withColumn("__path", storage_path(F.col("uuid"))).join(
            stored, "__path", "left_semi"
        ).drop("__path")
    if match == "prefix":
        depth = PUBLICATION_PREFIX.count("/") + 6
        found = objects.select(
            "path", F.get(F.split("path", "/"), F.lit(depth - 1)).alias("uuid")
        ).where(F.startswith("path", storage_path(F.col("uuid"))))
        return pairs.join(found.select("uuid"), "uuid", "left_semi").select(*pairs.columns)
    raise ValueError(f"unknown match {match!r}")


def status_rows(confirmed: DataFrame, ledger: DataFrame, now) -> DataFrame:
    """New status rows for confirmed pairs, with what the ledger knows of them."""
    known = ledger.select(
        F.col("id").alias("uuid"), "harvester_used", "domain", "url_used"
    )
    return new_status_rows(confirmed.join(known, "uuid"), now)


def new_status_rows(stored: DataFrame, now) -> DataFrame:
    """Status rows of ``(doi, uuid, harvester_used, domain, url_used)``, not yet processed by any service."""
    version = F.lit(INITIAL_VERSION)
    return stored.select(
        "doi",
        "uuid",
        F.lit("1").alias("is_harvested"),
        version.alias("softcite_version"),
        version.alias("grobid_version"),
        "harvester_used",
        "domain",
        "url_used",
        F.lit(now).cast("timestamp").alias("harvesting_date"),
        version.alias("datastet_version"),
    )


def without_ledger(confirmed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Confirmed pairs the ledger has no row for; :func:`status_rows` leaves them out."""
    return confirmed.join(ledger.select(F.col("id").alias("uuid")), "uuid", "left_anti")


def latest_versions(events: DataFrame) -> DataFrame:
    """Fold ``(seq, uuid, service, version)`` into one row per uuid; the last event wins."""
    return events.groupBy("uuid").agg(
        *[
            F.max_by(
                F.when(F.col("service") == service, F.col("version")),
                F.when(F.col("service") == service, F.col("seq")),
            ).alias(f"new_{service}")
            for service in SERVICES
        ]
    )


def apply_versions(status: DataFrame, events: DataFrame) -> DataFrame:
    """The whole status table with version events folded in."""
    return with_versions(status, latest_versions(events))


def with_versions(status: DataFrame, newest: DataFrame) -> DataFrame:
    """The whole status table with folded events, one row per uuid, in the place of older versions."""
    columns = [
        F.coalesce(f"new_{c.removesuffix('_version')}", c).alias(c) if c in VERSION_COLUMNS else F.col(c)
        for c in status.columns
    ]
    return status.join(newest, "uuid", "left").select(*columns)


def changed_rows(status: DataFrame, events: DataFrame) -> DataFrame:
    """Only the status rows that events touch, with their new versions: the batch to upsert."""
    newest = latest_versions(events)
    columns = [
        F.coalesce(f"new_{c.removesuffix('_version')}", c).alias(c) if c in VERSION_COLUMNS else F.col(c)
        for c in status.columns
    ]
    return status.join(newest, "uuid").select(*columns)


def unknown_uuids(status: DataFrame, events: DataFrame) -> DataFrame:
    """uuids with events but no status row."""
    return events.select("uuid").distinct().join(status.select("uuid"), "uuid", "left_anti")


def upsert_status(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new uuids; for known ones replace only the three version columns.

    A uuid twice in ``incoming`` fails the job: which of the two rows holds would be arbitrary.
    """
    one = (
        incoming.groupBy("uuid")
        .agg(
            F.count("*").alias("__n"),
            F.min(F.struct(*[c for c in STATUS.names if c != "uuid"])).alias("i"),
        )
        .withColumn(
            "__in",
            F.when(F.col("__n") == 1, F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("uuid twice in one upsert: "), F.col("uuid"))).cast("boolean")
            ),
        )
        .select("uuid", "i", "__in")
    )
    old = current.select("uuid", F.struct(*[c for c in STATUS.names if c != "uuid"]).alias("c"))
    joined = old.join(one, "uuid", "full_outer")
    columns = []
    for name in STATUS.names:
        if name == "uuid":
            columns.append(F.col("uuid"))
        elif name in VERSION_COLUMNS:
            columns.append(F.when(F.col("__in"), F.col(f"i.{name}")).otherwise(F.col(f"c.{name}")).alias(name))
        else:
            columns.append(
                F.when(F.col("c").isNotNull(), F.col(f"c.{name}")).otherwise(F.col(f"i.{name}")).alias(name)
            )
    return joined.select(*columns)


def evolve_status(status: DataFrame) -> DataFrame:
    """Bring an older status table to the current columns; what it lacks is null."""
    return status.select(
        *[
            F.col(f.name) if f.name in status.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in STATUS
        ]
    )


def devolve_status(status: DataFrame) -> DataFrame:
    """The reverse of :func:`evolve_status`."""
    return status.drop("harvesting_date", "datastet_version")

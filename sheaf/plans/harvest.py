"""One harvest run, from records to ledgers and the new status table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import storage_path
from sheaf.functions.records import has_doi
from sheaf.functions.urls import LOCATION_RULES
from sheaf.operators.attempts import resolve_steps, split_outcomes
from sheaf.operators.candidates import url_steps
from sheaf.operators.dedup import doi_allowlist
from sheaf.operators.index import take_slice
from sheaf.operators.ledger import failure_rows, ledger_rows
from sheaf.operators.status import new_status_rows, upsert_status
from sheaf.plans.manifest import build_manifest
from sheaf.session import durable


@dataclass
class HarvestResult:
    manifest: DataFrame
    ledger: DataFrame
    failures: DataFrame
    new_rows: DataFrame
    status: DataFrame
    report: DataFrame


def run_report(entries: DataFrame, bad: DataFrame, status: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row: entries attempted and failed, rows stored, and status rows before and after."""
    one = F.lit(1)
    counts = [
        ("n_entries", entries),
        ("n_failed", bad),
        ("n_stored", new_rows),
        ("n_before", status.select("uuid")),
        ("n_new", new_rows.select("uuid").distinct().join(status.select("uuid"), "uuid", "left_anti")),
    ]
    (_, first), *rest = [(name, rows.agg(F.count("*").alias(name)).withColumn("__one", one)) for name, rows in counts]
    for _, part in rest:
        # One row on either side.
        first = first.join(F.broadcast(part), "__one")
    return first.select("n_entries", "n_failed", "n_stored", "n_before", (F.col("n_before") + F.col("n_new")).alias("n_after"))


def harvest_batch(
    records: DataFrame,
    status: DataFrame,
    captured: DataFrame,
    now: str,
    dois: Sequence[str] | DataFrame | None = (),
    slice_of: tuple[int, int] | None = None,
    objects: DataFrame | None = None,
    order_by: Sequence[str] = ("line_no",),
    mode: str = "complete",
    country: str = "fr",
    rules: Sequence[str] = LOCATION_RULES,
    known: DataFrame | None = None,
    ledger: DataFrame | None = None,
    reprocess: bool = False,
    wiley: bool = True,
    elsevier: bool = True,
) -> HarvestResult:
    """Slice, filter, build the manifest, resolve it against captured fetches, update the status.

    ``slice_of=(k, total)`` needs records with a dense ``idx``. ``objects`` is the payload listing
    that confirms uploads; without it the successful fetches count as stored. ``known(doi, uuid)`` and
    ``ledger`` are what an unfinished run left: its DOIs are skipped, or with ``reprocess`` tried again
    under their uuid unless the ledger has a PDF for them. A publisher client that is not available
    (``wiley``, ``elsevier``) leaves its URLs to the standard channel.

    The manifest, the outcomes and the new rows are written while the plan is being made.
    """
    if slice_of:
        records = take_slice(records, slice_of[0], slice_of[1], mode)
    wanted = doi_allowlist(records.where(has_doi(F.col("doi"))), dois)
    manifest = durable(
        build_manifest(wanted, order_by, country, rules, status, known, ledger, reprocess), "manifest"
    )
    steps = url_steps(manifest, wiley, elsevier)
    outcomes = resolve_steps(steps, captured, manifest.select("id", "doi", "domain", "urls"))
    entries = durable(outcomes, "outcomes")
    good, bad = split_outcomes(entries)
    if objects is not None:
        listed = objects.select(F.col("path").alias("__path"))
        stored = entries.withColumn("__path", storage_path(F.col("id"))).join(listed, "__path", "left_semi").drop("__path")
    else:
        stored = good
    # An entry has all that its status row takes from the ledger.
    rows = durable(new_status_rows(stored.withColumnRenamed("id", "uuid"), now), "new_rows")
    return HarvestResult(
        manifest=manifest,
        ledger=ledger_rows(entries, now),
        failures=failure_rows(bad),
        new_rows=rows,
        status=upsert_status(status, rows),
        report=run_report(entries, bad, status, rows),
    )

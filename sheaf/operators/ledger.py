"""Ledger rows and the failure report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# External ids a ledger row has.
EXTERNAL_IDS = ["doi", "pmid", "pmcid", "istexId", "ark", "pii"]


def ledger_rows(entries: DataFrame, run_date) -> DataFrame:
    """One ledger row per attempted entry, successful or not.

    ``run_date`` is a date, a timestamp or their text. Optional columns of ``entries``: the
    external ids, ``valid_fulltext_pdf``, ``valid_thumbnails`` and ``best_oa_location`` (a map).
    """

    def optional(name: str, kind: str):
        return F.col(name) if name in entries.columns else F.lit(None).cast(kind)

    resources = F.filter(
        F.array(
            F.lit("json"),
            F.when(optional("valid_fulltext_pdf", "boolean"), "pdf"),
            F.when(optional("valid_thumbnails", "boolean"), "thumbnails"),
        ),
        lambda kind: kind.isNotNull(),
    )
    if "best_oa_location" in entries.columns:
        oa_link = F.col("best_oa_location")["url_for_pdf"]
    else:
        oa_link = F.lit(None).cast("string")
    return entries.select(
        "id",
        *[optional(name, "string").alias(name) for name in EXTERNAL_IDS],
        resources.alias("resources"),
        F.date_format(F.lit(run_date).cast("timestamp"), "yyyy-MM-dd").alias("harvested_date"),
        "harvester_used",
        "url_used",
        "domain",
        oa_link.alias("oa_link"),
    )


def failure_rows(failures: DataFrame, reference_compat: bool = False) -> DataFrame:
    """``(id, result, url)`` of the failed entries, ``url`` being the last one tried.

    ``reference_compat`` writes ``no url`` instead, which is all a lookup by the wrong key gives.
    """
    url = F.lit("no url") if reference_compat else F.coalesce("last_url", F.lit("no url"))
    return failures.select("id", "result", url.alias("url"))


def harvest_diagnostic(attempts: DataFrame, key: Sequence[str], ok: str = "ok") -> DataFrame:
    """Failed entries out of all entries; an entry failed when none of its attempts succeeded."""
    per_entry = attempts.groupBy(*key).agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("ok"))
    return per_entry.agg(
        F.count_if(~F.col("ok")).alias("nb_fails"), F.count("*").alias("nb_total")
    )

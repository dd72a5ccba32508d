"""From publication records to the manifest of what to fetch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.paths import PUBLICATION_EXT
from sheaf.functions.records import has_doi, in_country, latest_observation
from sheaf.functions.urls import (
    FLAT_RULES,
    LOCATION_RULES,
    closed_access_url,
    pdf_urls,
    rank_sql,
    ranked_locations,
)
from sheaf.operators.candidates import rank_flat_locations
from sheaf.operators.dedup import assign_ids, first_by, harvested_dois, reprocess_filter
from sheaf.session import durable


def first_occurrences(
    records: DataFrame, order_by: Sequence[str] = ("line_no",), country: str = "fr"
) -> DataFrame:
    """First record of each DOI of the country, cut down to what the manifest needs.

    Rows are narrowed to the latest observation before the one exchange, on the DOI.
    """
    kept = records.where(
        has_doi(F.col("doi")) & in_country(F.col("bso_country_corrected"), country)
    ).select(
        "doi",
        "publisher_normalized",
        F.col("bso_classification").alias("domain"),
        latest_observation(F.col("oa_details")).alias("obs"),
        *order_by,
    )
    return first_by(kept, ["doi"], order_by).drop(*order_by)


def with_urls(
    occurrences: DataFrame, rules: Sequence[str] = LOCATION_RULES, data_folder: str = "data"
) -> DataFrame:
    """Manifest rows of records with an id; records without a URL are left out.

    Row-local: the exchange on the DOI that made the records unique is the last one.
    """
    is_open = F.coalesce(F.col("obs.is_oa"), F.lit(False))
    closed_url = closed_access_url(F.col("doi"), F.col("publisher_normalized"))
    # Stated apart from the ranking, so that the filter does not rank every record a second time.
    has_url = F.expr(
        "exists(obs.oa_locations, loc -> coalesce(loc['url_for_pdf'], '') <> '' "
        f"and ({rank_sql(rules)}) is not null)"
    )
    usable = occurrences.where(
        F.col("obs").isNotNull()
        & F.when(is_open, F.coalesce(has_url, F.lit(False))).otherwise(closed_url.isNotNull())
    )
    located = usable.withColumn(
        "oa_locations", F.when(is_open, ranked_locations("obs.oa_locations", rules))
    )
    return located.select(
        "id",
        "doi",
        "domain",
        "oa_locations",
        F.when(is_open, pdf_urls("oa_locations")).otherwise(F.array(closed_url)).alias("urls"),
        F.concat(F.lit(data_folder.rstrip("/") + "/"), "id", F.lit(PUBLICATION_EXT)).alias("filename"),
    )


def build_manifest(
    records: DataFrame,
    order_by: Sequence[str] = ("line_no",),
    country: str = "fr",
    rules: Sequence[str] = LOCATION_RULES,
    harvested: DataFrame | None = None,
    known: DataFrame | None = None,
    ledger: DataFrame | None = None,
    reprocess: bool = False,
    data_folder: str = "data",
) -> DataFrame:
    """``(id, doi, domain, oa_locations, urls, filename)`` of the records to fetch.

    The first record of a DOI decides, even when it has no URL. DOIs of the status table
    ``harvested`` are left out: the anti-join stands between the dedup and the ranking, so it meets
    each DOI once, uses the exchange that made the DOIs unique, and only what is left is ranked.
    ``known(doi, uuid)`` and ``ledger`` bring in what an unfinished run did.
    """
    first = first_occurrences(records, order_by, country)
    if harvested is not None:
        first = first.join(harvested_dois(harvested), "doi", "left_anti")
    if known is None:
        first = assign_ids(first)
    else:
        if ledger is None:
            raise ValueError("known DOIs need the ledger of the run that knew them")
        first = reprocess_filter(first, known, ledger, reprocess)
    return with_urls(first, rules, data_folder)


def build_manifest_tables(
    pubs: DataFrame,
    locations: DataFrame,
    tie_break: Sequence[str],
    country: str = "fr",
    rules: Sequence[str] = FLAT_RULES,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """``(doi, domain, url_rank, url)`` from a publication table and a location table.

    ``pubs(line_no, doi, country, publisher_normalized, domain)`` and
    ``locations(line_no, obs_key, loc_oa, repo, host_type, url, ...)``. Locations are never
    gathered by record: the latest observation is an aggregate, and ranks come from
    :func:`rank_flat_locations`.
    """
    kept = first_by(
        pubs.where(has_doi(F.col("doi")) & (F.col("country") == country)), ["doi"], ["line_no"]
    ).select("line_no", "doi", "domain", "publisher_normalized")
    # The greatest (label, flag) pair holds the latest label and, within it, whether any location
    # is open: one aggregate instead of a lookup of the label and a second pass.
    latest = locations.groupBy("line_no").agg(
        F.max(F.struct("obs_key", "loc_oa")).alias("m"), F.count("*").alias("count")
    )
    heads = kept.join(latest, "line_no").select(
        *kept.columns, F.col("m.obs_key").alias("obs_key"), F.col("m.loc_oa").alias("is_oa"), "count"
    )
    # Read for the open records and again for the closed ones.
    heads = durable(heads, "heads")
    opened = heads.where("is_oa").select("line_no", "obs_key", "doi", "domain")
    # A record has one latest label, so ranks by record and label are those by record, and the exchange
    # of the join serves them, too. Locations of a record are at least as many as those of one label.
    ranked = rank_flat_locations(
        locations.join(opened, ["line_no", "obs_key"]),
        ["line_no", "obs_key"],
        tie_break,
        rules,
        hot_rows,
        sizes=heads.where("is_oa").select("line_no", "obs_key", "count"),
    ).select("doi", "domain", "url_rank", "url")
    closed = heads.where("not is_oa").select(
        "doi",
        "domain",
        F.lit(1).cast("bigint").alias("url_rank"),
        closed_access_url(F.col("doi"), F.col("publisher_normalized")).alias("url"),
    )
    return ranked.unionByName(closed.where(F.col("url").isNotNull()))

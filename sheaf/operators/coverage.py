"""Harvest coverage: which class a publication is in, and how much of each class is harvested.

Everything starts from one scan: a record gets its class flags, and one aggregation by DOI turns
them into one row per DOI. All counts are taken from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.records import (
    has_doi,
    has_wiley_pdf,
    is_closed,
    on_hal_location,
    on_hal_observation,
    open_or_standard,
    repo_label,
)
from sheaf.functions.report import percent, share, thousands
from sheaf.operators.dedup import harvested_dois
from sheaf.session import lookup_side

# Names of the access classes.
CLASSES = ["ca", "oa", "wiley_ca", "wiley_oa", "elsevier_ca"]


def classify(records: DataFrame, hal: str = "observation") -> DataFrame:
    """``(doi, ca, oa, wiley_ca, wiley_oa, elsevier_ca, hal)`` for every record with an observation.

    ``hal="observation"`` reads the label where the analysis looks for it, ``"location"`` where
    dumps have it.
    """
    if hal not in ("observation", "location"):
        raise ValueError(f"unknown place of the HAL label {hal!r}")
    details, publisher = F.col("oa_details"), F.col("publisher_normalized")
    on_hal = on_hal_observation(details) if hal == "observation" else on_hal_location(details)
    doi = F.col("doi") if "doi" in records.columns else F.lit("no_doi")
    closed = F.col("ca")

    def closed_at(name: str):
        return closed & F.coalesce(publisher == name, F.lit(False))

    flagged = records.where(F.size("oa_details") > 0).select(
        doi.alias("doi"),
        publisher.alias("publisher_normalized"),
        is_closed(details).alias("ca"),
        has_wiley_pdf(details).alias("wiley_pdf"),
        on_hal.alias("hal"),
    )
    return flagged.select(
        "doi",
        "ca",
        (~closed).alias("oa"),
        closed_at("Wiley").alias("wiley_ca"),
        (~closed & F.col("wiley_pdf")).alias("wiley_oa"),
        closed_at("Elsevier").alias("elsevier_ca"),
        "hal",
    )


def class_lists(classified: DataFrame) -> DataFrame:
    """``(class, doi)`` for every class a record is in; duplicates and null DOIs are kept."""
    names = F.filter(
        F.array(*[F.when(F.col(c), F.lit(c)) for c in CLASSES]), lambda name: name.isNotNull()
    )
    return classified.select(F.explode(names).alias("class"), "doi")


def per_doi(classified: DataFrame) -> DataFrame:
    """Class flags by DOI; a DOI met as open and as closed is in both classes.

    The flags are combined in each task before the exchange, so a DOI repeated in a third of the
    records still arrives as one row per task.
    """
    flags = [*CLASSES, "hal"]
    return (
        classified.where(has_doi(F.col("doi")))
        .groupBy("doi")
        .agg(*[F.bool_or(f).alias(f) for f in flags])
    )


def with_harvested(by_doi: DataFrame, status: DataFrame) -> DataFrame:
    """Add ``harvested_rows``, the status rows of the DOI, and ``is_harvested``.

    Both sides have one row per DOI. A table that has the columns is returned as it is, so a report
    can join once and keep the result.
    """
    if "is_harvested" in by_doi.columns:
        return by_doi
    rows = (
        status.where(has_doi(F.col("doi"))).groupBy("doi").agg(F.count("*").alias("harvested_rows"))
    )
    number = F.coalesce("harvested_rows", F.lit(0).cast("bigint"))
    return (
        by_doi.join(rows, "doi", "left")
        .withColumn("harvested_rows", number)
        .withColumn("is_harvested", F.col("harvested_rows") > 0)
    )


def distinct_dois(by_doi: DataFrame, name: str) -> DataFrame:
    """DOIs of a class."""
    return by_doi.where(F.col(name)).select("doi")


def intersect_harvested(by_doi: DataFrame, status: DataFrame, name: str) -> DataFrame:
    """DOIs of a class that are harvested."""
    return distinct_dois(by_doi, name).join(harvested_dois(status), "doi", "left_semi")


def missing_dois(by_doi: DataFrame, status: DataFrame, name: str) -> DataFrame:
    """DOIs of a class that are not harvested."""
    return distinct_dois(by_doi, name).join(harvested_dois(status), "doi", "left_anti")


def universe_union(by_doi: DataFrame) -> DataFrame:
    """Open DOIs followed by closed ones, flagged; a DOI in both classes has two rows."""
    opened = distinct_dois(by_doi, "oa").withColumn("is_oa", F.lit(True))
    closed = distinct_dois(by_doi, "ca").withColumn("is_oa", F.lit(False))
    return opened.unionByName(closed)


def harvested_universe(by_doi: DataFrame, status: DataFrame) -> DataFrame:
    """``(doi, is_oa, is_harvested, repo)``: the universe with its flags.

    Same rows as :func:`universe_union` with lookups, but from one pass: the DOI table is joined
    once and each row then gives one or two.
    """
    sides = F.filter(
        F.array(F.when(F.col("oa"), F.lit(True)), F.when(F.col("ca"), F.lit(False))),
        lambda side: side.isNotNull(),
    )
    repo = repo_label(F.col("wiley_ca") | F.col("wiley_oa"), F.col("hal"))
    return with_harvested(by_doi, status).select(
        "doi", F.explode(sides).alias("is_oa"), "is_harvested", repo.alias("repo")
    )


def harvest_flags(status: DataFrame, by_doi: DataFrame) -> DataFrame:
    """Status rows with ``oa`` and ``ca``: whether their DOI is in the class."""
    flags = by_doi.select("doi", F.col("oa").alias("__oa"), F.col("ca").alias("__ca"))
    return (
        status.join(lookup_side(flags), "doi", "left")
        .withColumn("oa", F.coalesce("__oa", F.lit(False)))
        .withColumn("ca", F.coalesce("__ca", F.lit(False)))
        .drop("__oa", "__ca")
    )


def residual_as_open(flagged: DataFrame) -> DataFrame:
    """Add ``oa_or_standard``: rows in neither class fetched by ``standard`` count as open."""
    return flagged.withColumn(
        "oa_or_standard", open_or_standard(F.col("oa"), F.col("ca"), F.col("harvester_used"))
    )


def coverage_totals(by_doi: DataFrame) -> DataFrame:
    """Universe size and the share of each access class."""
    counts = by_doi.agg(F.count_if("oa").alias("nb_oa"), F.count_if("ca").alias("nb_ca"))
    total = F.col("nb_oa") + F.col("nb_ca")
    return counts.select(
        total.alias("total_nb"),
        "nb_oa",
        "nb_ca",
        share(F.col("nb_oa"), total).alias("oa_share"),
        share(F.col("nb_ca"), total).alias("ca_share"),
    )


def coverage_harvested(by_doi: DataFrame, status: DataFrame) -> DataFrame:
    """Harvested rows by access class, with their shares, and the rows in neither class."""
    zero = F.lit(0).cast("bigint")

    def rows_in(name: str):
        return F.coalesce(F.sum(F.when(F.col(name), F.col("harvested_rows"))), zero)

    sizes = with_harvested(by_doi, status).agg(
        rows_in("oa").alias("oa_harvested"),
        rows_in("ca").alias("ca_harvested"),
        F.count_if("oa").alias("nb_oa"),
        F.count_if("ca").alias("nb_ca"),
    )
    rows = status.agg(F.count("*").alias("harvested"))
    # One row from each side, added up.
    both = (
        sizes.withColumn("harvested", zero)
        .unionByName(rows, allowMissingColumns=True)
        .agg(*[F.sum(c).alias(c) for c in (*sizes.columns, "harvested")])
    )
    return both.select(
        "harvested",
        share(F.col("harvested"), F.col("nb_oa") + F.col("nb_ca")).alias("harvested_share"),
        "oa_harvested",
        share(F.col("oa_harvested"), F.col("nb_oa")).alias("oa_share"),
        "ca_harvested",
        share(F.col("ca_harvested"), F.col("nb_ca")).alias("ca_share"),
        (F.col("harvested") - F.col("oa_harvested") - F.col("ca_harvested")).alias("neither"),
    )


def publisher_coverage(by_doi: DataFrame, status: DataFrame) -> DataFrame:
    """Harvested and total DOIs of the publisher classes, one row per class."""
    groups = ["elsevier_ca", "wiley_oa", "wiley_ca"]
    counts = with_harvested(by_doi, status).agg(
        *[F.count_if(F.col(g)).alias(f"{g}_total") for g in groups],
        *[F.count_if(F.col(g) & F.col("is_harvested")).alias(f"{g}_done") for g in groups],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(g).alias("class"),
                    F.col(f"{g}_done").alias("harvested"),
                    F.col(f"{g}_total").alias("total"),
                )
                for g in groups
            ]
        )
    )
    return counts.select(rows.alias("r")).select(
        "r.class", "r.harvested", "r.total", share(F.col("r.harvested"), F.col("r.total")).alias("share")
    )


def coverage_cube(universe: DataFrame) -> DataFrame:
    """DOIs by access class, harvest flag and repository."""
    return universe.groupBy("is_oa", "is_harvested", "repo").agg(F.count("doi").alias("n"))


def rollup_cube(cube: DataFrame) -> DataFrame:
    """The cube and its sum over repositories, for which ``repo`` is null."""
    keys = [F.col("is_oa"), F.col("is_harvested"), F.col("repo")]
    return cube.groupingSets([keys, keys[:2]], *keys).agg(F.sum("n").alias("n"))


def sum_by_repo(cube: DataFrame) -> DataFrame:
    """Named repositories by harvest flag, summed over the access classes."""
    return cube.where(F.col("repo") != "NC").groupBy("repo", "is_harvested").agg(F.sum("n").alias("n"))


def pick_repo(cube: DataFrame, repo: str = "Wiley") -> DataFrame:
    """One repository by access class and harvest flag."""
    return cube.where(F.col("repo") == repo).select("is_oa", "is_harvested", "n")


def coverage_rollup(universe: DataFrame) -> DataFrame:
    return rollup_cube(coverage_cube(universe))


def coverage_by_repo(universe: DataFrame) -> DataFrame:
    return sum_by_repo(coverage_cube(universe))


def coverage_of_repo(universe: DataFrame, repo: str = "Wiley") -> DataFrame:
    return pick_repo(coverage_cube(universe), repo)


def percent_format(totals: DataFrame) -> DataFrame:
    """The totals as printed: thousands separators and percentages."""
    return totals.select(
        thousands(F.col("total_nb")).alias("total_nb"),
        thousands(F.col("nb_oa")).alias("nb_oa"),
        percent(F.col("oa_share")).alias("oa_share"),
        thousands(F.col("nb_ca")).alias("nb_ca"),
        percent(F.col("ca_share")).alias("ca_share"),
    )

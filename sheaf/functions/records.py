"""Predicates and projections over one publication record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_doi(doi: Column) -> Column:
    return F.coalesce(doi, F.lit("")) != ""


def in_country(countries: Column, code: str = "fr") -> Column:
    """False, not null, for a record without a country list."""
    return F.coalesce(F.array_contains(countries, code), F.lit(False))


def latest_key(details: Column) -> Column:
    """Greatest observation label in string order; null when there is none."""
    return F.array_max(F.map_keys(details))


def latest_observation(details: Column) -> Column:
    return F.element_at(details, latest_key(details))


def nth_key(details: Column, n: int = 0) -> Column:
    """n-th label in document order, 0-based, negative from the end; null out of range."""
    return F.try_element_at(F.map_keys(details), F.lit(n + 1 if n >= 0 else n))


def nth_observation(details: Column, n: int = -1) -> Column:
    return F.try_element_at(F.map_values(details), F.lit(n + 1 if n >= 0 else n))


def is_closed(details: Column) -> Column:
    """The last observation in document order is not open access."""
    return ~F.coalesce(nth_observation(details).getField("is_oa"), F.lit(False))


def has_wiley_pdf(details: Column) -> Column:
    """Some PDF URL of the last observation in document order contains ``wiley``."""
    locations = nth_observation(details).getField("oa_locations")
    return F.coalesce(
        F.exists(
            locations,
            lambda loc: F.coalesce(F.contains(loc["url_for_pdf"], F.lit("wiley")), F.lit(False)),
        ),
        F.lit(False),
    )


def on_hal_observation(details: Column) -> Column:
    """The label sits on the observation itself, which dumps leave empty."""
    label = nth_observation(details).getField("repository_normalized")
    return F.coalesce(label == "HAL", F.lit(False))


def on_hal_location(details: Column) -> Column:
    """Some location of the last observation in document order is on HAL."""
    locations = nth_observation(details).getField("oa_locations")
    return F.coalesce(
        F.exists(
            locations,
            lambda loc: F.coalesce(loc["repository_normalized"] == "HAL", F.lit(False)),
        ),
        F.lit(False),
    )


def repo_label(wiley: Column, hal: Column) -> Column:
    """Wiley wins over HAL; everything else is ``NC``."""
    return F.when(wiley, "Wiley").when(hal, "HAL").otherwise("NC")


def open_or_standard(is_open: Column, closed: Column, harvester: Column) -> Column:
    """Open, or in neither class and fetched through the standard channel."""
    standard = F.coalesce(harvester == "standard", F.lit(False))
    return is_open | (~closed & standard)

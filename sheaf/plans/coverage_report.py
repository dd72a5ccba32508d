"""Dump x status -> coverage tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sheaf.operators import coverage as c
from sheaf.session import durable


@dataclass
class CoverageReport:
    totals: DataFrame
    harvested: DataFrame
    publishers: DataFrame
    cube: DataFrame
    rollup: DataFrame
    by_repo: DataFrame
    wiley: DataFrame


def coverage_report(records: DataFrame, status: DataFrame, hal: str = "observation") -> CoverageReport:
    """All coverage tables from one scan of the dump.

    The DOI table is joined with the status table and written once; the cube is written once. Every
    report table then reads those.
    """
    by_doi = durable(c.with_harvested(c.per_doi(c.classify(records, hal)), status), "dois")
    cube = durable(c.coverage_cube(c.harvested_universe(by_doi, status)), "cube")
    return CoverageReport(
        totals=c.coverage_totals(by_doi),
        harvested=c.coverage_harvested(by_doi, status),
        publishers=c.publisher_coverage(by_doi, status),
        cube=cube,
        rollup=c.rollup_cube(cube),
        by_repo=c.sum_by_repo(cube),
        wiley=c.pick_repo(cube, "Wiley"),
    )

"""Laws the operators keep on the given tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from checks import adapters as a
from conftest import SF
from sheaf.functions import paths
from sheaf.operators import attempts as att
from sheaf.operators import candidates, coverage, index
from sheaf.operators import status as st
from sheaf.plans.coverage_report import coverage_report
from sheaf.plans.harvest import harvest_batch
from sheaf.plans.manifest import build_manifest
from sheaf.plans.processing import processing_events
from sheaf.schemas import STATUS
from sheaf.session import shared_folder

NOW = "2024-03-05 10:00:00"
FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_manifest(spark):
    built = build_manifest(a.records(spark, SF))
    n = built.count()
    assert n == built.select("doi").distinct().count() == built.select("id").distinct().count()
    assert built.where("urls is null or size(urls) = 0 or exists(urls, u -> coalesce(u, '') = '')").count() == 0
    assert built.where("oa_locations is not null and size(oa_locations) <> size(urls)").count() == 0


def test_outcomes_are_success_or_failure(spark):
    steps = candidates.url_steps(build_manifest(a.records(spark, SF)))
    outcomes = att.resolve_steps(steps, a.captured_outcomes(spark, SF))
    good, bad = att.split_outcomes(outcomes)
    ids = {row.id for row in steps.select("id").distinct().collect()}
    good_ids, bad_ids = ({row.id for row in part.collect()} for part in (good, bad))
    assert good_ids | bad_ids == ids and not good_ids & bad_ids


def harvest(spark, **kwargs):
    records = index.global_index(a.records(spark, SF), ["line_no"])
    status = a.status(spark, SF).select(*STATUS.names)
    return harvest_batch(records, status, a.captured_outcomes(spark, SF), NOW, **kwargs)


def test_slices_together_harvest_everything(spark):
    whole = {row.doi for row in harvest(spark).manifest.select("doi").collect()}
    parts = [{row.doi for row in harvest(spark, slice_of=(k, 2)).manifest.select("doi").collect()} for k in range(3)]
    assert set().union(*parts) == whole


def test_harvest_of_listed_dois(spark):
    wanted = [row.doi for row in harvest(spark).manifest.select("doi").limit(3).collect()]
    out = harvest(spark, dois=wanted)
    assert sorted(row.doi for row in out.manifest.collect()) == sorted(wanted)
    assert out.ledger.count() == 3
    before = a.status(spark, SF).count()
    assert out.status.count() == before + out.new_rows.count()
    assert out.new_rows.count() + out.failures.count() == 3
    assert {row.harvesting_date.isoformat() for row in out.new_rows.collect()} <= {"2024-03-05T10:00:00"}


def test_harvest_again_finds_only_what_failed(spark):
    first = harvest(spark)
    second = harvest_batch(
        index.global_index(a.records(spark, SF), ["line_no"]), first.status, a.captured_outcomes(spark, SF), NOW
    )
    failed = {row.id for row in first.failures.collect()}
    assert {row.id for row in second.manifest.collect()} == failed


def test_harvest_with_listing(spark):
    nothing = spark.createDataFrame([], "path string")
    out = harvest(spark, objects=nothing)
    assert out.new_rows.count() == 0 and out.ledger.count() > 0


def test_versions_applied_twice(spark):
    status, events = a.status(spark, SF).select(*STATUS.names), a.version_events(spark, SF)
    once = st.apply_versions(status, events)
    assert sorted(map(str, once.collect())) == sorted(map(str, st.apply_versions(once, events).collect()))
    changed = st.changed_rows(status, events)
    assert sorted(map(str, st.upsert_status(status, changed).collect())) == sorted(map(str, once.collect()))


def test_schema_round_trip(spark):
    status = a.status(spark, SF).select(*STATUS.names)
    old = st.devolve_status(status)
    assert "harvesting_date" not in old.columns
    assert [f.dataType for f in st.evolve_status(old).schema] == [f.dataType for f in STATUS]
    assert st.evolve_status(old).where("datastet_version is not null").count() == 0


def test_per_file_versions(spark):
    outputs = a.outputs(spark, SF)
    own = processing_events(outputs, "0.8.9", "file").where("service = 'softcite'")
    assert own.select("version").distinct().count() > 1
    assert processing_events(outputs, "0.8.9").where("service = 'softcite'").select("version").distinct().count() == 1
    with pytest.raises(ValueError):
        processing_events(outputs, "0.8.9", "other")


def test_universe_equals_its_plain_form(spark):
    by_doi = coverage.per_doi(coverage.classify(a.records(spark, SF)))
    status = a.status(spark, SF)
    built = coverage.harvested_universe(by_doi, status)
    plain = coverage.universe_union(by_doi)
    assert sorted(map(tuple, built.select("doi", "is_oa").collect())) == sorted(map(tuple, plain.collect()))
    harvested = {row.doi for row in status.collect()}
    assert all(row.is_harvested == (row.doi in harvested) for row in built.collect())


def test_report_adds_up(spark):
    report = coverage_report(a.records(spark, SF), a.status(spark, SF))
    totals = report.totals.first()
    cube = report.cube.collect()
    assert totals.nb_oa == sum(row.n for row in cube if row.is_oa)
    assert totals.nb_ca == sum(row.n for row in cube if not row.is_oa)
    assert sum(row.n for row in report.rollup.where("repo is null").collect()) == totals.total_nb
    wiley = sum(row.n for row in report.wiley.collect())
    assert wiley == sum(row.n for row in report.by_repo.where("repo = 'Wiley'").collect())


@FEW
@given(items=some.lists(some.text(alphabet="ab/c\\.", max_size=6), max_size=30), size=some.integers(1, 7))
def test_batches_are_list_slices(spark, items, size):
    rows = spark.createDataFrame([(item,) for item in items], "path string")
    got = index.batch_numbers(index.global_index(rows, ["path"], partitions=3), size).orderBy("idx").collect()
    want = sorted(items)
    assert [row.path for row in got] == want
    assert [row.batch_no for row in got] == [i // size for i in range(len(want))]


@FEW
@given(texts=some.lists(some.text(alphabet="ab/\\", max_size=8), min_size=1, max_size=40))
def test_path_components(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(
        "x",
        paths.strip_slashes(F.col("x")).alias("y"),
        paths.shard_path(F.col("x")).alias("z"),
        paths.storage_path(F.col("x"), "/pre/", ".gz").alias("p"),
    )

    def strip(t):
        return t.strip("/").strip("\\").strip("/").strip("\\")

    for row in rows.collect():
        assert row.y == strip(row.x)
        assert row.z == "/".join(strip(p) for p in (row.x[:2], row.x[2:4], row.x[4:6], row.x[6:8], row.x))
        assert row.p == "/".join(("pre", strip(row.z), strip(row.x + ".gz")))


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

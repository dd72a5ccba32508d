"""Exchanges and aggregates of plans that matter at scale, without automatic broadcasts."""

import pytest

from checks import adapters as a
from checks.coverage_queries import by_doi
from conftest import SF
from sheaf.functions import payload
from sheaf.functions.paths import storage_path
from sheaf.operators import attempts as att
from sheaf.operators import candidates
from sheaf.operators.coverage import intersect_harvested
from sheaf.plans.manifest import build_manifest
from sheaf.plans.processing import apply_processing
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def no_broadcast(conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_intersection_has_an_exchange_for_each_side(spark):
    classes = spark.createDataFrame([("10.1/a", True)], "doi string, oa boolean")
    text = plan(intersect_harvested(classes, a.status(spark, SF), "oa"))
    assert text.count("Exchange hashpartitioning") == 2
    assert intersect_harvested(by_doi(spark, SF), a.status(spark, SF), "oa").columns == ["doi"]


def test_outcomes_are_hash_aggregates(spark):
    built = build_manifest(a.records(spark, SF))
    steps = candidates.url_steps(built)
    codes = plan(att.step_codes(steps, a.captured_outcomes(spark, SF)))
    assert "HashAggregate" in codes and "SortAggregate" not in codes


def test_versions_join_the_status_once(spark):
    out = apply_processing(a.status(spark, SF).drop("line_no"), a.outputs(spark, SF), "0.8.9", "file")
    assert plan(out.status).count("SortMergeJoin") == 1
    assert out.unknown.count() == 0


def test_payloads_are_not_exchanged(spark, tmp_path):
    import json

    from sheaf.sinks.tables import write_payloads

    payloads = a.status(spark, SF).select(storage_path(F.col("uuid")).alias("path"), F.lit(b"%PDF-").alias("content"))
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("payloads", "write")
    write_payloads(payloads, str(tmp_path / "p"), digits=1)
    jobs = before.getJobIdsForGroup("payloads")
    spark.sparkContext.setJobGroup("", "")
    stages = [s for j in jobs for s in before.getJobInfo(j).stageIds]
    assert len(stages) == 1, json.dumps(stages)


def test_patterns_of_a_redirect_run_once(spark):
    pages = spark.createDataFrame([("<a id=redirect href='x&amp;y'>",)], "html string")
    found = pages.select(payload.redirect_target(F.col("html")).alias("target"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 1 and plan.count("regexp_extract_all(") <= 3 and plan.count("RLIKE") <= 2, plan
    assert found.first().target == "x&y"

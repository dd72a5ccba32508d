"""One key holding a third of the rows, and plans that must not put it in one task."""

import pytest
from pyspark.sql import functions as F

from checks import adapters as a
from conftest import SF
from sheaf.operators import attempts as att
from sheaf.operators import coverage, dedup, index
from sheaf.plans.manifest import build_manifest

ROWS = 9_000


@pytest.fixture
def skewed(spark):
    """A third of the rows have key 0; the order column repeats too."""
    return spark.range(ROWS).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("bigint").alias("k"),
        (F.col("id") * 7919 % 1000).alias("o"),
    )


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


def ranks(df, keys):
    """Positions by group, checked to be 0..n-1 in the order asked for."""
    groups = {}
    for row in df.collect():
        groups.setdefault(tuple(row[k] for k in keys), []).append((row["rank"], row["o"], row["id"]))
    for rows in groups.values():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(len(rows)))
        assert [(o, i) for _, o, i in rows] == sorted((o, i) for _, o, i in rows)
    return groups


@pytest.mark.parametrize("hot_rows", [10, 1_000, 1_000_000])
def test_rank_within(skewed, hot_rows):
    got = index.rank_within(skewed, ["k"], ["o", "id"], "rank", hot_rows)
    assert sum(len(rows) for rows in ranks(got, ["k"]).values()) == ROWS


def test_rank_within_a_null_group(skewed):
    rows = skewed.withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    got = index.rank_within(rows, ["k"], ["o", "id"], "rank", 100)
    groups = ranks(got, ["k"])
    assert sum(map(len, groups.values())) == ROWS and len(groups[(None,)]) >= ROWS // 3


def test_rank_within_counted_elsewhere(skewed):
    few = skewed.where("id < 3000")
    got = index.rank_within(few, ["k"], ["o", "id"], "rank", 500, counted=skewed)
    assert sum(map(len, ranks(got, ["k"]).values())) == 3_000


def test_group_index_by_shuffled_lookup(skewed, monkeypatch):
    monkeypatch.setattr("sheaf.session.BROADCAST_ROWS", 0)
    got = index.group_index(skewed, ["k"], ["o", "id"], "rank")
    assert sum(map(len, ranks(got, ["k"]).values())) == ROWS


def test_global_index_splits_equal_keys(spark):
    """Copies of one row are spread over the range partitions and still numbered densely."""
    copies = spark.range(4_000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("path")
    )
    placed = index._sorted_table(copies, ["path"], 8, unique=False)
    sizes = [row["count"] for row in placed.groupBy("__part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 4_000 / 3
    got = index.global_index(copies, ["path"], partitions=8).orderBy("idx").collect()
    assert [row.idx for row in got] == list(range(4_000))
    assert [row.path for row in got] == sorted(row.path for row in got)


def test_wrong_promise_of_unique_keys_keeps_the_result(skewed):
    got = index.global_index(skewed, ["k"], partitions=8, unique=True).orderBy("idx").collect()
    assert [row.idx for row in got] == list(range(ROWS))
    assert [row.k for row in got] == sorted(row.k for row in got)


def test_no_rows(spark):
    empty = spark.range(0).withColumn("k", F.lit(1))
    assert index.global_index(empty, ["id"]).count() == 0
    assert index.group_index(empty, ["k"], ["id"]).count() == 0
    assert index.rank_within(empty, ["k"], ["id"]).count() == 0


def test_first_by_limits_rows_before_the_exchange(skewed):
    first = dedup.first_by(skewed, ["k"], ["o", "id"])
    text = plan(first)
    below = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below and "Partial" in below
    assert first.where("k = 0").count() == 1


def test_manifest_has_one_exchange(spark):
    text = plan(build_manifest(a.records(spark, SF)))
    assert text.count("Exchange") == 1


def test_anti_join_uses_the_exchange_of_the_dedup(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    status = spark.createDataFrame([("10.1/x",)], "doi string")
    text = plan(build_manifest(a.records(spark, SF), harvested=status))
    assert "LeftAnti" in text and text.count("Exchange") == 2, "records and the distinct status DOIs"
    assert text.index("LeftAnti") < text.index("Window ["), "the dedup comes first"


def test_first_success_sends_one_row_per_key_and_task(spark):
    tries = spark.range(ROWS, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"),
        F.col("id").alias("n"),
        (F.col("id") % 5 == 4).alias("ok"),
        F.lit("standard").alias("channel"),
        F.col("id").cast("string").alias("url"),
    )
    done = att.first_success(tries, ["key"], ["n"])
    assert "partial_min_by" in plan(done)
    assert done.where("key = 0").first().url_used == "9"


def skew_conf(conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    )


def hot_records(spark):
    return spark.range(0, 60_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "10.1/hot").otherwise(F.concat(F.lit("10.1/"), F.col("id").cast("string"))).alias("doi"),
        F.md5(F.col("id").cast("string")).alias("line"),
    )


def test_anti_join_splits_a_hot_doi(spark, conf, monkeypatch):
    skew_conf(conf)
    monkeypatch.setattr("sheaf.session.BROADCAST_ROWS", 0)
    status = spark.range(0, 30_000, numPartitions=4).select(F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"))
    left = dedup.not_yet_harvested(hot_records(spark), status)
    assert "skew=true" in final_plan(left)
    assert left.count() == 20_000 + 20_000


def test_semi_join_splits_a_hot_doi(spark, conf, monkeypatch):
    skew_conf(conf)
    monkeypatch.setattr("sheaf.session.BROADCAST_ROWS", 0)
    wanted = spark.range(0, 30_000, numPartitions=4).select(F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"))
    kept = dedup.doi_allowlist(hot_records(spark), wanted.unionByName(spark.createDataFrame([("10.1/hot",)] * 9, "doi string")))
    assert "skew=true" in final_plan(kept)
    assert kept.count() == 20_000 + 20_000


def test_status_rows_of_a_hot_doi_are_split(spark, conf, monkeypatch):
    skew_conf(conf)
    monkeypatch.setattr("sheaf.session.BROADCAST_ROWS", 0)
    by_doi = spark.range(0, 30_000, numPartitions=4).select(
        F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"), F.lit(True).alias("oa"), F.lit(False).alias("ca")
    ).groupBy("doi").agg(F.bool_or("oa").alias("oa"), F.bool_or("ca").alias("ca"))
    flagged = coverage.harvest_flags(hot_records(spark), by_doi)
    assert "skew=true" in final_plan(flagged)
    assert flagged.where("oa").count() == 20_000 and flagged.count() == 60_000


def test_short_lists_spare_the_records_their_exchange(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    status = spark.createDataFrame([("10.1/1",)], "doi string")
    assert "Exchange hashpartitioning" not in plan(dedup.not_yet_harvested(hot_records(spark), status))


def test_lookup_side_splits_a_hot_url(spark, conf, monkeypatch):
    skew_conf(conf)
    monkeypatch.setattr("sheaf.session.BROADCAST_ROWS", 0)
    known = spark.range(0, 30_000, numPartitions=4).select(
        F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"), F.md5(F.col("id").cast("string")).alias("uuid")
    )
    entries = known.select(F.col("uuid").alias("id"), F.array(F.lit("json")).alias("resources"))
    kept = dedup.reprocess_filter(hot_records(spark), known, entries, True)
    assert "skew=true" in final_plan(kept)
    assert kept.count() == 60_000


def test_coverage_combines_flags_before_the_exchange(spark):
    classified = spark.range(ROWS, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("doi"),
        *[(F.col("id") % (n + 2) == 0).alias(c) for n, c in enumerate([*coverage.CLASSES, "hal"])],
    )
    grouped = coverage.per_doi(classified)
    text = plan(grouped)
    assert "partial_bool_or" in text or "partial_max" in text
    assert grouped.count() == ROWS - ROWS // 3 + 1


def test_status_scan_prunes(spark, tmp_path):
    from sheaf.sinks.status import write_status_shards
    from sheaf.sources.status import scan_status, scan_status_shards

    path = str(tmp_path / "status")
    write_status_shards(a.status(spark, SF), path, digits=1)
    text = plan(scan_status_shards(spark, path, ["0", "a"]))
    assert "PartitionFilters: [" in text and "shard" in text[text.index("PartitionFilters"):]
    pruned = plan(scan_status(spark, path, ["uuid"]))
    assert "ReadSchema: struct<uuid:string>" in pruned

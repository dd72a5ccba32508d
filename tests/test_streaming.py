"""Several micro-batches, replays and late rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks import adapters as a
from checks.io_queries import DUMP
from conftest import SF
from sheaf.plans.manifest import build_manifest
from sheaf.schemas import STATUS, VERSION_EVENT
from sheaf.operators.status import apply_versions
from sheaf.sinks.status import write_status_shards
from sheaf.sources.status import scan_status_shards
from sheaf.streaming import jobs

PUB = ["id", "doi", "domain", "urls", "filename"]


def rows(df):
    return sorted(map(str, df.collect()))


def test_manifest_over_runs(spark, tmp_path):
    """Two dumps in two runs give what one batch over both gives."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    records = a.records(spark, SF)
    middle = records.selectExpr("max(line_no) / 2 as m").first().m

    def run():
        stream = spark.readStream.schema(DUMP).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_manifest(stream, out).awaitTermination()

    records.where(F.col("line_no") < middle).coalesce(1).write.mode("append").parquet(source)
    run()
    early = jobs.read_manifest(spark, out).count()
    records.where(F.col("line_no") >= middle).coalesce(1).write.mode("append").parquet(source)
    # The dump that came first comes again under another name: nothing is new in it.
    records.where(F.col("line_no") < middle).coalesce(1).write.mode("append").parquet(source)
    run()
    got = jobs.read_manifest(spark, out)
    assert 0 < early < got.count()
    assert rows(got.select(PUB)) == rows(build_manifest(records).select(PUB))
    index = jobs.read_batches(spark, f"{out}/index", jobs.INDEX)
    assert index.count() == index.select("doi").distinct().count()


def test_upsert_over_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "status")
    status, events = a.status(spark, SF).select(*STATUS.names), a.version_events(spark, SF)
    write_status_shards(status, path, digits=1)

    def run():
        stream = spark.readStream.schema(VERSION_EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_upsert(stream, path, str(tmp_path / "state"), digits=1).awaitTermination()

    for part in range(2):
        events.where(F.abs(F.hash("uuid")) % 2 == part).coalesce(1).write.mode("append").parquet(source)
        run()
    want = rows(apply_versions(status, events))
    assert rows(scan_status_shards(spark, path)) == want
    # The same events once more change nothing.
    events.coalesce(1).write.mode("append").parquet(source)
    run()
    assert rows(scan_status_shards(spark, path)) == want


def test_upsert_takes_events_out_of_order(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "status")
    status = a.status(spark, SF).select(*STATUS.names)
    write_status_shards(status, path, digits=1)
    uuid = status.where("uuid is not null").orderBy("uuid").first().uuid
    before = list((tmp_path.parent).glob("**/sheaf-events-*"))

    def run(*events):
        rows = [(seq, uuid, service, version) for seq, service, version in events]
        spark.createDataFrame(rows, VERSION_EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(VERSION_EVENT).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_upsert(stream, path, str(tmp_path / "state")).awaitTermination()
        row = scan_status_shards(spark, path).where(F.col("uuid") == uuid).first()
        return row.grobid_version, row.softcite_version

    old = status.where(F.col("uuid") == uuid).first()
    assert run((10, "grobid", "0.9")) == ("0.9", old.softcite_version)
    assert run((5, "grobid", "0.1"), (6, "softcite", "0.2")) == ("0.9", "0.2")
    assert run((11, "grobid", "1.0"), (4, "softcite", "0.0")) == ("1.0", "0.2")
    assert scan_status_shards(spark, path).count() == status.count()
    assert list((tmp_path.parent).glob("**/sheaf-events-*")) == before


def test_rate_in_windows_of_each_client(spark):
    start = datetime(2024, 1, 1)
    data = [(c, start + timedelta(seconds=s)) for c in ("second", "long", "other") for s in range(10)]
    requests = spark.createDataFrame(data, "client string, ts timestamp")
    got = jobs.request_rate(requests, {"second": (1, 1), "long": (9, 15)}, 7, default_max=7).collect()
    assert sorted((r.client, int((r.window_start - start).total_seconds()), r.n, r.over_limit) for r in got) == sorted(
        [("second", s, 1, False) for s in range(10)] + [("long", 0, 10, True)]
        + [("other", s, n, False) for s, n in other_windows(start, 10)]
    )


def other_windows(start, seconds, size=7):
    from collections import Counter

    zero = int((start - datetime(1970, 1, 1)).total_seconds())
    found = Counter((zero + s) // size * size - zero for s in range(seconds))
    return list(found.items())


def test_rate_counts_across_batches_and_drops_late_rows(spark, tmp_path):
    source, out, late = str(tmp_path / "in"), str(tmp_path / "out"), []
    start = datetime(2024, 1, 1)

    def write(*offsets):
        data = [("w", start + timedelta(seconds=s)) for s in offsets]
        spark.createDataFrame(data, "client string, ts timestamp").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("client string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = jobs.stream_request_rate(stream, out, {"w": (2, 15)}, 15, delay="30 seconds")
        query.awaitTermination()
        late.append(jobs.late_rows(query))

    def counts():
        got = jobs.read_request_rate(spark, out).collect()
        return {int((r.window_start - start).total_seconds()): (r.n, r.over_limit) for r in got}

    write(0, 1, 16)
    run()
    assert counts() == {0: (2, False), 15: (1, False)}
    write(2, 200)
    run()
    assert counts() == {0: (3, True), 15: (1, False), 195: (1, False)}
    write(3, 190, 201)
    run()
    # The row at 3 s is later than the delay allows; the one at 190 s is not.
    assert counts() == {0: (3, True), 15: (1, False), 180: (1, False), 195: (2, False)}
    assert sum(late) == 1


def test_rate_keeps_state_for_the_longest_window_only(spark, tmp_path):
    """Lengths without a common factor: what is over goes, it is not kept for a common multiple of them."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    start, held = datetime(2024, 1, 1), []
    for step in range(4):
        data = [(c, start + timedelta(seconds=4_000 * step + s)) for c in ("a", "b", "other") for s in range(0, 600, 7)]
        spark.createDataFrame(data, "client string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("client string, ts timestamp").parquet(source)
        query = jobs.stream_request_rate(stream, out, {"a": (1, 599), "b": (1, 601)}, 7, delay="10 seconds")
        query.awaitTermination()
        held.append(max(state["numRowsTotal"] for p in query.recentProgress for state in p["stateOperators"]))
    assert max(held[2:]) <= 2 * max(held[:2])
    got = jobs.read_request_rate(spark, out)
    assert got.agg(F.sum("n")).first()[0] == 4 * 3 * len(range(0, 600, 7))

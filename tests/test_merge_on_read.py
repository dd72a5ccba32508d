"""The log of version events and the manifest stream whose DOIs are state."""

import os
import random

import pytest
from pyspark.sql import functions as F

from checks import adapters as a
from checks.io_queries import DUMP
from conftest import SF
from sheaf.operators.status import apply_versions
from sheaf.plans.manifest import build_manifest
from sheaf.schemas import STATUS, VERSION_EVENT
from sheaf.sinks import version_log as log
from sheaf.sinks.status import write_status_shards
from sheaf.streaming import jobs

SERVICES = ("grobid", "softcite", "datastet")


def rows(df):
    return sorted(map(str, df.collect()))


def files(path):
    return {f: os.path.getsize(f) for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    status = a.status(spark, SF).select(*STATUS.names)
    path = str(tmp_path / "status")
    write_status_shards(status, path, digits=1)
    uuids = [r.uuid for r in status.where("uuid is not null").select("uuid").distinct().orderBy("uuid").collect()]
    return status, path, str(tmp_path / "log"), uuids


def batches(uuids, seed=1, n=6, size=40):
    own, seqs = random.Random(seed), random.Random(seed + 1).sample(range(10_000), n * size)
    out = []
    for k in range(n):
        batch = [(s, own.choice(uuids), own.choice(SERVICES), own.choice([f"0.{s}", None])) for s in seqs[k * size : (k + 1) * size]]
        out.append([*batch, (50_000 + k, "no such uuid", "grobid", "1"), (k, None, "grobid", "1")])
    return out


def test_a_batch_writes_its_own_events_only(spark, table):
    status, path, folder, uuids = table
    before, events = files(path), batches(uuids)
    assert rows(log.scan_status_merged(spark, path, folder)) == rows(status), "no log yet"
    taken = []
    for k, batch in enumerate(events):
        known = files(folder)
        log.append_versions(spark.createDataFrame(batch, VERSION_EVENT), folder, k)
        grown = files(folder)
        assert known.items() <= grown.items()
        assert sum(grown.values()) - sum(known.values()) < 3_000 * 17, "a small file for each shard, whatever is there"
        taken += batch
        want = apply_versions(status, log.newest_events(spark.createDataFrame(taken, VERSION_EVENT)))
        assert rows(log.scan_status_merged(spark, path, folder)) == rows(want)
    log.append_versions(spark.createDataFrame(events[1], VERSION_EVENT), folder, 1)
    assert sorted(map(os.path.dirname, files(folder))) == sorted(map(os.path.dirname, grown)), "a batch replaces itself"
    assert rows(log.scan_status_merged(spark, path, folder)) == rows(want)
    assert files(path) == before, "the status table is not written"


@pytest.mark.parametrize("broken", ["write", "first delete", "later delete"])
def test_compaction_that_breaks_off(spark, table, monkeypatch, broken):
    status, path, folder, uuids = table
    events = batches(uuids, seed=7)
    for k, batch in enumerate(events):
        log.append_versions(spark.createDataFrame(batch, VERSION_EVENT), folder, k)
    want = rows(log.scan_status_merged(spark, path, folder))
    done, whole = [0], {"write": log._write, "delete": log.delete_path}

    def fails(*args):
        done[0] += 1
        if broken != "later delete" or done[0] > 9:
            if broken == "write":
                whole["write"](args[0].where("hash(uuid) % 2 = 0"), *args[1:])  # some of it is there
            raise OSError("broken off")
        whole["delete"](*args)

    monkeypatch.setattr(log, "_write" if broken == "write" else "delete_path", fails)
    with pytest.raises(OSError, match="broken off"):
        log.compact_versions(spark, folder, max_bytes=0)
    assert rows(log.scan_status_merged(spark, path, folder)) == want
    monkeypatch.setattr(log, "_write", whole["write"])
    monkeypatch.setattr(log, "delete_path", whole["delete"])
    log.append_versions(spark.createDataFrame(events[0], VERSION_EVENT), folder, 0)  # comes again, late
    assert rows(log.scan_status_merged(spark, path, folder)) == want
    _, uuid, service, _ = events[2][0]
    log.append_versions(spark.createDataFrame([(-1, uuid, service, "old")], VERSION_EVENT), folder, 6)
    log.compact_versions(spark, folder, max_bytes=0)
    assert rows(log.scan_status_merged(spark, path, folder)) == want
    assert all(len(b) <= 2 for b in log.log_sizes(spark, folder).values())
    assert log.compact_versions(spark, folder) == [], "small ones are left"


def test_stream_of_versions(spark, table, tmp_path):
    status, path, folder, uuids = table
    taken = []
    for batch in batches(uuids, seed=3, n=3):
        spark.createDataFrame(batch, VERSION_EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        taken += batch
        stream = spark.readStream.schema(VERSION_EVENT).parquet(str(tmp_path / "in"))
        jobs.stream_version_log(stream, folder, str(tmp_path / "state"), compact_bytes=2_000).awaitTermination()
        want = apply_versions(status, log.newest_events(spark.createDataFrame(taken, VERSION_EVENT)))
        assert rows(log.scan_status_merged(spark, path, folder)) == rows(want)


PUB = ["id", "doi", "domain", "urls", "filename"]


def test_known_dois_are_state_and_batches_that_are_done_may_go(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    records = a.records(spark, SF)
    last = records.selectExpr("max(line_no) as m").first().m
    taken, read = None, []
    for part in range(4):
        own = records.where((F.col("line_no") * 4 >= part * (last + 1)) & (F.col("line_no") * 4 < (part + 1) * (last + 1)))
        repeated = records.where(F.col("line_no") * 4 < min(part, 1) * (last + 1))
        own.unionByName(repeated).coalesce(1).write.mode("append").parquet(source)
        taken = own if taken is None else taken.unionByName(own)
        stream = spark.readStream.schema(DUMP).option("maxFilesPerTrigger", 1).parquet(source)
        query = jobs.stream_manifest_state(stream, out)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        got = jobs.read_manifest(spark, out)
        assert rows(got.select(PUB)) == rows(build_manifest(taken).select(PUB))
        # nothing but the state tells the DOIs of this batch from now on
        for name in os.listdir(f"{out}/firsts"):
            if name != "batch=-1":
                spark.createDataFrame([], "doi string").write.mode("overwrite").parquet(f"{out}/firsts/{name}")
    assert max(read[2:]) < 2 * max(read[:2]), "as many rows as are new, not as there are"
    assert len(os.listdir(f"{out}/progress")) <= 2


def test_a_batch_of_the_manifest_that_runs_again(spark, tmp_path):
    """The second query loses its last commit and takes the batch once more."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    records = a.records(spark, SF)

    def run():
        stream = spark.readStream.schema(DUMP).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_manifest_state(stream, out).awaitTermination()
        return rows(jobs.read_manifest(spark, out).select(PUB))

    for part in range(2):
        records.where(f"line_no % 2 = {part}").coalesce(1).write.mode("append").parquet(source)
        before = run()
    commits = f"{out}/checkpoint/commits"
    newest = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (f"{commits}/{newest}", f"{commits}/.{newest}.crc"):
        if os.path.exists(name):
            os.remove(name)
    assert run() == before

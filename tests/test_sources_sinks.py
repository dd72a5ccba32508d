"""Files read and written."""

import gzip
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks import adapters as a
from conftest import SF
from sheaf.operators import backlog, index
from sheaf.operators.annotate import annotate
from sheaf.schemas import STATUS
from sheaf.sinks import status as status_sink
from sheaf.sinks import tables as sinks
from sheaf.sources import objects as obj
from sheaf.sources import publications as pubs
from sheaf.sources import status as status_source


def gz(path, *lines, end="\n"):
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write("\n".join(lines) + end)
    return str(path)


def test_scan_keeps_absent_and_null_apart(spark, tmp_path):
    line = json.dumps({"doi": "10.1/é", "oa_details": {"2021": {"is_oa": True, "oa_locations": [{"a": None}, {"b": "x"}]}}})
    row = pubs.scan_publications(spark, gz(tmp_path / "d.jsonl.gz", line)).first()
    assert row.doi == "10.1/é"
    first, second = row.oa_details["2021"].oa_locations
    assert first == {"a": None} and second == {"b": "x"}


def test_bad_lines(spark, tmp_path):
    path = gz(tmp_path / "d.jsonl.gz", '{"doi": "a"}', '{"doi": ')
    with pytest.raises(Exception):
        pubs.scan_publications(spark, path).collect()
    kept = pubs.scan_publications(spark, path, bad_lines="keep").select("doi", "_corrupt_record").collect()
    assert sorted(map(str, kept)) == sorted(map(str, kept)) and len(kept) == 2
    assert [row.doi for row in kept if row._corrupt_record is None] == ["a"]
    with pytest.raises(ValueError):
        pubs.scan_publications(spark, path, bad_lines="other")


def test_bad_lines_of_parsed_dumps(spark, tmp_path):
    path = gz(tmp_path / "d.gz", '{"doi": "10.1/a", "bso_country_corrected": ["fr"]}', "not json", '{"doi": "10.1/b", "bso_country_corrected": "fr"}', "", '{"doi": ')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        pubs.parse_lines(pubs.scan_lines(spark, path)).collect()
    with pytest.raises(Exception, match="(?is)malformed|failed"):
        sinks.write_dump(spark, path, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="other"):
        pubs.parse_lines(pubs.scan_lines(spark, path), bad_lines="other")
    sinks.write_dump(spark, path, str(tmp_path / "kept"), bad_lines="keep")
    rows = spark.read.parquet(str(tmp_path / "kept")).orderBy("scan_seq").collect()
    assert [(r.doi, r.bso_country_corrected, r._corrupt_record) for r in rows] == [
        ("10.1/a", ["fr"], None), (None, None, "not json"), ("10.1/b", None, None), (None, None, None), (None, None, '{"doi": '),
    ]
    assert pubs.scan_dump(spark, str(tmp_path / "kept")).where("doi is not null").count() == 2



def test_counts(spark, tmp_path):
    gz(tmp_path / "a.jsonl.gz", "{}", "{}", "{}")
    gz(tmp_path / "b.jsonl.gz", "{}", "{}", end="")
    assert pubs.count_records(spark, str(tmp_path / "a.jsonl.gz")).first().n == 3
    assert pubs.count_records(spark, str(tmp_path / "b.jsonl.gz")).first().n == 2
    assert pubs.count_records(spark, str(tmp_path / "*.gz")).first().n == 5
    with pytest.raises(AnalysisException):
        pubs.count_records(spark, str(tmp_path / "missing.gz")).collect()


def test_line_index_over_files_and_blocks(spark, conf, tmp_path):
    """Plain files are cut into many blocks, gzip files are not; numbering crosses both."""
    conf(spark__sql__files__maxPartitionBytes="256", spark__sql__files__openCostInBytes="0")
    want = []
    for name, lines in (("a.txt", 100), ("c.txt", 57)):
        (tmp_path / name).write_text("".join(f"{name}-{n}-{'x' * (n % 13)}\n" for n in range(lines)))
        want += (tmp_path / name).read_text().splitlines()
    gz(tmp_path / "b.txt.gz", *[f"b-{n}" for n in range(40)])
    want[100:100] = [f"b-{n}" for n in range(40)]
    scanned = pubs.scan_lines(spark, str(tmp_path))
    assert scanned.select("block_start").distinct().count() > 5
    got = index.line_index(scanned).orderBy("idx").collect()
    assert [row.value for row in got] == want
    assert [row.idx for row in got] == list(range(len(want)))


def test_raw_lines_are_written_back_unchanged(spark, tmp_path):
    lines = ['{"doi": "a", "unknown": [1, {"x": null}]}', '{"doi":"b" }']
    scanned = pubs.parse_lines(pubs.scan_lines(spark, gz(tmp_path / "d.gz", *lines)))
    sinks.write_lines(scanned.where("doi <> ''"), str(tmp_path / "out"))
    assert sorted(row.value for row in spark.read.text(str(tmp_path / "out")).collect()) == sorted(lines)


def test_status_csv_keeps_quotes_and_nulls(spark, tmp_path):
    from datetime import datetime

    rows = [
        ('10.1/a"b,c', "u1", "1", None, "0.7", "std", "dom, with comma", 'http://x/"q"', datetime(2022, 6, 24, 19, 0, 0, 123456), None),
        ("10.1/\\back", "u2", "1", "", "0", "std", "back\\", "u", None, "0"),
    ]
    table = spark.createDataFrame(rows, STATUS)
    status_sink.export_status_csv(table, str(tmp_path / "csv"))
    back = status_source.scan_status_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    text = sorted(row.value for row in spark.read.text(str(tmp_path / "csv")).collect())
    assert text[0].startswith('"10.1/a""b,c",u1,1,,0.7')


def test_status_csv_reads_whole_seconds(spark, tmp_path):
    (tmp_path / "s.csv").write_text("d,u,1,0,0,std,dom,url,2022-06-24 19:00:00,0\n")
    row = status_source.scan_status_csv(spark, str(tmp_path / "s.csv")).first()
    assert row.harvesting_date.isoformat() == "2022-06-24T19:00:00"


def test_uuid_ranges_cover_every_row_once(spark):
    values = [(v,) for v in [None, "", "-", "0", "0a", "1", "9f", "a", "af", "f", "ff", "g", "Z", "é"]]
    rows = spark.createDataFrame(values, "uuid string")
    found = [sorted(str(r.uuid) for r in rows.where(c).collect()) for c in status_source.uuid_ranges()]
    assert len(found) == 16 and sorted(sum(found, [])) == sorted(str(v) for (v,) in values)


def test_shards_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "status")
    table = a.status(spark, SF).select(*STATUS.names)
    status_sink.write_status_shards(table, path, digits=1)
    incoming = table.where("uuid like 'a%'").withColumn("grobid_version", F.lit("9")).unionByName(
        table.limit(1).withColumn("uuid", F.lit("a-new")).withColumn("doi", F.lit("10.1/new"))
    )
    status_sink.upsert_status_shards(spark, path, incoming, digits=1)
    back = status_source.scan_status_shards(spark, path)
    assert back.count() == table.count() + 1
    assert back.where("uuid like 'a%' and uuid <> 'a-new'").select("grobid_version").distinct().collect() == [("9",)]
    assert back.where("uuid not like 'a%' and grobid_version = '9'").count() == 0
    assert status_source.scan_status_shards(spark, path, ["a"]).where("uuid not like 'a%'").count() == 0


def test_shards_keep_their_width(spark, tmp_path):
    path, table = str(tmp_path / "status"), a.status(spark, SF).select(*STATUS.names)
    status_sink.write_status_shards(table, path, digits=1)
    for write in (
        lambda: status_sink.upsert_status_shards(spark, path, table.limit(5), digits=2),
        lambda: status_sink.write_status_shards(table, path, digits=2),
    ):
        with pytest.raises(ValueError):
            write()
    status_sink.upsert_status_shards(spark, path, table.limit(5))
    back = status_source.scan_status_shards(spark, path)
    assert back.count() == back.select("uuid").distinct().count() == table.count()


def test_a_country_that_is_no_array_drops_the_record(spark, tmp_path):
    from sheaf.plans.manifest import build_manifest

    lines = [
        '{"doi": "10.1/a", "publisher_normalized": "Wiley", "bso_country_corrected": ["fr"], "oa_details": {"2020": {"is_oa": false}}}',
        '{"doi": "10.1/b", "publisher_normalized": "Wiley", "bso_country_corrected": "fr", "oa_details": {"2020": {"is_oa": false}}}',
        '{"doi": "10.1/c", "publisher_normalized": "Wiley", "bso_country_corrected": null, "oa_details": {"2020": {"is_oa": false}}}',
        '{"doi": "10.1/d", "publisher_normalized": "Wiley", "bso_country_corrected": 7}',
    ]
    path = tmp_path / "dump.jsonl"
    path.write_text("\n".join(lines) + "\n")
    records = pubs.scan_publications(spark, str(path), position=True)
    assert [r.bso_country_corrected for r in records.orderBy("doi").collect()] == [["fr"], None, None, None]
    assert [r.doi for r in build_manifest(records, order_by=pubs.DUMP_ORDER).collect()] == ["10.1/a"]
    assert pubs.count_records(spark, str(path)).first().n == 4
    parsed = pubs.parse_lines(pubs.scan_lines(spark, str(path)))
    assert [r.bso_country_corrected for r in parsed.orderBy("doi").collect()] == [["fr"], None, None, None]
    path.write_text("no json\n")
    with pytest.raises(Exception):
        pubs.scan_publications(spark, str(path)).collect()


def test_annotate_takes_bounded_batches(spark):
    import pandas as pd

    from sheaf.operators.annotate import annotate

    files = spark.range(40).selectExpr("cast(id as string) as uuid", "'grobid' as service", "repeat('x', 100000) as content").coalesce(1)

    def note(rows):
        return pd.DataFrame({"uuid": rows["uuid"], "version": str(rows["content"].str.len().sum())})

    sizes = [int(r.version) for r in annotate(files, {"grobid": note}, batch_bytes=350_000).collect()]
    assert len(sizes) == 40 and max(sizes) <= 350_000
    assert annotate(files, {"grobid": note}, batch_bytes=10).count() == 40
    for service in ("null", "'other'"):
        with pytest.raises(Exception):
            annotate(files.selectExpr("uuid", f"cast({service} as string) as service", "content"), {"grobid": note}).collect()


def test_service_outputs_from_files(spark, tmp_path):
    folder = tmp_path / "out"
    (folder / "sub").mkdir(parents=True)
    (folder / "u1.software.json").write_text('{"mentions": [],\n "version": "0.7.2"}')
    (folder / "sub" / "u2.dataset.json").write_text('{"version": "0.7.3"}')
    (folder / "u3.tei.xml").write_text("<TEI/>")
    (folder / "u4.pdf").write_text("%PDF-")
    found = backlog.output_versions(obj.scan_service_outputs(spark, str(folder)), "0.8.0")
    assert sorted((r.uuid, r.service, r.version) for r in found.collect()) == [
        ("u1", "softcite", "0.7.2"), ("u2", "datastet", "0.7.3"), ("u3", "grobid", "0.8.0"),
    ]


def test_scan_folder_lists_names(spark, tmp_path):
    for name in ("publication/aa/1.pdf.gz", "publication/ab/2.pdf.gz", "metadata/aa/1.json.gz"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = sorted(row.path for row in obj.scan_folder(spark, str(tmp_path)).collect())
    assert names == ["metadata/aa/1.json.gz", "publication/aa/1.pdf.gz", "publication/ab/2.pdf.gz"]
    assert obj.scan_folder(spark, str(tmp_path), "publication/aa").count() == 1


def test_payloads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1\x00\xff")
    (tmp_path / "b.txt").write_bytes(b"no")
    row, = obj.scan_payloads(spark, str(tmp_path), "*.pdf").collect()
    assert bytes(row.content) == b"%PDF-1\x00\xff" and row.length == 8


def test_annotate_spreads_and_checks(spark):
    files = spark.range(100).select(
        F.col("id").cast("string").alias("uuid"), F.when(F.col("id") % 2 == 0, "grobid").otherwise("softcite").alias("service")
    )
    versions = {s: (lambda v: lambda rows: {"uuid": rows["uuid"], "version": [v] * len(rows)})(s + "-1") for s in ("grobid", "softcite")}
    got = annotate(files, versions, partitions=4)
    assert got.where("service = 'grobid' and version = 'grobid-1'").count() == 50
    assert got.select("uuid").distinct().count() == 100
    with pytest.raises(Exception, match="no function for service"):
        annotate(files, {"grobid": versions["grobid"]}).collect()


def test_release_deletes_only_what_this_application_made(spark, monkeypatch, tmp_path):
    import os

    from sheaf import session

    monkeypatch.setattr(session, "_SCRATCH", {})
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    (tmp_path / "sheaf-other").mkdir()
    session.durable(spark.range(3))
    assert len(os.listdir(tmp_path)) == 2
    assert session.release(spark) == 1
    assert os.listdir(tmp_path) == ["sheaf-other"]


class Unset:
    """Stands for a session without a named folder."""

    def __init__(self, master, at_run_time=None):
        from types import SimpleNamespace

        self.conf = SimpleNamespace(get=lambda key, default: default)
        self.sparkContext = SimpleNamespace(
            master=master, applicationId=f"test-{master}", getCheckpointDir=lambda: at_run_time
        )


def test_shared_folder_when_none_is_named():
    from sheaf.session import shared_folder

    local = shared_folder(Unset("local[2]"))
    assert local == shared_folder(Unset("local[2]"))
    assert shared_folder(Unset("yarn", "hdfs://x/ck/")) == "hdfs://x/ck"
    with pytest.raises(ValueError):
        shared_folder(Unset("yarn"))


def test_shared_folder_is_seen_by_executors(spark, tmp_path):
    from sheaf import session

    assert session._seen_by_executors(spark, str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    master = spark.sparkContext.master
    try:
        spark.sparkContext.master = "spark://host:7077"
        assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
        key = f"{spark.sparkContext.applicationId}|{session.shared_folder(spark)}"
        session._SEEN[key] = False  # as on machines that do not share the folder
        with pytest.raises(ValueError):
            session.shared_folder(spark)
    finally:
        spark.sparkContext.master = master
        session._SEEN.clear()


def test_dump_order_decides_the_first_record(spark, conf, tmp_path):
    from sheaf.plans.manifest import build_manifest

    conf(spark__sql__files__maxPartitionBytes="2000", spark__sql__files__openCostInBytes="0")

    def line(doi, url):
        location = {"host_type": "publisher", "url_for_pdf": url}
        return json.dumps(
            {"doi": doi, "bso_country_corrected": ["fr"], "oa_details": {"2021": {"is_oa": True, "oa_locations": [location]}}}
        )

    for name, start in (("b.jsonl", 100), ("a.jsonl", 0)):
        lines = [line(f"10.1/{n % 20}", f"https://x/{start + n}") for n in range(100)]
        (tmp_path / name).write_text("\n".join(lines))
    records = pubs.scan_publications(spark, str(tmp_path / "*.jsonl"), position=True)
    assert records.select("block_start").distinct().count() > 3
    built = build_manifest(records, order_by=pubs.DUMP_ORDER)
    assert {row.doi: row.urls for row in built.collect()} == {f"10.1/{n}": [f"https://x/{n}"] for n in range(20)}


def test_status_files_from_before_a_column(spark, tmp_path):
    from sheaf.operators.status import devolve_status

    table = a.status(spark, SF).select(*STATUS.names)
    devolve_status(table.limit(5)).write.parquet(str(tmp_path / "s"))
    table.limit(3).write.mode("append").parquet(str(tmp_path / "s"))
    read = status_source.scan_status(spark, str(tmp_path / "s"))
    assert read.schema.names == STATUS.names and read.count() == 8
    assert read.where("harvesting_date is null").count() == 5


def test_stored_inputs_have_more_files_for_more_rows(spark, monkeypatch):
    from checks import adapters as a
    from conftest import SF

    monkeypatch.setattr(a, "_TABLES", {})
    monkeypatch.setattr(a, "FILE_ORDERS", 100)
    assert len(a.pubs(spark, SF).inputFiles()) >= 15
    plans = a.records.__wrapped__(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plans, "records are made where their publications are"
    assert len(a.records(spark, SF).inputFiles()) > 0
    assert a.records(spark, SF).count() == a.pubs(spark, SF).count() == 1_500


def test_records_are_compiled_and_made_by_a_task_for_each_file(spark, conf, monkeypatch):
    """However many files would go into one task; element functions (transform, filter, exists) are not compiled."""
    from checks import adapters as a
    from conftest import SF

    conf(spark__sql__files__minPartitionNum="1")
    monkeypatch.setattr(a, "_TABLES", {})
    monkeypatch.setattr(a, "FILE_ORDERS", 100)
    files = len(a.pubs(spark, SF).inputFiles())
    with a.settings(spark, a.INSIDE_ROWS):
        assert "lambda" not in a.records.__wrapped__(spark, SF)._jdf.queryExecution().executedPlan().toString()
    before = {key: spark.conf.get(key) for key in a.INSIDE_ROWS}
    assert files >= 15 and len(a.records(spark, SF).inputFiles()) == files
    assert before == {key: spark.conf.get(key) for key in a.INSIDE_ROWS}


def test_inputs_dealt_by_a_key_are_sent_once(spark, monkeypatch):
    """Status rows and captures stay where their DOI or URL was sent to; they have files as others have."""
    from checks import adapters as a
    from conftest import SF

    monkeypatch.setattr(a, "_TABLES", {})
    monkeypatch.setattr(a, "FILE_ORDERS", 200)
    for build in (a.status, a.captured_outcomes):
        plans = build.__wrapped__(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plans.count("Exchange hashpartitioning") == 1 and "RoundRobin" not in plans
        assert len(build(spark, SF).inputFiles()) == 8


def test_durable_tables_are_compressed_with_zstd(spark):
    from sheaf.session import durable

    assert all(f.endswith(".zstd.parquet") for f in durable(spark.range(9)).inputFiles())
    assert all(f.endswith(".snappy.parquet") for f in durable(spark.range(9), codec=None).inputFiles())


def test_a_dump_of_the_streams_is_written_by_several_tasks(spark):
    import os

    from checks.io_queries import over_dumps
    from checks.queries import QUERIES
    from conftest import SF

    class Idle:
        def awaitTermination(self):
            pass

    seen = []
    over_dumps(spark, SF, lambda stream: seen.append(len(stream.sparkSession.read.parquet(folder(stream)).inputFiles())) or Idle())
    assert seen[0] > 1 and seen[1] > seen[0] + 1 and seen[2] > seen[1] + 1
    for name in ("stream_manifest", "stream_manifest_state"):
        ids = [r.id for r in QUERIES[name](spark, SF).select("id").distinct().collect()]
        assert len(ids) == QUERIES["build_manifest"](spark, SF).select("id").distinct().count()


def folder(stream):
    import re

    return re.search(r"(file:\S*sheaf-stream-in-\w+|/\S*sheaf-stream-in-\w+)", stream._jdf.queryExecution().toString()).group(1)


def test_a_large_dump_is_spread_over_more_partitions(spark, tmp_path, monkeypatch):
    from sheaf.sources import publications

    for name in ("a", "b"):
        (tmp_path / f"dump-{name}.jsonl").write_text('{"doi": "10.1/x"}\n' * 50)
    paths = [str(tmp_path / "dump-a.jsonl"), str(tmp_path / "dump-[b]*")]
    for most, parts in ((publications.SPREAD_BYTES, 3), (100, 18)):
        monkeypatch.setattr(publications, "SPREAD_BYTES", most)
        records = publications.scan_publications(spark, paths, spread=3)
        assert records.rdd.getNumPartitions() == parts and records.count() == 100

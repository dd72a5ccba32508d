"""Sources, sinks and streams: written from the given tables, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as a
from checks.files import in_parts
from checks.registry import query
from checks.sql import path_of, statement
from checks.status_queries import APPLIED, NOW, TS, _COLUMNS, _plain
from checks.manifest_queries import ANCHORED_LIMITS, ANCHORED_SQL, with_resolved
from sheaf.functions import paths, records as r
from sheaf.operators import attempts as att
from sheaf.operators import backlog as b
from sheaf.operators import candidates as cand
from sheaf.operators import coverage as c
from sheaf.operators import dedup
from sheaf.operators.index import global_index, line_index, slice_ids
from sheaf.operators.ledger import failure_rows, ledger_rows
from sheaf.plans import manifest as m
from sheaf.schemas import PUBLICATION, STATUS, VERSION_EVENT
from sheaf.session import durable, scratch
from sheaf.sinks import packs
from sheaf.sinks import status as status_sink
from sheaf.sinks import tables as sinks
from sheaf.sinks import version_log
from sheaf.sources import objects as obj
from sheaf.sources import publications as pubs
from sheaf.sources import status as status_source
from sheaf.streaming import jobs

from pyspark.sql import types as T

# The dumps carry the line number as a field of its own, so that rows can be told apart.
DUMP = T.StructType([T.StructField("line_no", T.LongType()), *PUBLICATION])


def _dump(spark, sf, label, records=None):
    path = scratch(spark, label)
    sinks.write_manifest(a.records(spark, sf) if records is None else records, path)
    return path


RECORDS = """select r.line_no, doi, publisher_normalized, domain, is_fr, l.obs_key, coalesce(l.is_oa, false) as is_oa
from rec r left join rlatest l using (line_no)"""


def _seen(records):
    details = F.col("oa_details")
    return records.select(
        "line_no",
        "doi",
        "publisher_normalized",
        F.col("bso_classification").alias("domain"),
        r.in_country(F.col("bso_country_corrected")).alias("is_fr"),
        r.latest_key(details).alias("obs_key"),
        F.coalesce(r.latest_observation(details)["is_oa"], F.lit(False)).alias("is_oa"),
    )


@query("scan_publications", statement(RECORDS, "rec", "rlatest"))
def scan_publications(spark, sf):
    return _seen(pubs.scan_publications(spark, _dump(spark, sf, "dump"), DUMP, spread=8))


@query("scan_many", statement(RECORDS, "rec", "rlatest"))
def scan_many(spark, sf):
    folder = scratch(spark, "dumps")
    for part in range(3):
        sinks.write_manifest(a.records(spark, sf).where(F.col("line_no") % 3 == part), f"{folder}/dump-{part}")
    return _seen(pubs.scan_publications(spark, f"{folder}/dump-*", DUMP))


@query("convert_dump", statement(RECORDS, "rec", "rlatest"))
def convert_dump(spark, sf):
    path = scratch(spark, "dump-parquet")
    sinks.write_dump(spark, _dump(spark, sf, "dump"), path, DUMP)
    return _seen(pubs.scan_dump(spark, path, DUMP))


@query(
    "write_slices",
    """select o_orderkey as line_no, row_number() over (order by o_orderkey) - 1 as idx,
  least((row_number() over (order by o_orderkey) - 1) // (count(*) over () // 13), 13) as slice_id from orders""",
)
def write_slices(spark, sf):
    path = scratch(spark, "slices")
    lines = a.table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no"))
    sinks.write_slices(global_index(lines, ["line_no"], unique=True), 13, path)
    return spark.read.schema("line_no bigint, idx bigint, slice_id bigint").parquet(path)


@query("count_records", "select count(*) as n from orders")
def count_records(spark, sf):
    return pubs.count_records(spark, _dump(spark, sf, "dump"))


@query(
    "line_index",
    """select o_orderkey as line_no, row_number() over (order by o_orderkey) - 1 as idx,
  least((row_number() over (order by o_orderkey) - 1) // (count(*) over () // 10), 10) as slice_id from orders""",
)
def line_index_query(spark, sf):
    # Range-partitioned and sorted, the files of the dump hold the lines in order.
    path = scratch(spark, "ordered")
    lines = a.table(spark, sf, "orders").select(
        "o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("line_no"))).alias("value")
    )
    ordered = lines.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey")
    sinks.write_lines(ordered, path)
    indexed = line_index(pubs.scan_lines(spark, path))
    parsed = slice_ids(indexed, 10).withColumn(
        "line_no", F.get_json_object("value", "$.line_no").cast("bigint")
    )
    return parsed.select("line_no", "idx", "slice_id")


@query("write_manifest", statement("select line_no, doi from pubs where doi is not null and doi not in (select doi from status)", "pubs", "status"))
def write_manifest(spark, sf):
    kept = dedup.not_yet_harvested(a.records(spark, sf), a.status(spark, sf))
    written = pubs.scan_publications(spark, _dump(spark, sf, "manifest", kept), DUMP)
    return written.select("line_no", "doi")


@query("write_metadata", statement(
    "select distinct substr(id, 1, 1) as shard, id, doi, domain from manifest", "manifest"))
def write_metadata(spark, sf):
    path = scratch(spark, "metadata")
    sinks.write_metadata(m.build_manifest(a.records(spark, sf)), path, digits=1)
    rows = spark.read.schema("value string, shard string").text(path)
    return rows.select(
        "shard", *[F.get_json_object("value", f"$.{name}").alias(name) for name in ("id", "doi", "domain")]
    )


@query("scan_status", statement("select uuid, grobid_version from status", "status"))
def scan_status(spark, sf):
    path = scratch(spark, "status")
    a.status(spark, sf).select(*STATUS.names).write.parquet(path)
    return status_source.scan_status(spark, path, ["uuid", "grobid_version"])


@query("scan_status_csv", statement(f"select {_COLUMNS} from status", "status"))
def scan_status_csv(spark, sf):
    path = scratch(spark, "status-csv")
    status_sink.export_status_csv(a.status(spark, sf), path)
    return _plain(status_source.scan_status_csv(spark, path))


@query("export_status_csv", statement(
    """select concat_ws(',', doi, uuid, is_harvested, coalesce(softcite_version, ''), grobid_version, harvester_used, domain,
  url_used, strftime(harvesting_date, '%Y-%m-%d %H:%M:%S.%f'), coalesce(datastet_version, '')) as value from status""", "status"))
def export_status_csv(spark, sf):
    path = scratch(spark, "status-csv")
    status_sink.export_status_csv(a.status(spark, sf), path)
    return spark.read.text(path)


@query("scan_service_outputs", statement("select path, uuid, service, version from outputs", "outputs"))
def scan_service_outputs(spark, sf):
    def read(folder):
        found = b.output_versions(obj.scan_service_outputs(spark, folder), "0.8.9")
        return found.withColumn("path", F.substring_index("path", folder.removeprefix("file:") + "/", -1))

    outputs = a.outputs(spark, sf).select("path", F.encode("body", "utf-8").alias("content"))
    return in_parts(spark, outputs, "outputs", read, lanes=2)


@query("scan_objects", statement("select path from objects where starts_with(path, 'publication/a')", "objects"))
def scan_objects(spark, sf):
    path = scratch(spark, "inventory")
    a.objects(spark, sf).write.parquet(path)
    return obj.scan_objects(spark, path, "publication/a")


@query("scan_payloads", "select url from pages")
def scan_payloads(spark, sf):
    folder = scratch(spark, "payloads")
    a.table(spark, sf, "pages").select("url").write.option("maxRecordsPerFile", 100).text(folder)
    files = obj.scan_payloads(spark, folder, "*.txt").where(F.length("content") == F.col("length"))
    lines = F.explode(F.split(F.decode("content", "utf-8"), "\n"))
    return files.select(lines.alias("url")).where("url <> ''")


@query("write_payloads", statement(
    f"select {path_of('uuid')} as path, substr(uuid, 1, 1) as shard, concat('%PDF-', doi) as body, true as valid from status", "status"))
def write_payloads(spark, sf):
    folder = scratch(spark, "payloads")
    payloads = a.status(spark, sf).select(
        paths.storage_path(F.col("uuid")).alias("path"),
        F.concat(F.lit("%PDF-"), "doi").cast("binary").alias("content"),
    )
    sinks.write_payloads(payloads, folder, digits=1)
    from sheaf.functions.payload import valid_pdf

    stored = spark.read.schema("path string, content binary, shard string").parquet(folder)
    return stored.select(
        "path", "shard", F.decode("content", "utf-8").alias("body"), valid_pdf(F.col("content")).alias("valid")
    )


def _packed(spark, sf):
    """All payloads; then every fifth again, with what replaces them; the first packs compacted."""
    root = scratch(spark, "packs")
    path, again = paths.storage_path(F.col("uuid")).alias("path"), F.expr("line_no % 5 = 0")
    for batch, (rows, head) in enumerate(((a.status(spark, sf), "%PDF-"), (a.status(spark, sf).where(again), "%PDF-2 "))):
        packs.append_packs(rows.select(path, F.concat(F.lit(head), "doi").cast("binary").alias("content")), root, batch)
        packs.compact_packs(spark, root, 1 << 20)
    packs.vacuum_packs(spark, root)
    return root


PACKED = f"""select {path_of('uuid')} as path, case when line_no % 5 = 0 then concat('%PDF-2 ', doi) else concat('%PDF-', doi) end as body
from status"""


@query("write_packs", statement(PACKED, "status"))
def write_packs(spark, sf):
    return packs.scan_packs(spark, _packed(spark, sf)).select("path", F.decode("content", "utf-8").alias("body"))


@query("read_packed", statement(f"{PACKED} where uuid like 'a%'", "status"))
def read_packed(spark, sf):
    wanted = a.status(spark, sf).where(F.col("uuid").startswith("a")).select(paths.storage_path(F.col("uuid")).alias("path"))
    found = packs.read_packed(spark, _packed(spark, sf), wanted)
    return found.select("path", F.decode("content", "utf-8").alias("body"))


@query("write_checkpoints", statement(
    " union all ".join(f"select '{n}' as class, doi from classed where {n}" for n in c.CLASSES), "classed"))
def write_checkpoints(spark, sf):
    path = scratch(spark, "classes")
    # Two dumps, one table: the second run's files are added to those of the first.
    for half in range(2):
        part = a.records(spark, sf).where(F.col("line_no") % 2 == half)
        sinks.write_class_lists(c.classify(part), path, mode="append")
    return spark.read.schema("doi string, class string").parquet(path)


@query("write_ledgers", with_resolved(
    """select 'entry' as kind, id, harvester_used as a, case when valid_fulltext_pdf then 'json,pdf' else 'json' end as b from entries
union all select 'failure', id, result, last_url from entries where not (result = 'success' and valid_fulltext_pdf)"""))
def write_ledgers(spark, sf):
    built = durable(m.build_manifest(a.records(spark, sf)), "manifest")
    outcomes = att.resolve_steps(cand.url_steps(built), a.captured_outcomes(spark, sf))
    entries = durable(built.select("id", "doi", "domain").join(outcomes, "id"), "outcomes")
    _, bad = att.split_outcomes(entries)
    folder = scratch(spark, "ledgers")
    sinks.write_ledgers(ledger_rows(entries, NOW), failure_rows(bad), folder)
    entry = spark.read.schema("id string, harvester_used string, resources array<string>").parquet(f"{folder}/entries")
    failed = spark.read.schema("id string, result string, url string").parquet(f"{folder}/failures")
    return entry.select(
        F.lit("entry").alias("kind"), "id", F.col("harvester_used").alias("a"), F.array_join("resources", ",").alias("b")
    ).unionByName(
        failed.select(F.lit("failure").alias("kind"), "id", F.col("result").alias("a"), F.col("url").alias("b"))
    )


@query("upsert_status_shards", statement(APPLIED, "status", "newest"))
def upsert_status_shards(spark, sf):
    path = scratch(spark, "status-shards")
    status_sink.write_status_shards(a.status(spark, sf), path, digits=1)
    status_sink.apply_versions_shards(spark, path, durable(a.version_events(spark, sf), "events"), digits=1)
    return _plain(status_source.scan_status_shards(spark, path))


def over_dumps(spark, sf, start):
    """Runs a stream over dumps that come one after the other; the DOIs of one come again in later ones, too.

    A dump is as many files as tasks write it, and all of them are one batch.
    """
    source, records = scratch(spark, "stream-in"), a.records(spark, sf)
    last = records.agg(F.max("line_no")).first()[0]
    for part in range(3):
        own = records.where((F.col("line_no") * 3 >= part * (last + 1)) & (F.col("line_no") * 3 < (part + 1) * (last + 1)))
        again = records.where(F.col("line_no") * 3 < part * (last + 1))
        own.unionByName(again).write.mode("append").parquet(source)
        start(spark.readStream.schema(DUMP).parquet(source)).awaitTermination()


@query("stream_manifest", statement("select id, doi, domain, cast(url_rank as bigint) as url_rank, url from manifest", "manifest"))
def stream_manifest(spark, sf):
    folder = scratch(spark, "stream-out")
    over_dumps(spark, sf, lambda stream: jobs.stream_manifest(stream, folder))
    steps = cand.url_steps(jobs.read_manifest(spark, folder))
    return steps.join(jobs.read_manifest(spark, folder).select("id", "domain"), "id").select(
        "id", "doi", "domain", "url_rank", "url"
    )


@query("stream_manifest_state", statement("select id, doi, domain, cast(url_rank as bigint) as url_rank, url from manifest", "manifest"))
def stream_manifest_state(spark, sf):
    folder = scratch(spark, "stream-out")
    over_dumps(spark, sf, lambda stream: jobs.stream_manifest_state(stream, folder))
    rows = jobs.read_manifest(spark, folder)
    return cand.url_steps(rows).join(rows.select("id", "domain"), "id").select("id", "doi", "domain", "url_rank", "url")


@query("stream_version_log", statement(APPLIED, "status", "newest"))
def stream_version_log(spark, sf):
    """The events of a uuid are spread over files, later ones come first, and shards are compacted in between."""
    source, path, log = scratch(spark, "stream-in"), scratch(spark, "status-shards"), scratch(spark, "version-log")
    status_sink.write_status_shards(a.status(spark, sf), path, digits=1)
    events = a.version_events(spark, sf)
    for kinds in ((4,), (1,), (2,), (3,)):
        events.where((F.col("seq") % 10).isin(*kinds)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(VERSION_EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_version_log(stream, log, scratch(spark, "stream-state"), compact_bytes=4_000).awaitTermination()
    return _plain(version_log.scan_status_merged(spark, path, log))


@query("stream_upsert", statement(APPLIED, "status", "newest"))
def stream_upsert(spark, sf):
    source, path = scratch(spark, "stream-in"), scratch(spark, "status-shards")
    status_sink.write_status_shards(a.status(spark, sf), path, digits=1)
    # The events of a uuid are spread over files, and later ones come first.
    events = a.version_events(spark, sf)
    for kinds in ((4,), (1,), (2, 3)):
        events.where((F.col("seq") % 10).isin(*kinds)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(VERSION_EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_upsert(stream, path, scratch(spark, "stream-state"), digits=1).awaitTermination()
    return _plain(status_source.scan_status_shards(spark, path))


@query(
    "stream_request_rate",
    """select strftime(case event_type when 'click' then time_bucket(interval 15 seconds, ts)
    when 'view' then time_bucket(interval 4 seconds, ts) else time_bucket(interval 60 seconds, ts) end, '%Y-%m-%d %H:%M:%S') as window_start,
  event_type as client, count(*) as n, count(*) > case event_type when 'click' then 1 when 'view' then 3 else 2 end as over_limit
from events group by 1, 2""",
)
def stream_request_rate(spark, sf):
    folder = scratch(spark, "stream-out")
    events = a.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    requests = stream.select(F.col("event_type").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    limits = {"click": (1, 15), "view": (3, 4)}
    jobs.stream_request_rate(requests, folder, limits, 60, default_max=2).awaitTermination()
    return jobs.read_request_rate(spark, folder).select(
        F.date_format("window_start", TS).alias("window_start"), "client", "n", "over_limit"
    )


@query("stream_anchored_rate", ANCHORED_SQL)
def stream_anchored_rate(spark, sf):
    """The events come in three files, in the order of time but for some minutes."""
    source, folder = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    requests = a.requests(spark, sf).select("client", "ts", (F.unix_seconds("ts") + F.pmod(F.hash("event_id"), F.lit(1800))).alias("came"))
    ends = requests.agg(F.min("came").alias("low"), F.max("came").alias("high")).first()
    cuts = [ends.low, ends.low + (ends.high - ends.low) // 3, ends.low + (ends.high - ends.low) // 2, ends.high + 1]
    for low, high in zip(cuts, cuts[1:]):
        requests.where((F.col("came") >= low) & (F.col("came") < high)).select("client", "ts").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("client string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_anchored_rate(stream, folder, ANCHORED_LIMITS, 3600).awaitTermination()
    return jobs.read_anchored_rate(spark, folder).select("client", F.unix_micros("window_start").alias("window_us"), "n", "over_limit")

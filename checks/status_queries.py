"""Status table, backlog, batches, indexes and the jobs on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as a
from checks.manifest_queries import plain_channel, with_resolved
from checks.registry import query
from checks.sql import path_of, statement, uuid_of
from sheaf.functions import paths
from sheaf.functions.paths import SERVICES, storage_path
from sheaf.operators import backlog as b
from sheaf.operators import dedup
from sheaf.operators import index as ix
from sheaf.operators import status as st
from sheaf.operators.annotate import annotate as run_annotate
from sheaf.operators.ledger import harvest_diagnostic as diagnostic
from sheaf.plans.harvest import harvest_batch as run_harvest
from sheaf.plans.processing import apply_processing as run_apply
from sheaf.plans.processing import plan_processing as run_plan
from sheaf.schemas import STATUS

SPEC = {"grobid": "0.7.3", "softcite": "0.7.2", "datastet": "0.7.3"}
NOW = "2024-03-05 10:00:00"
TS = "yyyy-MM-dd HH:mm:ss"


def _plain(df):
    """Status columns, with the timestamp as text."""
    return df.select(
        *[F.date_format(c, TS).alias(c) if c == "harvesting_date" else F.col(c) for c in STATUS.names]
    )


_TEXT_DATE = "strftime(harvesting_date, '%Y-%m-%d %H:%M:%S') as harvesting_date"
_COLUMNS = f"doi, uuid, is_harvested, softcite_version, grobid_version, harvester_used, domain, url_used, {_TEXT_DATE}, datastet_version"

BACKLOG = """select uuid, 'grobid' as service, coalesce(grobid_version, '0') as version from status where coalesce(grobid_version, '0') < '0.7.3'
union all select uuid, 'softcite', coalesce(softcite_version, '0') from status where coalesce(softcite_version, '0') < '0.7.2'
union all select uuid, 'datastet', coalesce(datastet_version, '0') from status where coalesce(datastet_version, '0') < '0.7.3'"""
FILES = f"select service, {path_of('uuid')} as path from ({BACKLOG}) b"
BATCHES = f"select *, (row_number() over (partition by service order by path) - 1) as idx from ({FILES}) f"


@query("version_backlog", statement(BACKLOG, "status"))
def version_backlog(spark, sf):
    return b.version_backlog(a.status(spark, sf), SPEC)


@query("backlog_files", statement(f"select *, row_number() over (order by service, path) - 1 as position from ({FILES}) f", "status"))
def backlog_files(spark, sf):
    return b.backlog_files(a.status(spark, sf), SPEC)


@query("select_by_uuids", statement(f"select {_COLUMNS} from status where uuid in (select uuid from events_v)", "status", "events_v"))
def select_by_uuids(spark, sf):
    return _plain(st.select_by_uuids(a.status(spark, sf), a.version_events(spark, sf).select("uuid")))


@query(
    "not_yet_harvested",
    statement("select line_no, doi from pubs where doi is not null and doi not in (select doi from status)", "pubs", "status"),
)
def not_yet_harvested(spark, sf):
    return dedup.not_yet_harvested(a.pubs(spark, sf), a.status(spark, sf)).select("line_no", "doi")


@query(
    "doi_allowlist",
    statement("select line_no, doi from pubs where doi in (select doi from status where harvester_used = 'wiley')", "pubs", "status"),
)
def doi_allowlist(spark, sf):
    wanted = a.status(spark, sf).where("harvester_used = 'wiley'").select("doi")
    return dedup.doi_allowlist(a.pubs(spark, sf), wanted).select("line_no", "doi")


@query(
    "confirm_uploaded",
    statement(f"select doi, uuid from status where {path_of('uuid')} in (select path from objects)", "status", "objects"),
)
def confirm_uploaded(spark, sf):
    return st.confirm_uploaded(a.status(spark, sf).select("doi", "uuid"), a.objects(spark, sf))


@query(
    "confirm_uploaded_prefix",
    statement(
        f"""select doi, uuid from status where {path_of('uuid')} in
  (select regexp_replace(part, '[.]part1$', '') from (select concat(path, '.part1') as part from objects) o)""",
        "status",
        "objects",
    ),
)
def confirm_uploaded_prefix(spark, sf):
    parts = a.objects(spark, sf).select(F.concat("path", F.lit(".part1")).alias("path"))
    return st.confirm_uploaded(a.status(spark, sf).select("doi", "uuid"), parts, match="prefix")


@query(
    "status_rows",
    statement(
        f"""select doi, uuid, '1' as is_harvested, '0' as softcite_version, '0' as grobid_version, harvester_used, domain,
  url_used, '{NOW}' as harvesting_date, '0' as datastet_version
from status where {path_of('uuid')} in (select path from objects)""",
        "status",
        "objects",
    ),
)
def status_rows(spark, sf):
    status = a.status(spark, sf)
    ledger = status.select(F.col("uuid").alias("id"), "harvester_used", "domain", "url_used")
    confirmed = st.confirm_uploaded(status.select("doi", "uuid"), a.objects(spark, sf))
    return _plain(st.status_rows(confirmed, ledger, NOW))


APPLIED = """select s.doi, s.uuid, s.is_harvested, coalesce(new_softcite, softcite_version) as softcite_version,
  coalesce(new_grobid, grobid_version) as grobid_version, harvester_used, domain, url_used,
  strftime(harvesting_date, '%Y-%m-%d %H:%M:%S') as harvesting_date, coalesce(new_datastet, datastet_version) as datastet_version
from status s left join newest n on s.uuid = n.uuid"""


@query("apply_versions", statement(APPLIED, "status", "newest"))
def apply_versions(spark, sf):
    return _plain(st.apply_versions(a.status(spark, sf), a.version_events(spark, sf)))


@query("unknown_uuids", statement("select distinct uuid from events_v where uuid not in (select uuid from status)", "events_v", "status"))
def unknown_uuids(spark, sf):
    return st.unknown_uuids(a.status(spark, sf), a.version_events(spark, sf))


@query(
    "upsert_status",
    statement(
        f"""select coalesce(c.doi, i.doi) as doi, coalesce(c.uuid, i.uuid) as uuid, '1' as is_harvested,
  case when i.uuid is not null then '0' else c.softcite_version end as softcite_version,
  case when i.uuid is not null then '0' else c.grobid_version end as grobid_version,
  coalesce(c.harvester_used, i.harvester_used) as harvester_used, coalesce(c.domain, i.domain) as domain,
  coalesce(c.url_used, i.url_used) as url_used,
  case when c.uuid is not null then strftime(c.harvesting_date, '%Y-%m-%d %H:%M:%S') else '{NOW}' end as harvesting_date,
  case when i.uuid is not null then '0' else c.datastet_version end as datastet_version
from (select * from status where line_no % 5 <> 0) c full join (select * from status where line_no % 2 = 0) i on c.uuid = i.uuid""",
        "status",
    ),
)
def upsert_status(spark, sf):
    status = a.status(spark, sf)
    current = status.where("line_no % 5 <> 0").select(*STATUS.names)
    ledger = status.select(F.col("uuid").alias("id"), "harvester_used", "domain", "url_used")
    incoming = st.status_rows(status.where("line_no % 2 = 0").select("doi", "uuid"), ledger, NOW)
    return _plain(st.upsert_status(current, incoming))


REPROCESS = f"""select p.line_no, p.doi, coalesce(k.uuid, {uuid_of('p.doi')}) as id
from pubs p left join (select doi, concat('old-', uuid) as uuid, line_no from status) k on p.doi = k.doi
where p.doi is not null and {{condition}}"""


def _known(spark, sf):
    status = a.status(spark, sf)
    known = status.select("doi", F.concat(F.lit("old-"), "uuid").alias("uuid"))
    ledger = status.select(
        F.concat(F.lit("old-"), "uuid").alias("id"),
        F.expr("if(line_no % 7 <> 0, array('json', 'pdf'), array('json'))").alias("resources"),
    )
    return known, ledger


@query("reprocess_filter", statement(REPROCESS.format(condition="(k.doi is null or k.line_no % 7 = 0)"), "pubs", "status"))
def reprocess_filter(spark, sf):
    known, ledger = _known(spark, sf)
    records = a.pubs(spark, sf).where("doi is not null")
    return dedup.reprocess_filter(records, known, ledger, True).select("line_no", "doi", "id")


@query("reprocess_filter_off", statement(REPROCESS.format(condition="k.doi is null"), "pubs", "status"))
def reprocess_filter_off(spark, sf):
    known, ledger = _known(spark, sf)
    records = a.pubs(spark, sf).where("doi is not null")
    return dedup.reprocess_filter(records, known, ledger, False).select("line_no", "doi", "id")


@query("first_by_doi", statement(
    "select doi, min(line_no) as line_no from pubs where doi is not null group by doi", "pubs"))
def first_by_doi(spark, sf):
    records = a.pubs(spark, sf).where("doi is not null")
    return dedup.first_by(records, ["doi"], ["line_no"]).select("doi", "line_no")


@query("global_index", "select url, page_id, row_number() over (order by url, page_id) - 1 as idx from pages")
def global_index(spark, sf):
    pages = a.table(spark, sf, "pages").select("url", "page_id")
    return ix.global_index(pages, ["url", "page_id"])


@query(
    "group_index",
    "select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) - 1 as idx from events",
)
def group_index(spark, sf):
    events = a.table(spark, sf, "events").select("event_id", "event_type", "ts")
    return ix.group_index(events, ["event_type"], ["ts", "event_id"]).drop("ts")


_LINES = "select line_no, row_number() over (order by line_no) - 1 as idx, count(*) over () as n from pubs"


@query("slice_by_index", statement(
    f"select line_no, idx, least(idx // (n // 7), 7) as slice_id from ({_LINES}) x", "pubs"))
def slice_by_index(spark, sf):
    indexed = ix.global_index(a.pubs(spark, sf).select("line_no"), ["line_no"])
    return ix.slice_ids(indexed, 7)


@query("slice_by_index_reference", statement(
    f"select line_no, idx, case when idx // (n // 997) <= 997 then idx // (n // 997) else -1 end as slice_id from ({_LINES}) x", "pubs"))
def slice_by_index_reference(spark, sf):
    indexed = ix.global_index(a.pubs(spark, sf).select("line_no"), ["line_no"])
    return ix.slice_ids(indexed, 997, mode="reference").fillna(-1, ["slice_id"])


@query("fixed_batches", statement(
    f"""select path, idx, idx // 100 as batch_no from (select path, row_number() over (order by path) - 1 as idx
from (select {path_of('uuid')} as path from status) p) x""", "status"))
def fixed_batches(spark, sf):
    files = a.status(spark, sf).select(storage_path(F.col("uuid")).alias("path"))
    return ix.batch_numbers(ix.global_index(files, ["path"], unique=True), 100)


@query("sorted_paths", "select url as path, row_number() over (order by url) - 1 as position from pages")
def sorted_paths(spark, sf):
    return b.sorted_paths(a.table(spark, sf, "pages").select(F.col("url").alias("path")))


@query("stop_after_one", statement(
    f"select service, path, idx, idx // 50 as batch_no from ({BATCHES}) x where idx < 50", "status"))
def stop_after_one(spark, sf):
    return ix.first_batch(b.service_batches(a.status(spark, sf), SPEC, 50))


ZIPPED = f"""select batch_no, {', '.join(
    f"count(path) filter (service = '{s}') as {s}_n, "
    f"md5(coalesce(string_agg(path, ',' order by path) filter (service = '{s}'), '')) as {s}_md5" for s in SERVICES)}
from (select *, idx // {{size}} as batch_no from ({BATCHES}) x) y group by batch_no"""


def _digest(zipped):
    columns = ["batch_no"]
    for service in SERVICES:
        files = F.col(f"{service}_files")
        columns.append(F.size(files).cast("bigint").alias(f"{service}_n"))
        columns.append(F.md5(F.array_join(files, ",")).alias(f"{service}_md5"))
    return zipped.select(*columns)


@query("zip_partitions", statement(ZIPPED.format(size=100), "status"))
def zip_partitions(spark, sf):
    return _digest(b.zip_batches(b.service_batches(a.status(spark, sf), SPEC, 100)))


@query("plan_processing", statement(ZIPPED.format(size=1000), "status"))
def plan_processing(spark, sf):
    return _digest(run_plan(a.status(spark, sf), SPEC))


@query("batch_profile", statement(
    f"""select batch_no, max(n) as largest from (select idx // 100 as batch_no, service, count(*) as n
from ({BATCHES}) x group by 1, 2) y group by 1""", "status"))
def batch_profile(spark, sf):
    return b.batch_profile(b.service_batches(a.status(spark, sf), SPEC, 100))


@query("status_count", statement("select count(*) as n from status", "status"))
def status_count(spark, sf):
    return st.status_count(a.status(spark, sf))


@query("harvest_diagnostic", statement(
    "select count(*) filter (not ok) as nb_fails, count(*) as nb_total from (select key, bool_or(ok) as ok from attempts group by key) x",
    "attempts"))
def harvest_diagnostic(spark, sf):
    return diagnostic(a.attempts(spark, sf), ["key"])


@query("service_batch_version", statement(
    "select service, arg_min(version, path) as version from outputs group by service", "outputs"))
def service_batch_version(spark, sf):
    return b.service_batch_version(b.output_versions(a.outputs(spark, sf), "0.8.9"))


@query("record_filter", statement(
    f"select {_COLUMNS} from status where harvester_used = 'standard' and softcite_version < '0.7.3'", "status"))
def record_filter(spark, sf):
    condition = (F.col("harvester_used") == "standard") & (F.col("softcite_version") < "0.7.3")
    return _plain(st.record_filter(a.status(spark, sf), condition))


@query("annotate", statement(
    f"""select uuid, service, concat(case service when 'grobid' then '1.0.' when 'softcite' then '2.0.' else '3.0.' end,
  substr(uuid, 1, 1)) as version from ({BACKLOG}) x""", "status"))
def annotate(spark, sf):
    def service(prefix):
        return lambda rows: rows.assign(version=prefix + rows["uuid"].str.slice(0, 1))

    files = b.version_backlog(a.status(spark, sf), SPEC).select("uuid", "service")
    return run_annotate(files, {"grobid": service("1.0."), "softcite": service("2.0."), "datastet": service("3.0.")})


PROCESSED = """select s.doi, s.uuid, s.is_harvested,
  case when line_no % 2 = 0 then (select arg_min(version, path) from outputs where service = 'softcite') else softcite_version end as softcite_version,
  case when line_no % 2 = 0 then '0.8.9' else grobid_version end as grobid_version, harvester_used, domain, url_used,
  strftime(harvesting_date, '%Y-%m-%d %H:%M:%S') as harvesting_date,
  case when line_no % 2 = 0 then (select arg_min(version, path) from outputs where service = 'datastet') else datastet_version end as datastet_version
from status s"""


@query("apply_processing", statement(PROCESSED, "status", "outputs"))
def apply_processing(spark, sf):
    return _plain(run_apply(a.status(spark, sf).drop("line_no"), a.outputs(spark, sf), "0.8.9").status)


@query(
    "evolve_status",
    statement(
        """select doi, uuid, is_harvested, softcite_version, grobid_version, harvester_used, domain, url_used,
  cast(null as varchar) as harvesting_date, cast(null as varchar) as datastet_version from status""",
        "status",
    ),
)
def evolve_status(spark, sf):
    return _plain(st.evolve_status(st.devolve_status(a.status(spark, sf).drop("line_no"))))


HARVESTED = """select 'status' as kind, uuid as id, harvester_used as a, url_used as b, domain as c from status
union all select 'status', id, harvester_used, url_used, domain from missing where result = 'success' and valid_fulltext_pdf
union all select 'failure', id, result, last_url, null from missing where not (result = 'success' and valid_fulltext_pdf)
union all select 'ledger', id, harvester_used, case when valid_fulltext_pdf then 'json,pdf' else 'json' end, domain from missing
union all select 'report', cast(count(*) as varchar), cast(count_if(not (result = 'success' and valid_fulltext_pdf)) as varchar),
  cast((select count(*) from status) as varchar), cast((select count(*) from status) + count_if(result = 'success' and valid_fulltext_pdf) as varchar)
from missing"""
NEW = ",\nmissing as (select * from entries where doi not in (select doi from status))"


def _harvest(spark, sf, **options):
    out = run_harvest(
        a.records(spark, sf), a.status(spark, sf).drop("line_no"), a.captured_outcomes(spark, sf), NOW, **options
    )
    kinds = [
        out.status.select(F.lit("status").alias("kind"), "uuid", "harvester_used", "url_used", "domain"),
        out.failures.select(F.lit("failure"), "id", "result", "url", F.lit(None).cast("string")),
        out.ledger.select(F.lit("ledger"), "id", "harvester_used", F.array_join("resources", ","), "domain"),
        out.report.select(F.lit("report"), *[F.col(c).cast("string") for c in ("n_entries", "n_failed", "n_before", "n_after")]),
    ]
    rows = kinds[0]
    for part in kinds[1:]:
        rows = rows.union(part)
    return rows.toDF("kind", "id", "a", "b", "c")


@query("harvest_batch", with_resolved(HARVESTED, "status", more=NEW))
def harvest_batch(spark, sf):
    return _harvest(spark, sf)


# Of the DOIs an unfinished run knew, those of half have a PDF in its ledger.
_DIGIT = "substr(md5(doi), 1, 1)"


@query("harvest_batch_reprocess", with_resolved(
    HARVESTED, "status",
    more=f""",
missing as (select * replace (case when {_DIGIT} < '8' then concat('known-', id) else id end as id) from entries
  where doi not in (select doi from status) and not {_DIGIT} < '4')"""))
def harvest_batch_reprocess(spark, sf):
    dois = a.pubs(spark, sf).where("doi is not null").select("doi").distinct().withColumn("digit", F.substring(F.md5("doi"), 1, 1))
    known = dois.where("digit < '8'").select("doi", F.concat(F.lit("known-"), paths.uuid_from_doi(F.col("doi"))).alias("uuid"), "digit")
    ledger = known.select(
        F.col("uuid").alias("id"),
        F.when(F.col("digit") < "4", F.array(F.lit("json"), F.lit("pdf"))).otherwise(F.array(F.lit("json"))).alias("resources"),
    )
    return _harvest(spark, sf, known=known.select("doi", "uuid"), ledger=ledger, reprocess=True)


@query("harvest_batch_without_clients", with_resolved(HARVESTED, "status", more=NEW, channel=plain_channel))
def harvest_batch_without_clients(spark, sf):
    return _harvest(spark, sf, wiley=False, elsevier=False)

"""Tables in buckets, split anti-joins, files listed by tasks, and classes as sets of numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as a
from checks.coverage_queries import BY_DOI, PUBLISHERS, TOTALS
from checks.files import in_parts
from checks.registry import query
from checks.sql import path_of, statement
from checks.status_queries import APPLIED, _COLUMNS, _plain
from sheaf.functions import paths
from sheaf.functions.report import share
from sheaf.operators import backlog as b
from sheaf.operators import bloom, candidates as cand, class_sets, coverage as c
from sheaf.operators.dedup import harvested_dois
from sheaf.plans.manifest import build_manifest
from sheaf.schemas import STATUS
from sheaf.session import scratch
from sheaf.sinks import buckets
from sheaf.sources import listing


@query(
    "not_yet_harvested_split",
    statement("select line_no, doi from pubs where doi is not null and doi not in (select doi from status)", "pubs", "status"),
)
def not_yet_harvested_split(spark, sf):
    records = a.pubs(spark, sf).where(F.col("doi").isNotNull())
    return bloom.split_anti_join(records, harvested_dois(a.status(spark, sf)), "doi").select("line_no", "doi")


def _status_buckets(spark, sf):
    root = scratch(spark, "status-buckets")
    buckets.write_buckets(a.status(spark, sf).select(*STATUS.names), root, "uuid", 7)
    return root


@query("apply_versions_buckets", statement(APPLIED, "status", "newest"))
def apply_versions_buckets(spark, sf):
    return _plain(buckets.apply_versions_buckets(spark, _status_buckets(spark, sf), a.version_events(spark, sf)))


@query("select_buckets", statement(f"select {_COLUMNS} from status where uuid in (select uuid from events_v)", "status", "events_v"))
def select_buckets(spark, sf):
    wanted = a.version_events(spark, sf).select("uuid")
    return _plain(buckets.select_buckets(spark, _status_buckets(spark, sf), wanted))


@query("build_manifest_buckets", statement(
    "select id, doi, domain, cast(url_rank as bigint) as url_rank, url from manifest where doi not in (select doi from status)",
    "manifest", "status"))
def build_manifest_buckets(spark, sf):
    root = scratch(spark, "doi-index")
    buckets.doi_index(a.status(spark, sf), root, int(spark.conf.get("spark.sql.shuffle.partitions")))
    built = build_manifest(a.records(spark, sf), harvested=buckets.scan_buckets(spark, root))
    return cand.url_steps(built).join(built.select("id", "domain"), "id").select("id", "doi", "domain", "url_rank", "url")


def _payload_files(spark, sf, read):
    path = paths.storage_path(F.col("uuid")).alias("path")
    payloads = a.status(spark, sf).select(path, F.concat(F.lit("%PDF-"), "doi").cast("binary").alias("content"))
    return in_parts(spark, payloads, "payload-files", read)


@query("list_files", statement(
    f"select {path_of('uuid')} as path, cast(5 + length(doi) as bigint) as length from status where starts_with(uuid, 'a')", "status"))
def list_files(spark, sf):
    return _payload_files(spark, sf, lambda folder: listing.list_files(spark, folder, "publication/a", depth=2))


@query("read_files", statement(f"select {path_of('uuid')} as path, concat('%PDF-', doi) as body from status", "status"))
def read_files(spark, sf):
    files = _payload_files(spark, sf, lambda folder: listing.read_files(spark, folder, depth=2).where(F.octet_length("content") == F.col("length")))
    return files.select("path", F.decode("content", "utf-8").alias("body"))


@query("read_service_outputs", statement("select path, uuid, service, version from outputs", "outputs"))
def read_service_outputs(spark, sf):
    outputs = a.outputs(spark, sf).select("path", F.encode("body", "utf-8").alias("content"))
    return in_parts(spark, outputs, "outputs", lambda folder: b.output_versions(listing.read_service_outputs(spark, folder), "0.8.9"), lanes=2)


def _sets(spark, sf):
    """Three dumps; the records of the first come again in the third, and the second is written twice."""
    root, records = scratch(spark, "class-sets"), a.records(spark, sf)
    third = F.col("line_no") % 3
    for batch, part in ((0, third == 0), (1, third == 1), (1, third == 1), (2, third != 1)):
        class_sets.append_sets(c.class_lists(c.classify(records.where(part), "location")), root, batch)
    status = a.status(spark, sf).select(F.lit("harvested").alias("class"), "doi")
    class_sets.append_sets(status, root, 3)
    return class_sets.merged_sets(spark, root)


@query("coverage_totals_sets", statement(TOTALS, "classed", "status", more=BY_DOI))
def coverage_totals_sets(spark, sf):
    sizes = class_sets.set_sizes(_sets(spark, sf))

    def size(name):
        return F.coalesce(F.sum(F.when(F.col("class") == name, F.col("n"))), F.lit(0).cast("bigint")).alias(f"nb_{name}")

    total = F.col("nb_oa") + F.col("nb_ca")
    return sizes.agg(size("oa"), size("ca")).select(
        total.alias("total_nb"), "nb_oa", "nb_ca", share(F.col("nb_oa"), total).alias("oa_share"), share(F.col("nb_ca"), total).alias("ca_share")
    )


@query("publisher_coverage_sets", statement(PUBLISHERS, "classed", "status", more=BY_DOI))
def publisher_coverage_sets(spark, sf):
    groups = class_sets.overlap_sizes(_sets(spark, sf), "harvested").where(F.col("class").isin("elsevier_ca", "wiley_oa", "wiley_ca"))
    return groups.select(
        "class", F.col("shared").alias("harvested"), F.col("n").alias("total"), share(F.col("shared"), F.col("n")).alias("share")
    )

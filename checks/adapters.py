"""The given tables seen as publication records, status rows, events and captures."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.paths import SERVICE_SUFFIX, storage_path, uuid_from_doi
from sheaf.functions.urls import STANDARD, channel, closed_access_url
from sheaf.operators.dedup import first_by
from sheaf.session import durable, shared_folder

LOC_TIE_BREAK = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


# Publications to a file of a stored input: all of them grow with the orders.
FILE_ORDERS = 250_000

STORED: list[Callable[[SparkSession, str], DataFrame]] = []
_TABLES: dict[tuple[str, str, str, str], DataFrame] = {}


# While an input is made inside rows: a task for each file, not a few large ones in two waves; and expressions are compiled
# in parts, as one method with all of them would be too long for the JVM's compiler.
INSIDE_ROWS = {"spark.sql.files.maxPartitionBytes": "4m", "spark.sql.codegen.wholeStage": "false"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The settings for what is written inside."""
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(build):
    """Write an input as a Parquet table, once per session and folder.

    In use these are tables that exist: a converted dump, the status table, captured fetches.
    Readers then take only the columns and nested fields they need. The given tables are one file
    and so one task each; a table written here has a file per core at least, and one for each ``FILE_ORDERS`` orders.
    """
    return _stored(build, lambda rows, parts: rows.repartition(parts), {})


def stored_as_dealt(build):
    """As :func:`stored`, of an input made inside the rows of a stored one: those are dealt already."""
    return _stored(build, lambda rows, parts: rows, INSIDE_ROWS)


def stored_by_key(build):
    """As :func:`stored`, of an input that :func:`dealt` its rows by a key already: they are not sent a second time."""
    return _stored(build, lambda rows, parts: rows, {})


def file_count(spark: SparkSession, sf: str) -> int:
    return max(spark.sparkContext.defaultParallelism, ceil(table(spark, sf, "orders").count() / FILE_ORDERS))


def dealt(spark: SparkSession, sf: str, rows: DataFrame, key: str) -> DataFrame:
    """The rows by a key, over as many tasks as a stored input has files: what is grouped by it needs no other exchange."""
    return rows.repartition(file_count(spark, sf), key)


def _stored(build, deal, wanted):
    @wraps(build)
    def read(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, shared_folder(spark), sf, build.__name__)
        if key not in _TABLES:
            with settings(spark, wanted):
                _TABLES[key] = durable(deal(build(spark, sf), file_count(spark, sf)), build.__name__)
        return _TABLES[key]

    STORED.append(read)
    return read


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@stored
def pubs(spark: SparkSession, sf: str) -> DataFrame:
    """One flat publication per order; 1 in 97 without DOI, 1 in 50 repeats the DOI before it."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    key = F.col("o_orderkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("line_no"),
        F.when(
            key % 97 != 13,
            F.concat(F.lit("10.1000/o"), (key - F.when(key % 50 == 1, 1).otherwise(0)).cast("string")),
        ).alias("doi"),
        F.when(F.col("c_nationkey") % 5 == 0, "fr")
        .when(F.col("c_nationkey") % 5 == 1, "cn")
        .otherwise("de")
        .alias("country"),
        F.expr(
            "case o_orderpriority when '1-URGENT' then 'Wiley' when '2-HIGH' then 'Elsevier' "
            "when '3-MEDIUM' then 'Springer' else 'N/A' end"
        ).alias("publisher_normalized"),
        F.col("c_mktsegment").alias("domain"),
        F.col("o_orderdate").alias("order_date"),
    )


def locs(spark: SparkSession, sf: str) -> DataFrame:
    """One flat location per lineitem."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    year = F.year("l_shipdate").cast("string")
    part_text = part.cast("string")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line_no"),
        F.when(
            F.col("l_linenumber") % 3 == 0, F.concat(year, F.lit("Q"), F.quarter("l_shipdate").cast("string"))
        )
        .otherwise(year)
        .alias("obs_key"),
        F.expr(
            "case l_suppkey % 6 when 0 then 'arXiv' when 1 then 'PubMed Central' when 2 then 'HAL' "
            "when 3 then 'univoak.eu' end"
        ).alias("repo"),
        F.when(supp % 6 <= 3, "repository").otherwise("publisher").alias("host_type"),
        F.when(part % 11 == 0, None)
        .when(part % 11 == 1, "")
        .when(supp % 6 == 0, F.concat(F.lit("https://arxiv.org/pdf/1501."), part_text))
        .when(part % 5 == 0, F.concat(F.lit("https://onlinelibrary.wiley.com/doi/pdfdirect/p"), part_text))
        .otherwise(
            F.concat(F.lit("https://host"), supp.cast("string"), F.lit(".example.org/p"), part_text, F.lit(".pdf"))
        )
        .alias("url"),
        (F.col("l_returnflag") != "A").alias("loc_oa"),
        *LOC_TIE_BREAK,
    )


# A record has up to so many locations; each has a number ``h``, from the line number and the place of the location.
SLOTS = 6
_OBS_KEY = "concat(cast(2018 + {h} % 4 as string), if({h} % 3 = 0, concat('Q', cast(1 + {h} % 4 as string)), ''))"
_REPO = "case {h} % 7 when 0 then 'arXiv' when 1 then 'PubMed Central' when 2 then 'HAL' when 3 then 'univoak.eu' end"
_HOST = "if({h} % 7 <= 5, 'repository', 'publisher')"
_URL = """case when {h} % 11 = 0 then null when {h} % 11 = 1 then ''
  when {h} % 7 = 0 then concat('https://arxiv.org/pdf/1501.', cast({h} as string))
  when {h} % 5 = 0 then concat('https://onlinelibrary.wiley.com/doi/pdfdirect/p', cast({h} as string))
  when {h} % 13 = 0 then concat('https://www.cairn.info/p', cast({h} as string))
  else concat('https://host', cast({h} % 50 as string), '.example.org/p', cast({h} as string), '.pdf') end"""
_FIELDS = f"""map_from_entries(concat(
    array(named_struct('key', 'host_type', 'value', {_HOST})),
    if({{h}} % 7 <= 4, array(named_struct('key', 'repository_normalized', 'value', {_REPO})), array()),
    if({{h}} % 11 <> 0, array(named_struct('key', 'url_for_pdf', 'value', {_URL})), array())))"""


def _observation(first: int) -> str:
    """An array with the entry of the observation that location ``first`` is the first one of, or an empty one."""
    same = [f"k{i} = k{first}" for i in range(first + 1, SLOTS)]
    new = " and ".join([f"k{first} is not null", *[f"k{first} <> k{i}" for i in range(first)]])
    is_oa = " or ".join([f"oa{first}", *[f"coalesce({s} and oa{i}, false)" for i, s in enumerate(same, first + 1)]])
    locations = ", ".join([f"array(f{first})", *[f"if({s}, array(f{i}), array())" for i, s in enumerate(same, first + 1)]])
    return f"""if({new}, array(named_struct('key', k{first}, 'value', named_struct(
      'is_oa', {is_oa}, 'repository_normalized', hal, 'oa_locations', concat({locations})))), array())"""


@stored_as_dealt
def records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested publication records, built inside each row: no grouping of another table.

    A record has up to six locations in up to six observations. Among them are locations whose
    repository key is absent and others where it is there and null, records with one closed
    observation, and records with none. Locations are columns until they are put together: functions
    of array elements are not compiled.
    """
    slots = range(SLOTS)
    flat = (
        pubs(spark, sf)
        .withColumn("slots", F.expr("(line_no + line_no div 7) % 7"))
        .withColumn("hal", F.expr("if(line_no % 9 = 0, 'HAL', cast(null as string))"))
        .select("*", *[F.expr(f"if(slots > {i}, line_no * 31 + {i} * 17, null)").alias(f"h{i}") for i in slots])
        .select(
            "*",
            *[F.expr(_OBS_KEY.format(h=f"h{i}")).alias(f"k{i}") for i in slots],
            *[F.expr(f"h{i} % 4 <> 1").alias(f"oa{i}") for i in slots],
            *[F.expr(f"if(h{i} is null, null, {_FIELDS.format(h=f'h{i}')})").alias(f"f{i}") for i in slots],
        )
    )
    details = F.expr(
        f"""case when slots > 0 then map_from_entries(concat({', '.join(map(_observation, slots))}))
            when line_no % 2 = 0 then map('2019', named_struct(
              'is_oa', false, 'repository_normalized', hal,
              'oa_locations', cast(null as array<map<string, string>>)))
            else map() end"""
    )
    return flat.select(
        "line_no",
        "doi",
        "publisher_normalized",
        F.col("domain").alias("bso_classification"),
        F.expr(
            "case when line_no % 10 = 3 then null when line_no % 6 = 0 then array(country, 'fr') "
            "else array(country) end"
        ).alias("bso_country_corrected"),
        details.alias("oa_details"),
    )


@stored_by_key
def status(spark: SparkSession, sf: str) -> DataFrame:
    """Status rows of every third publication, with the helper column ``line_no``."""
    line = F.col("line_no")

    def version(expression: str):
        return F.expr(expression)

    some = pubs(spark, sf).where(F.col("doi").isNotNull() & (line % 3 == 0)).select("line_no", "doi", "domain", "order_date")
    return first_by(dealt(spark, sf, some, "doi"), ["doi"], ["line_no"]).select(
        "doi",
        uuid_from_doi(F.col("doi")).alias("uuid"),
        F.lit("1").alias("is_harvested"),
        version("case line_no % 5 when 0 then '0' when 1 then '0.7.2' when 2 then '0.7.3' when 3 then '0.7.10' end").alias("softcite_version"),
        version("case line_no % 4 when 0 then '0' when 1 then '0.7.2' when 2 then '0.7.3' else '0.7.10' end").alias("grobid_version"),
        version("case line_no % 4 when 0 then 'arxiv' when 1 then 'wiley' when 2 then 'elsevier' else 'standard' end").alias("harvester_used"),
        "domain",
        F.concat(F.lit("https://doi.org/"), "doi").alias("url_used"),
        F.col("order_date").cast("timestamp").alias("harvesting_date"),
        version("case line_no % 7 when 0 then '0' when 1 then '0.7.2' when 2 then '0.7.3' end").alias("datastet_version"),
        "line_no",
    )


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Stored payloads: six status rows in seven."""
    return status(spark, sf).where("line_no % 7 <> 0").select(storage_path(F.col("uuid")).alias("path"))


def version_events(spark: SparkSession, sf: str) -> DataFrame:
    """Four events for every second status row, GROBID twice; 1 in 11 has an unknown uuid."""
    kinds = F.explode(
        F.expr(
            "array(named_struct('k', 1, 'service', 'grobid'), named_struct('k', 2, 'service', 'softcite'), "
            "named_struct('k', 3, 'service', 'datastet'), named_struct('k', 4, 'service', 'grobid'))"
        )
    )
    return (
        status(spark, sf)
        .where("line_no % 2 = 0")
        .select("line_no", "uuid", kinds.alias("s"))
        .select(
            (F.col("line_no") * 10 + F.col("s.k")).alias("seq"),
            F.when(F.col("line_no") % 11 == 0, F.concat(F.lit("unknown-"), F.col("line_no").cast("string")))
            .otherwise(F.col("uuid"))
            .alias("uuid"),
            F.col("s.service").alias("service"),
            F.concat(F.lit("0.8."), F.col("s.k").cast("string")).alias("version"),
        )
    )


def capture(spark: SparkSession, sf: str) -> DataFrame:
    """Captured pages: a third are PDFs, most others link to the next page as a redirect."""
    pages = table(spark, sf, "pages")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    link = F.concat(F.lit('<a class="x" id="redirect" href="'), F.col("next_url"), F.lit('">go</a>'))
    return pages.join(following, "page_id", "left").select(
        "page_id",
        "url",
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "url"))
        .when((F.col("page_id") % 5 != 0) & F.col("next_url").isNotNull(), F.concat("html", link))
        .otherwise(F.col("html"))
        .alias("content"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered attempts of a key, from events; only ``error`` events fail."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("key"),
        "ts",
        "event_id",
        F.col("event_type").alias("channel"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("https://example.org/e/"), F.col("event_id").cast("string")).alias("url"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("client"), F.col("ts").cast("timestamp").alias("ts")
    )


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Output files of the three services for every second status row."""
    kinds = F.explode(
        F.array(
            *[
                F.struct(F.lit(service).alias("service"), F.lit(suffix).alias("suffix"))
                for service, suffix in SERVICE_SUFFIX.items()
            ]
        )
    )
    body = F.when(F.col("s.service") == "grobid", "<TEI/>").otherwise(
        F.concat(F.lit('{"mentions": [], "version": "0.8.'), (F.col("line_no") % 4).cast("string"), F.lit('"}'))
    )
    return (
        status(spark, sf)
        .where("line_no % 2 = 0")
        .select("line_no", "uuid", kinds.alias("s"))
        .select(
            F.concat(F.col("s.service"), F.lit("/"), F.col("uuid"), F.col("s.suffix")).alias("path"),
            body.alias("body"),
        )
    )


def record_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct PDF URLs of the records, and the publisher URLs of all DOIs."""
    recs = records(spark, sf)
    listed = (
        recs.select(F.explode(F.map_values("oa_details")).alias("o"))
        .select(F.explode("o.oa_locations").alias("loc"))
        .select(F.col("loc")["url_for_pdf"].alias("url"))
    )
    closed = recs.select(closed_access_url(F.col("doi"), F.col("publisher_normalized")).alias("url"))
    return dealt(spark, sf, listed.unionByName(closed).where("coalesce(url, '') <> ''"), "url").distinct()


@stored_by_key
def captured_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """``(url, channel, outcome, valid_file)``: what each channel gave for each URL."""
    digit = F.col("d")
    tries = F.explode(
        F.array(
            F.struct(
                F.lit(STANDARD).alias("channel"),
                F.when(F.substring(digit, 1, 1) < "6", "success").otherwise("fail").alias("outcome"),
                (F.substring(digit, 1, 1) != "f").alias("there"),
            ),
            F.struct(
                channel(F.col("url")).alias("channel"),
                F.when(F.substring(digit, 2, 1) < "5", "success")
                .when(F.substring(digit, 2, 1) < "a", "fail")
                .otherwise("error")
                .alias("outcome"),
                (channel(F.col("url")) != STANDARD).alias("there"),
            ),
        )
    )
    return (
        record_urls(spark, sf)
        .withColumn("d", F.md5("url"))
        .select("url", "d", tries.alias("t"))
        .where("t.there")
        .select("url", "t.channel", "t.outcome", (F.substring("d", 3, 1) != "0").alias("valid_file"))
    )

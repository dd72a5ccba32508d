"""Tables kept in buckets of a key, so that joins on it do not send them over the network.

``root/data`` has one Parquet file for each bucket, sorted by the key; ``root/layout`` says key, number of buckets and
columns, and is written last: a table whose write broke off has no layout. Nothing stays in the catalog, which only
lends Spark's bucketed reader and writer a name for a moment.

A status table is kept by ``uuid``; ``doi_index`` makes the list that new dumps are compared with, by ``doi``.
"""

from __future__ import annotations

import uuid as uuid_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.dedup import harvested_dois
from sheaf.operators.status import latest_versions, with_versions
from sheaf.session import delete_path

LAYOUT = "key string, buckets int, ddl string"


def _name() -> str:
    return f"sheaf_{uuid_.uuid4().hex}"


def write_buckets(df: DataFrame, root: str, key: str, buckets: int) -> None:
    """Write ``df`` in buckets of ``key``, replacing the table at ``root``.

    It must not be read from the same root. One exchange, to the buckets themselves, gives one file for each; a key
    that fills a large part of the rows fills one bucket, so ``key`` should be unique or nearly so.
    """
    if buckets < 1:
        raise ValueError(f"{buckets} buckets")
    spark, name = df.sparkSession, _name()
    delete_path(spark, f"{root}/layout")
    delete_path(spark, f"{root}/data")
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    try:
        writer.option("path", f"{root}/data").saveAsTable(name)
    finally:
        spark.sql(f"drop table if exists {name}")
    spark.createDataFrame([(key, buckets, df.schema.toDDL())], LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{root}/layout")


def bucket_layout(spark: SparkSession, root: str) -> tuple[str, int, str]:
    """Key, number of buckets and columns of the table at ``root``."""
    row = spark.read.schema(LAYOUT).parquet(f"{root}/layout").first()
    return row.key, row.buckets, row.ddl


def scan_buckets(spark: SparkSession, root: str) -> DataFrame:
    """The table; its rows are known to be partitioned by the key."""
    key, buckets, ddl = bucket_layout(spark, root)
    name, place = _name(), f"{root}/data".replace("\\", "\\\\").replace("'", "\\'")
    try:
        spark.sql(
            f"create table {name} ({ddl}) using parquet clustered by (`{key}`) sorted by (`{key}`) "
            f"into {buckets} buckets location '{place}'"
        )
        return spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def doi_index(status: DataFrame, root: str, buckets: int) -> None:
    """Write the distinct DOIs of the status table in buckets.

    With as many buckets as the session has shuffle partitions, ``build_manifest(harvested=scan_buckets(...))``
    compares the deduplicated records with it without an exchange on its side.
    """
    write_buckets(harvested_dois(status), root, "doi", buckets)


def apply_versions_buckets(spark: SparkSession, root: str, events: DataFrame) -> DataFrame:
    """The status table in buckets of ``uuid`` with version events folded in; only the folded events are sent."""
    key, buckets, _ = bucket_layout(spark, root)
    if key != "uuid":
        raise ValueError(f"{root} is kept by {key}, not by uuid")
    return with_versions(scan_buckets(spark, root), latest_versions(events).repartition(buckets, F.col("uuid")))


def select_buckets(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among ``wanted``'s first column, which is sent to the buckets."""
    key, buckets, _ = bucket_layout(spark, root)
    keys = wanted.select(F.col(wanted.columns[0]).alias(key)).distinct().repartition(buckets, key)
    table = scan_buckets(spark, root)
    return table.join(keys.hint("shuffle_merge"), key, "left_semi").select(*table.columns)

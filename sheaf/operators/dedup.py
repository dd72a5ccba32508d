"""First occurrences, and which records are still to be harvested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.paths import uuid_from_doi
from sheaf.functions.records import has_doi
from sheaf.session import lookup_side

def first_by(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row of each key.

    Spark turns the ``= 1`` filter into a group limit on both sides of the exchange, so each task
    sends at most one row per key: a key that fills a third of the input arrives as one row per
    task.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def harvested_dois(status: DataFrame) -> DataFrame:
    """Distinct DOIs of the status table; a null DOI there stands for nothing."""
    return status.select("doi").where(has_doi(F.col("doi"))).distinct()


def not_yet_harvested(records: DataFrame, status: DataFrame) -> DataFrame:
    """Records with a DOI that the status table does not have, repeated DOIs included.

    An anti-join against the written DOI list: a short list spares the records their exchange, a
    long one leaves a hot DOI of the records to the adaptive split.
    """
    done = lookup_side(harvested_dois(status))
    return records.where(has_doi(F.col("doi"))).join(done, "doi", "left_anti").select(*records.columns)


def keep_values(df: DataFrame, column: str, values: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose ``column`` is one of ``values``: a list, or the first column of a frame.

    One semi-join for any number of values; the columns keep their order.
    """
    if not isinstance(values, DataFrame):
        values = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    wanted = values.select(F.col(values.columns[0]).alias(column)).distinct()
    return df.join(lookup_side(wanted), column, "left_semi").select(*df.columns)


def doi_allowlist(records: DataFrame, dois: Sequence[str] | DataFrame | None) -> DataFrame:
    """Records of the listed DOIs. DOIs compare exactly.

    None, or an empty literal list, is no filter. A frame always filters: an empty one keeps nothing.
    """
    if not isinstance(dois, DataFrame) and not dois:
        return records
    return keep_values(records, "doi", dois)


def assign_ids(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add ``id``: the known uuid of the DOI, else one made from the DOI itself.

    ``known(doi, uuid)`` is an index: one row per DOI.
    """
    new_id = uuid_from_doi(F.col("doi"))
    if known is None:
        return records.withColumn("id", new_id)
    pairs = known.select("doi", F.col("uuid").alias("__known"))
    return records.join(lookup_side(pairs), "doi", "left").select(
        *records.columns, F.coalesce("__known", new_id).alias("id")
    )


def reprocess_filter(
    records: DataFrame, known: DataFrame, ledger: DataFrame, reprocess: bool
) -> DataFrame:
    """Decide on records whose DOI is already in the index ``known(doi, uuid)``.

    Without ``reprocess`` they are dropped. With it they keep their uuid and are dropped only when
    the ledger lists a PDF for it. New DOIs get an id either way. The index has one row per DOI and
    the ledger one per id.
    """
    if not reprocess:
        new = records.join(lookup_side(known.select("doi")), "doi", "left_anti")
        return assign_ids(new.select(*records.columns))
    pairs = known.select("doi", F.col("uuid").alias("__known"))
    done = ledger.where(F.array_contains("resources", "pdf")).select(
        F.col("id").alias("__known"), F.lit(True).alias("__done")
    )
    # Resolving the two lookups against each other first leaves one join for the records.
    state = lookup_side(pairs.join(done, "__known", "left"))
    return (
        records.join(state, "doi", "left")
        .where(F.col("__done").isNull())
        .select(*records.columns, F.coalesce("__known", uuid_from_doi(F.col("doi"))).alias("id"))
    )

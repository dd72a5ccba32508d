"""DOIs of each class as bitmaps over dense DOI numbers: counts of many dumps without counting old ones again.

``root/numbers/batch=N`` gives new DOIs the numbers after those already dealt, ``root/sets/batch=N`` has for each class
the DOIs of that batch, as Spark's bitmaps of 32,768 numbers. Sets of batches are merged by OR, so repeats within and
between batches count once, and counts are exact. A batch that is written again, as the last one, replaces itself.

A merged class of 100 million DOIs is some 3,000 bitmaps of 4 KB, which is what counting reads instead of the DOIs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.records import has_doi
from sheaf.operators.index import global_index
from sheaf.session import _file_system, delete_path, durable, lookup_side

NUMBERS = "doi string, number bigint"
SETS = "class string, bucket bigint, bits binary"


def _batches(spark: SparkSession, path: str) -> list[str]:
    folder, system = spark._jvm.org.apache.hadoop.fs.Path(path), _file_system(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(name for name in names if name.startswith("batch="))


def scan_numbers(spark: SparkSession, root: str) -> DataFrame:
    """``(doi, number)``, one row per DOI, of all batches that are complete."""
    done = _batches(spark, f"{root}/sets")
    paths = [f"{root}/numbers/{batch}" for batch in done]
    return spark.read.schema(NUMBERS).parquet(*paths) if paths else spark.createDataFrame([], NUMBERS)


def class_sets(lists: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(class, bucket, bits)`` of ``(class, doi)``; DOIs without number and null DOIs are left out.

    Each DOI is sent to its bitmap as a number: partial bitmaps of each task would be larger than what they stand for.
    """
    known = lists.join(lookup_side(numbers), "doi").select(
        "class", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("position")
    )
    dealt = known.distinct().repartition("class", "bucket")
    return dealt.groupBy("class", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))


def append_sets(lists: DataFrame, root: str, batch_id: int) -> None:
    """Add the class lists ``(class, doi)`` of a dump; the sets are written last and make the batch count.

    Only the batch's DOIs that have no number yet get one. The last batch may be written again, an earlier one may
    not, as later numbers build on it.
    """
    spark, batch = lists.sparkSession, f"batch={batch_id:012d}"
    later = [b for b in _batches(spark, f"{root}/sets") if b > batch]
    if later:
        raise ValueError(f"{batch} is written after {later[-1]}")
    delete_path(spark, f"{root}/sets/{batch}")
    lists = durable(lists.select("class", "doi").where(has_doi(F.col("doi"))), "lists")
    known = scan_numbers(spark, root)
    start = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    # The numbers dealt so far are looked through once; all that follows is of the size of the batch.
    wanted = durable(lists.select("doi").distinct().join(known, "doi", "left"), "numbered")
    dealt = global_index(wanted.where("number is null").select("doi"), ["doi"], "number", unique=True)
    dealt.select("doi", (F.col("number") + start + 1).alias("number")).write.mode("overwrite").parquet(f"{root}/numbers/{batch}", compression="zstd")
    new = spark.read.schema(NUMBERS).parquet(f"{root}/numbers/{batch}")
    numbers = wanted.where("number is not null").unionByName(new)
    class_sets(lists, numbers).write.mode("overwrite").parquet(f"{root}/sets/{batch}", compression="zstd")


def merged_sets(spark: SparkSession, root: str) -> DataFrame:
    """The union of all batches: one bitmap for each class and bucket."""
    paths = [f"{root}/sets/{batch}" for batch in _batches(spark, f"{root}/sets")]
    rows = spark.read.schema(SETS).parquet(*paths) if paths else spark.createDataFrame([], SETS)
    return rows.groupBy("class", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def set_sizes(sets: DataFrame) -> DataFrame:
    """``(class, n)``: distinct DOIs of each class."""
    return sets.groupBy("class").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def overlap_sizes(sets: DataFrame, other: str) -> DataFrame:
    """``(class, n, shared)``: distinct DOIs of each class but ``other``, and how many of them ``other`` has too.

    Of two sets, those in both are the sum of their sizes less the size of their union, bucket by bucket.
    """
    size = F.bitmap_count("bits")
    theirs = sets.where(F.col("class") == other).select("bucket", F.col("bits").alias("theirs"))
    pairs = sets.where(F.col("class") != other).join(theirs, "bucket", "left")
    both = pairs.select("class", "bucket", size.alias("n"), F.explode(F.array("bits", "theirs")).alias("side"))
    united = both.groupBy("class", "bucket").agg(
        F.max("n").alias("n"),
        F.sum(F.bitmap_count("side")).alias("sum"),
        F.bitmap_count(F.bitmap_or_agg("side")).alias("union"),
    )
    return united.groupBy("class").agg(F.sum("n").alias("n"), F.sum(F.col("sum") - F.col("union")).alias("shared"))

"""Dense positions, ranks and batches without a single-task window.

The plain way to number rows, a window without ``partitionBy``, sends every row to one task. Here
rows are range-partitioned on the sort keys plus a tie-break (so that a run of equal keys is
split like any other run), sorted inside each partition, and written once with their place in the
partition. What is left is one offset per partition: as many numbers as there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from sheaf.session import durable, lookup_side

_TIE, _PART, _POS, _START, _AT = "__tie", "__part", "__pos", "__start", "__at"
# monotonically_increasing_id keeps the row number in its lower 33 bits.
_ROW_BITS = (1 << 33) - 1
# Rows of a range partition when the caller does not say how many partitions to make.
ROWS_PER_PARTITION = 4_000_000


def _group_keys(groups: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """``groups`` under key names that cannot clash with those of the rows."""
    return groups.select(*[F.col(key).alias(f"__key_{key}") for key in keys], *others)


def _same_group(keys: Sequence[str]):
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__key_{key}"))
    return condition


def _sorted_table(
    df: DataFrame, keys: Sequence[str], partitions: int | None, unique: bool
) -> DataFrame:
    order = [F.col(key) for key in keys]
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range partitioning reads its input twice, once to sample it. Written first, the input is computed
    # once, its rows are counted from the files, and the tie-break of equal rows is the same whenever a
    # task runs again.
    if not unique or not partitions:
        df = durable(df, "unsorted")
        count = partitions or max(count, ceil(df.count() / ROWS_PER_PARTITION))
    if not unique:
        df = df.withColumn(_TIE, F.monotonically_increasing_id())
        order.append(F.col(_TIE))
    placed = (
        df.repartitionByRange(count, *order)
        .sortWithinPartitions(*order)
        .drop(_TIE)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    return durable(placed, "sorted")


def _with_offsets(table: DataFrame, name: str) -> DataFrame:
    # One row per range partition: the number is fixed by the caller, not by the data.
    sizes = sorted(
        (row[_PART], row["n"])
        for row in table.groupBy(_PART).agg((F.max(_POS) + 1).alias("n")).collect()
    )
    starts = [0, *accumulate(n for _, n in sizes)]
    spark = table.sparkSession
    offsets = spark.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)] or [(0, 0)],
        f"{_PART} int, {_START} bigint",
    )
    return (
        table.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col(_START) + F.col(_POS))
        .drop(_PART, _POS, _START)
    )


def global_index(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "idx",
    partitions: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """0-based position of each row in the total order of ``order_by``.

    ``unique=True`` says that no two rows have the same keys, so no tie-break is needed; with
    ``partitions`` given too, the input is not written first. Should it not hold the result is still
    right, and equal rows meet in one task. Without ``partitions`` there are more than the session's
    when there are more than ``ROWS_PER_PARTITION`` rows for each. Runs jobs while the plan is made.
    """
    return _with_offsets(_sorted_table(df, order_by, partitions, unique), name)


def group_index(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str],
    name: str = "idx",
    partitions: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """0-based position of each row inside its group, for groups too large for one task.

    The position is the global one minus that of the group's first row. ``unique`` is as for
    :func:`global_index`, for groups and order together.
    """
    placed = global_index(df, [*group_by, *order_by], _AT, partitions, unique)
    first = placed.groupBy(*group_by).agg(F.min(_AT).alias(_START))
    first = lookup_side(_group_keys(first, group_by, _START))
    return placed.join(first, _same_group(group_by)).select(
        *df.columns, (F.col(_AT) - F.col(_START)).alias(name)
    )


def _tie_break(df: DataFrame, used: Sequence[str]) -> list[str]:
    # Columns of plain types; those with maps in them have no order.
    return [f.name for f in df.schema if f.name not in used and isinstance(f.dataType, AtomicType)]


def rank_within(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str],
    name: str = "rank",
    hot_rows: int = 1_000_000,
    counted: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """0-based position of each row inside its group, many small groups and a few large ones.

    Groups of up to ``hot_rows`` rows are ranked by a window; larger ones, of which there are at
    most ``rows / hot_rows``, are spread over tasks by :func:`group_index`. Ties of ``order_by`` are
    broken by the other columns that can be ordered, from left to right, in both. Group sizes are
    counted in ``counted`` where given: a frame cheaper to read whose groups are at least as large; or
    they are in ``sizes``, a row of ``group_by`` and ``count`` for each group, where they are known.
    """
    order_by = [*order_by, *_tie_break(df, [*group_by, *order_by])]
    window = Window.partitionBy(*group_by).orderBy(*order_by)
    position = (F.row_number().over(window) - 1).cast("bigint")
    if sizes is None:
        sizes = (df if counted is None else counted).groupBy(*group_by).count()
    hot = _group_keys(sizes.where(F.col("count") > hot_rows), group_by)
    if hot.isEmpty():
        return df.withColumn(name, position)
    hot, df = lookup_side(hot), durable(df, "ranked")
    small = df.join(hot, _same_group(group_by), "left_anti").withColumn(name, position)
    large = group_index(df.join(hot, _same_group(group_by), "left_semi"), group_by, order_by, name)
    return small.unionByName(large)


def line_index(lines: DataFrame, name: str = "idx") -> DataFrame:
    """0-based line number over all files of a positioned scan, in path and file order.

    Needs the position columns of :func:`sheaf.sources.publications.scan_lines`. Lines are not
    shuffled to be numbered: each input block is read in order by one task, so a line's number is
    the block's offset plus its place in the block. The lines are written once first, because two
    scans of the same files may cut them into different blocks.
    """
    lines = durable(lines, "lines")
    blocks = lines.groupBy("source_file", "block_start").agg(
        F.count("*").alias("n"), F.min("scan_seq").alias("first_seq")
    )
    # Blocks of one file, and files, are as many as the input splits Spark's own scan planning
    # already lists on the driver.
    in_file = Window.partitionBy("source_file").orderBy("block_start")
    blocks = blocks.withColumn("before", F.sum("n").over(in_file) - F.col("n"))
    files = sorted(
        (row["source_file"], row["n"])
        for row in blocks.groupBy("source_file").agg(F.sum("n").alias("n")).collect()
    )
    starts = [0, *accumulate(n for _, n in files)]
    file_offsets = lines.sparkSession.createDataFrame(
        [(path, start) for (path, _), start in zip(files, starts)],
        "source_file string, file_start bigint",
    )
    blocks = blocks.join(file_offsets, "source_file").select(
        "source_file", "block_start", "first_seq", (F.col("before") + F.col("file_start")).alias("before")
    )
    return (
        lines.join(lookup_side(blocks), ["source_file", "block_start"])
        .withColumn(name, F.col("before") + F.col("scan_seq") - F.col("first_seq"))
        .drop("source_file", "block_start", "scan_seq", "first_seq", "before")
    )


def slice_ids(
    indexed: DataFrame, total: int, mode: str = "complete", index: str = "idx", name: str = "slice_id"
) -> DataFrame:
    """Slice of every row: ``total + 1`` slices of ``rows // total`` rows.

    The rows past the last slice go into the last one with ``mode="complete"``. With
    ``mode="reference"`` they get a null slice, as slicing one slice at a time never takes them; so do
    all rows when there are fewer than ``total``.
    """
    if total < 1:
        raise ValueError("the number of slices must be at least 1")
    if mode not in ("complete", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    size = indexed.count() // total
    if mode == "reference":
        slice_id = F.expr(f"{index} div {max(size, 1)}")
        return indexed.withColumn(name, F.when((slice_id <= total) & F.lit(size > 0), slice_id))
    return indexed.withColumn(
        name, F.least(F.expr(f"{index} div {max(size, 1)}"), F.lit(total).cast("bigint"))
    )


def take_slice(
    indexed: DataFrame, k: int, total: int, mode: str = "complete", index: str = "idx"
) -> DataFrame:
    """Rows of slice ``k``."""
    sliced = slice_ids(indexed, total, mode, index, "slice_id")
    return sliced.where(F.col("slice_id") == k).drop("slice_id")


def batch_numbers(indexed: DataFrame, size: int, index: str = "idx", name: str = "batch_no") -> DataFrame:
    """Consecutive batches of ``size`` rows; the last may be short, and no rows give no batch."""
    if size < 1:
        raise ValueError("the batch size must be at least 1")
    return indexed.withColumn(name, F.expr(f"{index} div {size}"))


def first_batch(batched: DataFrame, name: str = "batch_no") -> DataFrame:
    """Only batch 0."""
    return batched.where(F.col(name) == 0)

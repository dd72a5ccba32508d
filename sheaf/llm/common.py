"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from sheaf.session import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A task works on texts of about so many bytes at a time, whatever the rows of an Arrow batch add up to.
PIECE_BYTES = 2_000_000


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir), with SQL for the same rows where there is any."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes; one long row is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if rows > 1 and part.nbytes > 2 * limit:
                yield from (part.slice(i, 1) for i in range(part.num_rows))
            else:
                yield part


def hand_back() -> None:
    """Give memory that a task has freed back to the system: idle Python workers of an executor keep it else."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_pieces(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, done: Callable[[], object] | None = None
) -> DataFrame:
    """Apply ``fn`` to slices of bounded bytes; it gives the output columns by name, or None for no rows.

    ``done`` is called at the end of a task, to let go of what it kept.
    """
    types = pa_schema(df.sparkSession, schema)

    def run(batches):
        for part in pieces(batches):
            out = fn(part)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type, from_pandas=False) for f in types], schema=types
                )
        if done:
            done()
        hand_back()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], list], out: DataFrame | None = None) -> DataFrame:
    """Apply ``fn`` to slices of whole rows, of all columns by place; it gives the columns, or a filter (a mask).

    The result has the columns of ``out``, by default those of ``df``. Names with any characters will do.
    """
    like = (df if out is None else out).schema
    inner = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(like)])
    types = to_arrow_schema(inner)

    def run(batches):
        for part in pieces(batches):
            made = fn(part)
            columns = made if isinstance(made, list) else part.filter(made).columns
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, types)], schema=types)
        hand_back()

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, inner).toDF(*like.names)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


# While a table is written: shuffle files go when nothing reads them any more, and batches for Python are small.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def stored(df: DataFrame, label: str) -> DataFrame:
    """``durable``, after which the shuffle files that the write needed are deleted.

    Nothing reads them again: the table is read from the shared folder from here on. This runs a job while
    the plan is made.
    """
    with writing(df.sparkSession):
        return durable(df, label, None)  # mostly columns that are compressed already


@contextlib.contextmanager
def writing(spark: SparkSession):
    """The settings in ``WRITING`` for what is written inside."""
    before = {key: spark.conf.get(key) for key in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key that tells rows apart by id and text; repeated rows share it and get the same answer."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.lit(11))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters are in it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_partitions(docs: DataFrame, bytes_each: int, column: str = "text") -> tuple[int, int]:
    """Partitions of about ``bytes_each`` bytes of text, no fewer than the session's; and the bytes."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // bytes_each)), total

"""Session settings and the shared folder for durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, and bytes as written, above which a lookup side is no longer broadcast by this package.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16_000_000

# By application: the temporary folder of a local session, and the scratch tables made.
_LOCAL: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}
# By application and folder: do executors see it?
_SEEN: dict[str, bool] = {}


def spark_session(master: str | None = None, app: str = "sheaf", **conf) -> SparkSession:
    """A session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    A folder set on the context at run time is the second choice. Only a local session may fall back
    to a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        # Over several executors a plain path may be each machine's own disk; one with a scheme is taken
        # as it is, file: for a mount they share.
        alone = context.master.startswith("local") and "cluster" not in context.master
        if not alone and ":" not in named and not _seen_by_executors(spark, named):
            raise ValueError(f"executors do not see {named}; name a shared store, or file: for a shared mount")
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="sheaf-")
    return _LOCAL[context.applicationId]


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _seen_by_executors(spark: SparkSession, folder: str) -> bool:
    """Whether tasks find a file that the driver writes there; asked once in an application."""
    key = f"{spark.sparkContext.applicationId}|{folder}"
    if key not in _SEEN:
        system, jvm_path = _file_system(spark, folder), spark._jvm.org.apache.hadoop.fs.Path
        if system.getScheme() != "file":
            _SEEN[key] = True
        else:
            marker = f"{folder.rstrip('/')}/sheaf-seen-{uuid.uuid4().hex}"
            system.create(jvm_path(marker)).close()

            def look(batches):
                for batch in batches:
                    yield batch.assign(id=int(os.path.exists(marker)))

            tasks = 4 * spark.sparkContext.defaultParallelism
            found = spark.range(tasks).repartition(tasks).mapInPandas(look, "id long")
            _SEEN[key] = found.where("id = 0").isEmpty()
            system.delete(jvm_path(marker), False)
    return _SEEN[key]


def delete_path(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    return _file_system(spark, path).getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(path)).getLength()


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    path = f"{shared_folder(spark)}/sheaf-{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the scratch tables this application made; call it when no result needs them."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the scratch tables made inside when it is left: for work whose result is written by then."""
    made = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before = set(made)
    try:
        yield
    finally:
        for path in [p for p in made if p not in before]:
            delete_path(spark, path)
            made.remove(path)


def durable(df: DataFrame, label: str = "table", codec: str | None = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later jobs start from the written table: the lineage is cut, and the rows stay the same
    rows when executors are lost and tasks run again. This runs a job while a plan is being made.
    ``codec`` None leaves the compression of the files to the session.
    """
    return _written(df, label, codec)[0]


def _written(df: DataFrame, label: str, codec: str | None = "zstd") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), path


def lookup_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Make ``df`` the lookup side of a join whose other side may be skewed.

    It is written once, while the plan is being made. With at most ``max_rows`` rows
    (``BROADCAST_ROWS``) and ``BROADCAST_BYTES`` bytes as written it gets a broadcast hint. Above
    that it is joined by shuffle, and as it is a plain table now, both inputs
    of the join are plain exchanges: only then does the adaptive skew join split a hot partition of
    the other side. An aggregate or a join left between exchange and join would stop it.
    """
    table, path = _written(df, "lookup")
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    small = table.count() <= limit and folder_bytes(table.sparkSession, path) <= BROADCAST_BYTES
    return F.broadcast(table) if small else table

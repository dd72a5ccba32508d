"""Structured Streaming jobs.

Each micro-batch writes its own ``batch=<id>`` folder, or replaces whole shards, so a batch that
runs again after a failure leaves the same files.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from sheaf.plans.manifest import first_occurrences, with_urls
from sheaf.operators.dedup import assign_ids
from sheaf.session import delete_path, durable, scratch_scope
from sheaf.sinks.status import apply_versions_shards
from sheaf.sinks.version_log import _folders, append_versions, compact_versions

INDEX = "doi string, uuid string"
MANIFEST = (
    "id string, doi string, domain string, oa_locations array<map<string, string>>, "
    "urls array<string>, filename string"
)


def _folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _start_empty(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("ignore").parquet(_folder(path, -1))


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches written so far, with their number in ``batch``."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)


def _run(df: DataFrame, step, checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB: a query keeps the settings it starts with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stream_manifest(
    records: DataFrame,
    folder: str,
    order_by: Sequence[str] = ("line_no",),
    country: str = "fr",
    available_now: bool = True,
) -> StreamingQuery:
    """New dump files -> manifest rows, each DOI once over all batches.

    The DOI index is a table, not state in the executors: it is exact, has no time limit, and a
    batch first drops its own repeats, so a hot DOI meets the index as one row.
    """
    spark = records.sparkSession
    index, out = f"{folder}/index", f"{folder}/manifest"
    _start_empty(spark, index, INDEX)
    _start_empty(spark, out, MANIFEST)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = read_batches(spark, index, INDEX).where(F.col("batch") < batch_id).select("doi")
        fresh = first_occurrences(batch, order_by, country).join(seen, "doi", "left_anti")
        with scratch_scope(spark):
            fresh = durable(assign_ids(fresh), "fresh")
            with_urls(fresh).write.mode("overwrite").parquet(_folder(out, batch_id))
            fresh.select("doi", F.col("id").alias("uuid")).write.mode("overwrite").parquet(
                _folder(index, batch_id)
            )

    return _run(records, step, f"{folder}/checkpoint", "append", available_now)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return read_batches(spark, f"{folder}/manifest", MANIFEST).drop("batch")


def stream_manifest_state(
    records: DataFrame,
    folder: str,
    order_by: Sequence[str] = ("line_no",),
    country: str = "fr",
    available_now: bool = True,
) -> StreamingQuery:
    """New dump files -> manifest rows as :func:`stream_manifest` gives, the known DOIs in state instead of a table.

    A first query writes each batch's first occurrences, a DOI once, under the number of the batch. A second one
    keeps in RocksDB, for each DOI, the first batch that has it: DOIs whose first batch comes after all that were
    taken before are new, and only those batches are read for their records. So what a batch reads does not grow
    with the batches before it, and batches that are done may be deleted from ``<folder>/firsts``. A batch that
    runs again finds its DOIs under the same first batch and writes the same rows.

    With ``available_now`` the first query has ended when this returns the second; else both go on.
    """
    spark = records.sparkSession
    firsts, out, progress = f"{folder}/firsts", f"{folder}/manifest", f"{folder}/progress"
    layout = first_occurrences(spark.createDataFrame([], records.schema), order_by, country).schema
    spark.createDataFrame([], layout).write.mode("ignore").parquet(_folder(firsts, -1))
    _start_empty(spark, out, MANIFEST)

    def stage(batch: DataFrame, batch_id: int) -> None:
        first_occurrences(batch, order_by, country).write.mode("overwrite").parquet(_folder(firsts, batch_id))

    staging = _run(records, stage, f"{folder}/checkpoint-firsts", "append", available_now)
    if available_now:
        staging.awaitTermination()

    def step(found: DataFrame, batch_id: int) -> None:
        spark = found.sparkSession
        done = [int(name) for name in _folders(spark, progress, "batch") if int(name) < batch_id]
        before = spark.read.parquet(_folder(progress, max(done))).first()["through"] if done else -1
        with scratch_scope(spark):
            found = durable(found.where(F.col("first") > before), "found")
            rows = spark.read.schema(StructType([*layout, StructField("batch", LongType())])).parquet(firsts)
            rows = rows.where(F.col("batch") > before)
            new = found.select(F.col("doi").alias("found_doi"), "first")
            rows = rows.join(new, (F.col("doi") == F.col("found_doi")) & (F.col("batch") == F.col("first")))
            with_urls(assign_ids(rows.select(*layout.names))).write.mode("overwrite").parquet(_folder(out, batch_id))
            through = found.agg(F.coalesce(F.max("first"), F.lit(before)).cast("long").alias("through"))
            through.coalesce(1).write.mode("overwrite").parquet(_folder(progress, batch_id))
        for old in sorted(done)[:-1]:
            delete_path(spark, _folder(progress, old))

    staged = spark.readStream.schema("doi string, batch bigint").parquet(firsts)
    seen = staged.groupBy("doi").agg(F.min("batch").alias("first"))
    with rocksdb_state(spark):
        return _run(seen, step, f"{folder}/checkpoint", "update", available_now)


def stream_version_log(
    events: DataFrame,
    log: str,
    checkpoint: str,
    digits: int = 1,
    compact_bytes: int | None = 64 << 20,
    available_now: bool = True,
) -> StreamingQuery:
    """Append each batch of version events to a log beside the status table, which ``scan_status_merged`` folds in.

    A batch writes its own events only; shards of the log are compacted once they pass ``compact_bytes``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        append_versions(batch, log, batch_id, digits)
        if compact_bytes is not None:
            compact_versions(batch.sparkSession, log, compact_bytes)

    return _run(events, step, checkpoint, "append", available_now)


def stream_upsert(
    events: DataFrame,
    status_path: str,
    checkpoint: str,
    digits: int | None = None,
    available_now: bool = True,
    seqs: str | None = None,
) -> StreamingQuery:
    """Fold each batch of version events into the sharded status table; the greatest ``seq`` wins.

    Events may come in any order, over any number of batches: the last ``seq`` taken for a uuid and
    service is kept beside the table, in ``seqs`` (``<status_path>-seqs`` by default).
    """
    seqs = seqs or f"{status_path.rstrip('/')}-seqs"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            # The batch is read for its shards and again for its versions.
            apply_versions_shards(spark, status_path, durable(batch, "events"), digits, seqs)

    return _run(events, step, checkpoint, "append", available_now)


RATE = "window_start timestamp, client string, n bigint, over_limit boolean"


def request_rate(
    requests: DataFrame, limits: dict[str, tuple[int, int]], seconds: int, default_max: int = 1, delay: str | None = None
) -> DataFrame:
    """Requests per client and window of that client, flagged when over its maximum.

    ``limits`` is ``client -> (max requests, window seconds)``; other clients have ``default_max`` and
    windows of ``seconds``. Windows start at multiples of their length. Works on a batch and, with ``delay``, on a
    stream: the end of a request's window carries the watermark, which leaves room for the longest window, so
    that a window's state goes once it has been over for the delay and that length.
    """
    allowed, length = F.lit(default_max), F.lit(seconds)
    for client, (most, own) in limits.items():
        allowed = F.when(F.col("client") == client, F.lit(most)).otherwise(allowed)
        length = F.when(F.col("client") == client, F.lit(own)).otherwise(length)
    since = F.unix_seconds("ts")
    start = since - F.pmod(since, length)
    rows = requests.select("client", F.timestamp_seconds(start).alias("window_start"), F.timestamp_seconds(start + length).alias("window_end"))
    if delay is not None:
        longest = max([seconds, *(own for _, own in limits.values())])
        rows = rows.withWatermark("window_end", f"{delay} {longest} seconds")
    counts = rows.groupBy("window_end", "window_start", "client").agg(F.count("*").alias("n"))
    return counts.select("window_start", "client", "n", (F.col("n") > allowed).alias("over_limit"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the progress the query still holds.

    Rows that meet in one batch, client and window are one row by then.
    """
    return sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"])


def stream_request_rate(
    requests: DataFrame,
    folder: str,
    limits: dict[str, tuple[int, int]],
    seconds: int,
    delay: str = "1 hour",
    default_max: int = 1,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the request counts of every window; requests later than ``delay`` may not be counted.

    A request is left out if its window ended more than ``delay`` and the longest window before the end of the
    newest one. :func:`late_rows` tells how many those were.

    Counts are written as they change, so the last windows are there before the watermark passes
    them; :func:`read_request_rate` takes the newest count of each window.
    """
    spark = requests.sparkSession
    out = f"{folder}/rate"
    _start_empty(spark, out, RATE)
    counted = request_rate(requests, limits, seconds, default_max, delay)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(out, batch_id))

    return _run(counted, step, f"{folder}/checkpoint", "update", available_now)


def read_request_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Newest count of each window and client."""
    return (
        read_batches(spark, f"{folder}/rate", RATE)
        .groupBy("window_start", "client")
        .agg(F.max(F.struct("batch", "n", "over_limit")).alias("last"))
        .select("window_start", "client", "last.n", "last.over_limit")
    )


ANCHORED = "client string, start long, n long, over_limit boolean, final boolean, step long"
# Times to a block of the state.
WAITING_BLOCK = 65_536


def merged(times: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The times of all parts in order, each once, with the sums of their counts."""
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined, weights = np.concatenate(times), np.concatenate(counts)
    order = np.argsort(joined, kind="stable")
    joined, weights = joined[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], joined[1:] != joined[:-1]))) if len(joined) else np.zeros(0, np.int64)
    return joined[first], np.add.reduceat(weights, first) if len(first) else weights


class AnchoredWindows(StatefulProcessor):
    """The windows of one client, each opened by the first request after the one before has ended.

    Requests wait, counted by time, until the watermark has passed them, as an earlier one may move all windows
    after it. One timer for each client tells when the next of them, or the end of the open window, is passed.
    Windows that are over for good are given once, as final ones. All others are given as they look so far, under a
    new step each time, of which the last one holds; a row without a start marks the step itself.
    """

    def __init__(self, limits: dict[str, tuple[int, float]], seconds: float, default_max: int):
        self.limits, self.default = limits, (default_max, seconds)

    def init(self, handle) -> None:
        self.handle = handle
        # Sorted times and counts, of 8 bytes each, in blocks: a call of the state store for each block, not for each time.
        self.waiting = handle.getListState("waiting", "times binary, counts binary")
        self.open = handle.getValueState("open", "start long, n long, step long")

    def windows(self, client, window, times: np.ndarray, counts: np.ndarray):
        """All windows that these sorted times, with so many requests each, make after ``window``, the last of them still open."""
        span = round(self.limits.get(client, self.default)[1] * 1_000_000)
        starts, at = [] if window is None else [window[0]], 0
        if starts:
            at = int(np.searchsorted(times, starts[0] + span))
        first = [0] if window is not None else []
        while at < len(times):
            starts.append(int(times[at]))
            first.append(at)
            at = max(at + 1, int(np.searchsorted(times, starts[-1] + span)))
        sums = np.concatenate(([0], np.cumsum(counts)))
        sizes = np.diff(sums[[*first, len(times)]]) if first else []
        out = [(start, int(n)) for start, n in zip(starts, sizes)]
        if window is not None:
            out[0] = (out[0][0], out[0][1] + window[1])
        return out, span

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """What waits: times in order, each once, and their requests."""
        blocks = list(self.waiting.get()) if self.waiting.exists() else []
        times = [np.frombuffer(t, "<i8") for t, _ in blocks]
        counts = [np.frombuffer(n, "<i8") for _, n in blocks]
        return merged(times, counts)

    def settle(self, client, passed: int, new: tuple[list, list] = ((), ())):
        start, n, step = self.open.get() if self.open.exists() else (None, 0, 0)
        times, counts = self.take()
        times, counts = merged([times, *new[0]], [counts, *new[1]])
        due = int(np.searchsorted(times, passed, "right"))
        found, span = self.windows(client, None if start is None else (start, n), times[:due], counts[:due])
        over = [w for w in found if w is not found[-1] or w[0] + span <= passed]
        window = found[-1] if len(over) < len(found) else None
        self.open.update((*(window or (None, 0)), step + 1))
        times, counts = times[due:], counts[due:]
        self.waiting.clear()
        cuts = range(0, len(times), WAITING_BLOCK)
        blocks = [(times[k : k + WAITING_BLOCK].astype("<i8").tobytes(), counts[k : k + WAITING_BLOCK].astype("<i8").tobytes()) for k in cuts]
        for block in blocks:
            self.waiting.appendValue(block)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [int(t) for t in times[:1]] + ([window[0] + span] if window else [])
        if ends:
            self.handle.registerTimer(-(-min(ends) // 1000))
        most = self.limits.get(client, self.default)[0]
        rows = [(client, s, k, k > most, True, step + 1) for s, k in over]
        rows += [(client, s, k, k > most, False, step + 1) for s, k in self.windows(client, window, times, counts)[0]]
        rows.append((client, None, 0, False, False, step + 1))
        frame = pd.DataFrame(rows, columns=["client", "start", "n", "over_limit", "final", "step"])
        return frame.astype({"start": "Int64"})

    def handleInputRows(self, key, rows, timerValues):
        new = [], []
        for frame in rows:
            times, counts = np.unique(frame["us"].to_numpy(np.int64), return_counts=True)
            new[0].append(times)
            new[1].append(counts.astype(np.int64))
        yield self.settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def stream_anchored_rate(
    requests: DataFrame,
    folder: str,
    limits: dict[str, tuple[int, float]],
    seconds: float,
    delay: str = "1 hour",
    default_max: int = 1,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the request counts of windows that a client's requests open; see :class:`AnchoredWindows`.

    State is what has come within ``delay``, counted by time, and one window for each client, in RocksDB; later
    requests, and those without ``ts``, are not counted. :func:`read_anchored_rate` gives the windows as they are.
    """
    spark = requests.sparkSession
    out = f"{folder}/anchored"
    _start_empty(spark, out, ANCHORED)
    rows = requests.where(F.col("ts").isNotNull()).select("client", "ts", F.unix_micros("ts").alias("us"))
    keyed = rows.withWatermark("ts", delay).groupBy("client")
    counted = keyed.transformWithStateInPandas(AnchoredWindows(limits, seconds, default_max), ANCHORED, "update", "eventTime")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(out, batch_id))

    with rocksdb_state(spark):
        return _run(counted, step, f"{folder}/checkpoint", "update", available_now)


def read_anchored_rate(spark: SparkSession, folder: str) -> DataFrame:
    """client, window_start, n and over_limit: the final windows, and of the others what was given last."""
    rows = read_batches(spark, f"{folder}/anchored", ANCHORED)
    last = rows.groupBy("client").agg(F.max(F.struct("batch", "step")).alias("last"))
    last = last.select(F.col("client").alias("own"), "last.batch", F.col("last.step").alias("newest")).withColumnRenamed("batch", "newest_batch")
    current = rows.join(last, F.col("client").eqNullSafe(F.col("own")))
    current = current.where("start is not null and (final or (batch = newest_batch and step = newest))")
    return current.select("client", F.timestamp_micros("start").alias("window_start"), "n", "over_limit")

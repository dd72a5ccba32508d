"""Windows that start at a request: throttling and counting by arrival times.

A window of a client opens at the first request that comes after the one before has ended, so each window's place
depends on all requests before it. What is carried from one request to the next is small, though: the arrival at
which a client was last free (the anchor), and how many requests it has taken since. While requests wait, windows
follow each other without a pause and are full, so that request ``k`` after the anchor goes out in window
``k // most`` from it, at its arrival or at the start of that window, whichever is later; and the first request that
comes when the window of the one before is over is the next anchor.

Requests are range-partitioned by client and time into blocks. Each block is run through by itself; then the state
that a block ends with is handed to the next one where a client goes on there, and blocks that started from another
state are run through once more, all at the same time, until none has to be. Blocks of several clients end with the
same state whatever they start from, and a client's windows soon fall into step, so few rounds are usual; there
are never more than blocks. Only one state for each block is on the driver. A hot client is spread over as many
tasks as it has blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from sheaf.operators.index import _PART, _POS, _sorted_table
from sheaf.session import durable, lookup_side

# Requests to a block.
BLOCK_ROWS = 250_000
UNLIMITED = 1 << 62


class State(NamedTuple):
    """When a client was last free, in microseconds, and the requests taken since."""

    anchor: int
    taken: int


class Limit(NamedTuple):
    most: int
    span: int  # microseconds


def limit_of(limits: dict, default: tuple[int, float], client) -> Limit:
    most, seconds = limits.get(client, default)
    return Limit(most, round(seconds * 1_000_000))


def next_anchor(arrivals: np.ndarray, limit: Limit, state: State, at: int) -> int:
    """The first request from place ``at`` on that finds the window of the one before over; their number if none does.

    ``state`` is as it was at place 0. Looks twice as far each time.
    """
    step = 64
    while at < len(arrivals):
        part = arrivals[at : at + step]
        window = (state.taken + np.arange(at, at + len(part)) - 1) // limit.most
        free = part >= state.anchor + (window + 1) * limit.span
        if free.any():
            return at + int(free.argmax())
        at += len(part)
        step *= 2
    return len(arrivals)


def anchors(arrivals: np.ndarray, limit: Limit, state: State | None) -> tuple[list[int], State]:
    """The places of one client's requests, in order, that are anchors, and the state after the last of them."""
    n, times = len(arrivals), arrivals.tolist()
    at = 0 if state is None else next_anchor(arrivals, limit, state, 0)
    found = []
    while at < n:
        found.append(at)
        after = max(at + 1, bisect_left(times, times[at] + limit.span, at))
        if after - at > limit.most:  # some have to wait
            after = next_anchor(arrivals, limit, State(times[at], -at), at + limit.most)
        at = after
    if not found:
        return found, State(state.anchor, state.taken + n)
    return found, State(times[found[-1]], n - found[-1])


def schedule(arrivals: np.ndarray, limit: Limit, state: State | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each request the start of its window, its place in it from 1, and when it goes out."""
    found, _ = anchors(arrivals, limit, state)
    first = np.array([0, *found], np.int64)
    base = np.array([state.anchor if state else 0, *arrivals[found].tolist()], np.int64)
    offset = np.array([state.taken if state else 0, *[0] * len(found)], np.int64)
    place = np.arange(len(arrivals))
    own = np.searchsorted(first[1:], place, "right")
    since = place - first[own] + offset[own]
    start = base[own] + since // limit.most * limit.span
    return start, since % limit.most + 1, np.maximum(arrivals, start)


def client_runs(clients: pa.ChunkedArray) -> list[tuple[object, int, int]]:
    """(client, low, high) of the runs of equal clients."""
    codes = clients.combine_chunks().dictionary_encode()
    number = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(number) != 0))).tolist() if len(number) else []
    return [(clients[low].as_py(), low, high) for low, high in zip(cuts, [*cuts[1:], len(number)])]


def micros(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().cast(pa.int64()).to_numpy()


ENDS = "part int, first string, last string, anchor long, taken long, arrivals binary"
STATES = "part int, anchor long, taken long"


def block_states(blocks: DataFrame, limits: dict, default: tuple[int, float]) -> dict[int, State]:
    """The state that each block starts from, where its first client goes on from the block before."""
    spark = blocks.sparkSession

    def end(table: pa.Table) -> pa.Table:
        table = table.sort_by(_POS)
        runs, times = client_runs(table.column("client")), micros(table.column("ts"))
        client, low, high = runs[-1]
        state = anchors(times[low:high], limit_of(limits, default, client), None)[1]
        alone = times.astype("<i8").tobytes() if len(runs) == 1 else None
        row = [table.column(_PART)[0].as_py(), runs[0][0], client, *state, alone]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=["part", "first", "last", "anchor", "taken", "arrivals"])

    ends = durable(blocks.select(_PART, _POS, "client", "ts").groupBy(_PART).applyInArrow(end, ENDS), "block_ends")
    rows = sorted(ends.select("part", "first", "last", "anchor", "taken", F.col("arrivals").isNotNull().alias("alone")).collect())
    after = {r["part"]: State(r["anchor"], r["taken"]) for r in rows}
    used: dict[int, State | None] = {r["part"]: None for r in rows}

    def again(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                times = np.frombuffer(row["arrivals"], "<i8")
                out.append((row["part"], *anchors(times, limit_of(limits, default, row["first"]), State(row["anchor"], row["taken"]))[1]))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["part", "anchor", "taken"])

    while True:
        given = {b["part"]: after[a["part"]] for a, b in zip(rows, rows[1:]) if a["last"] == b["first"]}
        changed = [(r["part"], *given[r["part"]]) for r in rows if r["alone"] and r["part"] in given and given[r["part"]] != used[r["part"]]]
        if not changed:
            return given
        states = spark.createDataFrame(changed, STATES)
        todo = ends.where("arrivals is not null").select("part", "first", "arrivals").join(states, "part")
        after.update({r["part"]: State(r["anchor"], r["taken"]) for r in todo.mapInArrow(again, STATES).collect()})
        used.update({part: given[part] for part, _, _ in changed})


def throttle_arrivals(
    requests: DataFrame, client: str, ts: str, limits: dict[str, tuple[int, float]], default: tuple[int, float] = (1, 1),
    order_by: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """When each request goes out if a client takes ``most`` of them in a window that its first one opens.

    Requests of a client go in the order of ``ts``, then ``order_by``. One that finds the window full waits for its
    end and opens the next one. Adds ``window_start``, ``place`` (in the window, from 1) and ``sent_at``. ``limits`` is
    ``client -> (most, seconds)``. A null client is a client of its own, with the default; a null ``ts`` gets nulls.
    Runs jobs while the plan is made.
    """
    for most, seconds in [*limits.values(), default]:
        if most < 1 or seconds < 0:
            raise ValueError("a limit needs at least 1 request and a window of 0 s or more")
    added = [StructField("window_start", TimestampType()), StructField("place", LongType()), StructField("sent_at", TimestampType())]
    if clash := {f.name for f in added} & set(requests.columns):
        raise ValueError(f"the requests have columns of these names already: {sorted(clash)}")
    spark = requests.sparkSession
    whole = requests.withColumns({"client": F.col(client).cast("string"), "ts": F.col(ts).cast("timestamp")}) if (client, ts) != ("client", "ts") else requests
    timed = whole.where(F.col("ts").isNotNull())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(timed.count() / block_rows))
    blocks = _sorted_table(timed, ["client", "ts", *order_by], parts, False)
    states = block_states(blocks, limits, default)
    known = spark.createDataFrame([(part, *state) for part, state in states.items()], f"{_PART} int, __anchor long, __taken long")
    rows = blocks.join(lookup_side(known), _PART, "left")
    schema, names = StructType([*whole.schema.fields, *added]), whole.columns

    def send(table: pa.Table) -> pa.Table:
        table = table.sort_by(_POS)
        times, out = micros(table.column("ts")), []
        for k, (name, low, high) in enumerate(client_runs(table.column("client"))):
            anchor = table.column("__anchor")[0].as_py() if k == 0 else None
            state = None if anchor is None else State(anchor, table.column("__taken")[0].as_py())
            out.append(schedule(times[low:high], limit_of(limits, default, name), state))
        start, place, sent = map(np.concatenate, zip(*out))
        moment = pa.timestamp("us", "UTC")
        columns = [*(table.column(c) for c in names), pa.array(start).cast(moment), pa.array(place), pa.array(sent).cast(moment)]
        return pa.table(columns, names=[*names, *(f.name for f in added)])

    done = rows.groupBy(_PART).applyInArrow(send, schema)
    untimed = whole.where(F.col("ts").isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return done.unionByName(untimed).select(*requests.columns, *[f.name for f in added])


def anchored_rate(
    requests: DataFrame, limits: dict[str, tuple[int, float]], seconds: float, default_max: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Requests (client, ts) by client and window, flagged when over the client's maximum; nothing is held back.

    A window opens at the first request after the one before has ended. Requests without ``ts`` are not counted.
    """
    spans = {name: (UNLIMITED, own) for name, (_, own) in limits.items()}
    placed = throttle_arrivals(requests.select("client", "ts").where(F.col("ts").isNotNull()), "client", "ts", spans, (UNLIMITED, seconds), block_rows=block_rows)
    allowed = F.lit(default_max)
    for name, (most, _) in limits.items():
        allowed = F.when(F.col("client") == name, F.lit(most)).otherwise(allowed)
    counts = placed.groupBy("client", "window_start").agg(F.count("*").alias("n"))
    return counts.select("client", "window_start", "n", (F.col("n") > allowed).alias("over_limit"))

"""Windows opened by requests, against a plain run through them."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.operators import arrivals
from sheaf.streaming import jobs

START = datetime(2024, 1, 1)


def plain_schedule(times, most, span):
    out, start, place, sent = [], None, 0, None
    for t in times:
        if start is None or t >= start + span:
            start, place, sent = t, 1, t
        elif place < most:
            place, sent = place + 1, max(t, sent)
        else:
            start, place, sent = start + span, 1, start + span
        out.append((start, place, sent))
    return out


def arrival_times(own, n, rate):
    at, out = 0, []
    for _ in range(n):
        at += own.choice([0, 0, 1, 2, 5, rate, 10 * rate])
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_schedule_of_one_client_in_any_blocks(seed):
    own = random.Random(seed)
    times = np.array(arrival_times(own, own.randrange(1, 400), own.choice([1, 7, 40])), np.int64)
    limit = arrivals.Limit(own.choice([1, 2, 3, 10, arrivals.UNLIMITED]), own.choice([0, 1, 5, 30, 500]))
    got, state, at = [], None, 0
    while at < len(times):
        part = times[at : at + own.randrange(1, 60)]
        got += zip(*(c.tolist() for c in arrivals.schedule(part, limit, state)))
        state = arrivals.anchors(part, limit, state)[1]
        at += len(part)
    assert got == plain_schedule(times.tolist(), *limit)


def requests(spark, seed=1, n=1500):
    own, rows = random.Random(seed), []
    for client, rate in (("hot", 1), ("cold", 90), (None, 20), ("instant", 3)):
        rows += [(client, START + timedelta(seconds=t), own.random()) for t in arrival_times(own, n if client == "hot" else n // 10, rate)]
    rows += [("hot", None, 0.5), (None, None, 0.5)]
    own.shuffle(rows)
    return spark.createDataFrame(rows, "client string, ts timestamp, tie double").withColumns({"part": F.lit("p"), "anchor": F.lit(1), "first": F.lit(None).cast("string")})


LIMITS = {"hot": (3, 7), "instant": (1, 0), "absent": (1, 1)}


@pytest.mark.parametrize("block_rows", [arrivals.BLOCK_ROWS, 60])
def test_throttle_spreads_a_hot_client(spark, block_rows):
    docs = requests(spark)
    sent = arrivals.throttle_arrivals(docs, "client", "ts", LIMITS, (2, 30), ["tie"], block_rows)
    assert sent.columns == [*docs.columns, "window_start", "place", "sent_at"]
    rows = sent.collect()
    assert len(rows) == docs.count()
    for client in ("hot", "cold", None, "instant"):
        own = sorted((r for r in rows if r.client == client and r.ts), key=lambda r: (r.ts, r.tie))
        times = [round((r.ts - START).total_seconds()) for r in own]
        got = [(round((r.window_start - START).total_seconds()), r.place, round((r.sent_at - START).total_seconds())) for r in own]
        assert got == plain_schedule(times, *LIMITS.get(client, (2, 30)))
    assert all(r.window_start is r.place is r.sent_at is None for r in rows if r.ts is None)
    if block_rows == 60:
        blocks = arrivals._sorted_table(docs.where("client = 'hot' and ts is not null"), ["client", "ts", "tie"], 25, False)
        largest = blocks.groupBy(arrivals._PART).count().agg(F.max("count")).first()[0]
        assert largest < 300, "one client in many blocks"


def test_throttle_of_nothing_and_bad_limits(spark):
    assert arrivals.throttle_arrivals(requests(spark).limit(0), "client", "ts", {}).count() == 0
    with pytest.raises(ValueError, match="at least 1 request"):
        arrivals.throttle_arrivals(requests(spark), "client", "ts", {"hot": (0, 1)})
    with pytest.raises(ValueError, match="place"):
        arrivals.throttle_arrivals(requests(spark).withColumn("place", F.lit(1)), "client", "ts", {})


def plain_windows(data, spans, default):
    out = {}
    for client in {c for c, _ in data}:
        start = None
        for t in sorted(t for c, t in data if c == client):
            if start is None or t >= start + spans.get(client, default):
                start = t
            out[client, start] = out.get((client, start), 0) + 1
    return out


def test_rate_counts_what_comes(spark):
    docs = requests(spark)
    got = arrivals.anchored_rate(docs, {"hot": (5, 7), "instant": (1, 0)}, 30, 2, block_rows=100).collect()
    data = [(r.client, round((r.ts - START).total_seconds())) for r in docs.where("ts is not null").collect()]
    want = plain_windows(data, {"hot": 7, "instant": 0}, 30)
    # a window of no length takes one request
    assert {(r.client, round((r.window_start - START).total_seconds())): r.n for r in got if r.client != "instant"} == {k: n for k, n in want.items() if k[0] != "instant"}
    assert all(r.over_limit == (r.n > {"hot": 5, "instant": 1}.get(r.client, 2)) for r in got)


def test_stream_moves_windows_when_an_earlier_request_comes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = []

    def run(*offsets, counted=None):
        rows = [(c, START + timedelta(seconds=s)) for c, s in offsets]
        data.extend(offsets if counted is None else counted)
        spark.createDataFrame(rows, "client string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("client string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_anchored_rate(stream, out, {"a": (2, 10)}, 20, delay="30 seconds").awaitTermination()
        got = {(r.client, round((r.window_start - START).total_seconds())): (r.n, r.over_limit) for r in jobs.read_anchored_rate(spark, out).collect()}
        most = {"a": 2}
        assert got == {k: (n, n > most.get(k[0], 1)) for k, n in plain_windows(data, {"a": 10}, 20).items()}

    run(("a", 5), ("a", 12), ("a", 16), ("b", 3), (None, 1))
    run(("a", 2), ("a", 13), ("b", 1), ("b", 22))  # all windows move
    run(("a", 100), ("b", 90), (None, 1), counted=[("a", 100), ("b", 90), (None, 1)])
    run(("a", 3), ("a", 101), ("b", 95), counted=[("a", 101), ("b", 95)])  # too late by now
    run(("a", 300), ("c", 301))
    run(("a", 301), ("c", 302), ("c", 330))


def test_the_stream_asks_its_state_by_block(monkeypatch):
    """One call for each block of times, whatever the number of requests; windows as from one request at a time."""

    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def called(self, result=None):
            self.calls += 1
            return result

        def exists(self):
            return self.called(bool(self.rows))

        def get(self):
            return self.called(iter(self.rows) if self.blocks else self.rows[0])

        def clear(self):
            self.rows = self.called([])

        def appendValue(self, row):
            self.rows = self.called([*self.rows, row])

        def update(self, row):
            self.rows = self.called([row])

    class Handle:
        def __init__(self):
            self.made, self.timers = {}, []

        def getListState(self, name, schema):
            self.made[name] = State()
            self.made[name].blocks = True
            return self.made[name]

        def getValueState(self, name, schema):
            self.made[name] = State()
            self.made[name].blocks = False
            return self.made[name]

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, timer):
            self.timers.remove(timer)

        def registerTimer(self, timer):
            self.timers.append(timer)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    monkeypatch.setattr(jobs, "WAITING_BLOCK", 1000)
    rng = np.random.default_rng(7)
    times = rng.integers(0, 3_000, 20_000) * 1_000_000
    for span in (10, 0):
        handle, windows, final = Handle(), jobs.AnchoredWindows({"a": (2, span)}, 20, 1), {}
        windows.init(handle)
        done = 0
        for low, high, passed in ((0, 8_000, -1), (8_000, 16_000, -1), (16_000, 20_000, 2_000)):
            part = times[low:high]
            frames = iter(pd.DataFrame({"us": part[k : k + 500]}) for k in range(0, len(part), 500))
            out = pd.concat(windows.handleInputRows(("a",), frames, At(passed * 1000)))
            out = out[out.start.notna()]
            final.update({int(r.start): r.n for r in out[out.final].itertuples()})
            done = final | {int(r.start): r.n for r in out[~out.final].itertuples()}
        want = plain_windows([("a", int(t) // 1_000_000) for t in times], {"a": span}, 20)
        assert done == {start * 1_000_000: n for (_, start), n in want.items()}
        assert sum(s.calls for s in handle.made.values()) < 100

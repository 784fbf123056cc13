"""Streams against their batch twins, on files in any order, and the size of their state."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import windows
from tessera.sources.scratch import shared_path
from tessera.streaming import events, stateful

START = datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, ts timestamp, event_type string"


def rows(n, hours, users, seed=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(users), START + timedelta(seconds=rng.randrange(hours * 3600), microseconds=rng.randrange(10**6)), rng.choice(["ok", "error", "signup"])) for i in range(n)]


@pytest.fixture
def shuffled(spark):
    """Seven files, events dealt to them at random."""
    data = rows(900, 60, 6)
    path = shared_path(spark, "events")
    rng = random.Random(1)
    rng.shuffle(data)
    for i in range(7):
        spark.createDataFrame(data[i::7], EVENTS).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(data, EVENTS)


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def cells(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_rate_limit(spark, shuffled):
    path, batch = shuffled
    got = events.settled(events.run_once(stateful.rate_limit(stream(spark, path), 2, "30 days"), "update"), "event_id")
    want = windows.rate_limit(batch, 2, "hour").select("event_id", "user_id", "window_start", "n", "allowed")
    assert cells(got.select("event_id", "owner", "window_start", "n", "passed")) == cells(want)


def test_login_throttle(spark, shuffled):
    path, batch = shuffled
    attempts = lambda e: e.select("event_id", F.col("user_id").alias("ip"), "ts", (F.col("event_type") != "error").alias("ok"))
    got = events.settled(events.run_once(stateful.login_throttle(attempts(stream(spark, path)), 2, 300, "30 days"), "update"), "event_id")
    want = windows.login_throttle(attempts(batch), 2, 300)
    assert want.where("blocked").count() > 50
    assert cells(got.select("event_id", "owner", "window_start", ~F.col("passed"))) == cells(want.select("event_id", "ip", "window_start", "blocked"))


def test_cache_hits(spark, shuffled):
    path, batch = shuffled
    requests = lambda e: e.select(F.col("user_id").alias("key"), "ts", "event_id")
    got = events.settled(events.run_once(stateful.cache_hits(requests(stream(spark, path)), 3600, "30 days"), "update"), "event_id")
    want = windows.cache_hits(requests(batch), 3600)
    assert cells(got.select("event_id", "key", "anchor", "hit")) == cells(want.select("event_id", "key", "anchor", "hit"))


@pytest.mark.parametrize("closed", [False, True])
def test_sessions(spark, shuffled, closed):
    path, batch = shuffled
    got = events.settled(events.run_once(stateful.sessions(stream(spark, path), F.col("event_type") == "signup", 8, "30 days", closed), "update"), "session_id")
    own = batch.where("event_type = 'signup'").select(F.col("event_id").alias("session_id"), F.col("ts").alias("created_at"))
    assert cells(got.select("session_id", "expires_at", "live")) == cells(windows.live_sessions(own, F.lit(START - timedelta(days=27)), 8, closed).select("session_id", "expires_at", "live"))


def test_state_stays_small_and_results_right(spark):
    """Files in the order of time but shuffled inside an hour; state holds what is open, not the 400 hours behind it."""
    data = sorted(rows(2400, 400, 5, seed=8), key=lambda r: r[2])
    path = shared_path(spark, "events")
    rng = random.Random(2)
    for i in range(12):
        part = data[i * 200 : (i + 1) * 200]
        rng.shuffle(part)
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(path)
    batch = spark.createDataFrame(data, EVENTS)
    end = max(r[2] for r in data)
    runs = {
        "limit": (lambda e: stateful.rate_limit(e, 2, "1 hour"), 60),
        "throttle": (lambda e: stateful.login_throttle(e.select("event_id", F.col("user_id").alias("ip"), "ts", (F.col("event_type") != "error").alias("ok")), 2, 60, "1 hour"), 60),
        "hits": (lambda e: stateful.cache_hits(e.select(F.col("user_id").alias("key"), "ts", "event_id"), 3600, "1 hour"), 60),
        "sessions": (lambda e: stateful.sessions(e, F.col("event_type") == "signup", 2, "1 hour"), 60),
    }
    got = {}
    for name, (make, most) in runs.items():
        progress = []
        got[name] = events.settled(events.run_once(make(stream(spark, path)), "update", progress=progress), "session_id" if name == "sessions" else "event_id")
        assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= most, name
        assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 0
    assert cells(got["limit"].select("event_id", "n", "passed")) == cells(windows.rate_limit(batch, 2, "hour").select("event_id", "n", "allowed"))
    requests = batch.select(F.col("user_id").alias("key"), "ts", "event_id")
    assert cells(got["hits"].select("event_id", "anchor", "hit")) == cells(windows.cache_hits(requests, 3600).select("event_id", "anchor", "hit"))
    own = batch.where("event_type = 'signup'").select(F.col("event_id").alias("session_id"), F.col("ts").alias("created_at"))
    mark = (end - timedelta(hours=1)).replace(microsecond=(end.microsecond // 1000) * 1000)
    live = windows.live_sessions(own, F.lit(mark), 2)
    assert cells(got["sessions"].select("session_id", "live")) == cells(live.select("session_id", "live"))
    assert live.where("live").count() > 0


class Calls:
    """A handle that keeps lists in memory and counts what is asked of it."""

    def __init__(self):
        self.n, self.rows = 0, []

    def getListState(self, *_):
        return self

    def exists(self):
        self.n += 1
        return bool(self.rows)

    def get(self):
        self.n += 1
        return iter(self.rows)

    def appendList(self, x):
        self.n += 1
        self.rows = self.rows + x

    def put(self, x):
        self.n += 1
        self.rows = x

    def registerTimer(self, _):
        self.n += 1

    def getCurrentWatermarkInMs(self):
        return 0


def test_calls_to_the_state_do_not_grow_with_windows_or_sessions():
    """Events of many owners, windows and sessions, one owner unknown, come as one group, with a few calls."""
    n, hour = 500, 3600 * 10**6
    at = [i * hour // 2 for i in range(n)]
    limit, calls = stateful.RateLimit(1), Calls()
    limit.init(calls)
    owner = [i // 2 % 7 for i in range(n)]
    f = pd.DataFrame({"at": at, "event_id": range(n), "ok": True, "owner": owner, "known": [o > 0 for o in owner], "start": [x - x % hour for x in at]})
    got = next(limit.handleInputRows((0,), iter([f]), calls))
    assert calls.n <= 4 and list(got.sort_values("event_id")["n"]) == [1, 2] * (n // 2)
    assert set(got[got["owner"].isna()]["event_id"]) == {i for i in range(n) if owner[i] == 0}
    own, calls = stateful.Sessions(3600, False), Calls()
    own.init(calls)
    f = pd.DataFrame({"at": at, "session_id": range(n), "known": True})
    assert len(next(own.handleInputRows((0,), iter([f]), calls))) == n and calls.n <= 4

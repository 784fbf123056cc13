"""Time rules as running state: rate limits, login throttling, sessions and the response cache.

Each rule is a ``StatefulProcessor`` in event time. Events may come in any order within the watermark: what is not settled
yet lies in state by key and is judged anew when an earlier event arrives; rows that change are written again,
and the row of the last batch holds (``events.settled``). Timers drop state once the watermark has left it behind, so state
is bounded by what is open and not by the length of the stream. (State with a time to live of its own goes by the
machine's clock, which a replay would not repeat, so timers do its work here.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import CACHE_TTL, LOGIN_FAILURES, LOGIN_MINUTES

EVENT = T.StructType([T.StructField("at", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("ok", T.BooleanType())])
WINDOW_EVENT = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "owner", "at", "event_id")] + [T.StructField(n, T.BooleanType()) for n in ("known", "ok")])
SESSION = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("known", T.BooleanType()), T.StructField("began", T.LongType())])
PLACE = T.StructType([T.StructField("at", T.LongType())])
MICROS = 1_000_000
NEVER = -(1 << 62)
#: Keys of a rule whose windows or sessions are many and small: each call has a cost of its own, so they share groups, dealt by hash.
GROUPS = 1024


def _events(frames: Iterator[pd.DataFrame]) -> list[tuple[int, int, bool]]:
    return [(int(a), int(e), bool(o)) for f in frames for a, e, o in zip(f["at"], f["event_id"], f["ok"])]


class WindowRule(StatefulProcessor):
    """A rule over the events of one owner in one fixed window. A group holds many (start of the window in microseconds, owner)
    and one timer, for the window of it that ends first."""

    names = ["event_id", "owner", "window_start", "n", "passed"]
    schema = "event_id bigint, owner bigint, window_start timestamp, n bigint, passed boolean"

    def __init__(self, width: int):
        self.width = width * MICROS

    def judge(self, oks: list[bool]) -> list[bool]:
        """Which of a window's events pass, in order."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", WINDOW_EVENT)

    def due(self, start: int) -> int:
        return (start + self.width) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(s), int(w), int(a), int(e), bool(k), bool(o)) for f in rows for s, w, a, e, k, o in zip(*(f[c] for c in WINDOW_EVENT.names))]
        old = [tuple(x) for x in self.seen.get()] if self.seen.exists() else []
        self.seen.appendList(new)
        begins = min(x[0] for x in new)
        if not old or begins < min(x[0] for x in old):
            self.handle.registerTimer(self.due(begins))
        window = lambda x: (x[0], x[1], x[4])
        event = lambda x: (x[2], x[3], x[5])
        first: dict = {}
        for x in new:
            first[window(x)] = min(event(x), first.get(window(x), event(x)))
        out = []
        for w, group in groupby(sorted((x for x in old + new if window(x) in first), key=lambda x: (window(x), event(x))), window):
            every = [event(x) for x in group]
            passed = self.judge([ok for _, _, ok in every])
            out += [(x[1], w[1] if w[2] else None, w[0], i, p) for i, (x, p) in enumerate(zip(every, passed), 1) if x >= first[w]]
        yield self.frame(out)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(out, columns=self.names).astype({"owner": "Int64"})
        f["window_start"] = pd.to_datetime(f["window_start"], unit="us")
        return f

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        left = [tuple(x) for x in self.seen.get() if self.due(x[0]) >= mark] if self.seen.exists() else []
        if left:
            self.seen.put(left)
            self.handle.registerTimer(self.due(min(x[0] for x in left)))
        else:
            self.seen.clear()
        yield self.frame([])

    def close(self) -> None:
        pass


class RateLimit(WindowRule):
    """The first ``limit`` events pass."""

    def __init__(self, limit: int, width: int = 3600):
        super().__init__(width)
        self.limit = limit

    def judge(self, oks: list[bool]) -> list[bool]:
        return [i < self.limit for i in range(len(oks))]


class LoginThrottle(WindowRule):
    """After ``failures`` failures in a row nothing passes until the window ends."""

    def __init__(self, failures: int, width: int):
        super().__init__(width)
        self.failures = failures

    def judge(self, oks: list[bool]) -> list[bool]:
        run, out = 0, []
        for ok in oks:
            out.append(run < self.failures)
            if run < self.failures:
                run = 0 if ok else run + 1
        return out


class Sessions(StatefulProcessor):
    """A session's row when it begins, and again, as no longer live, when its time is over, to the millisecond. A group holds many
    sessions and one timer, for the session of it that ends first."""

    names = ["session_id", "expires_at", "live"]
    schema = "session_id bigint, expires_at timestamp, live boolean"

    def __init__(self, ttl: int, closed_at_expiry: bool):
        self.ttl, self.after = ttl * MICROS, 0 if closed_at_expiry else 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SESSION)

    def due(self, began: int) -> int:
        # watermarks and timers count in milliseconds, and a timer fires once the watermark is beyond it
        return (began + self.ttl) // 1000 + self.after - 1

    def held(self) -> dict[tuple[int, bool], int]:
        return {(s, k): b for s, k, b in self.open.get()} if self.open.exists() else {}

    def rows(self, began: dict[tuple[int, bool], int], mark: int) -> pd.DataFrame:
        f = pd.DataFrame([(s if k else None, b + self.ttl, self.due(b) >= mark) for (s, k), b in began.items()], columns=self.names).astype({"session_id": "Int64"})
        f["expires_at"] = pd.to_datetime(f["expires_at"], unit="us")
        return f

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, old, new = timerValues.getCurrentWatermarkInMs(), self.held(), {}
        for f in rows:
            for s, k, b in zip(f["session_id"], f["known"], f["at"]):
                x = int(s), bool(k)
                new[x] = min(int(b), new.get(x, int(b)), old.get(x, int(b)))
        live = {x: b for x, b in new.items() if self.due(b) >= mark}
        if any(x in old for x in new):
            left = {x: b for x, b in (old | live).items() if x in live or x not in new}
            self.open.put([(*x, b) for x, b in left.items()]) if left else self.open.clear()
        elif live:
            self.open.appendList([(*x, b) for x, b in live.items()])
        if live and min(live.values()) < min(old.values(), default=1 << 62):
            self.handle.registerTimer(self.due(min(live.values())))
        yield self.rows(new, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, old = timerValues.getCurrentWatermarkInMs(), self.held()
        left = {x: b for x, b in old.items() if self.due(b) >= mark}
        if left:
            self.open.put([(*x, b) for x, b in left.items()])
            self.handle.registerTimer(self.due(min(left.values())))
        else:
            self.open.clear()
        yield self.rows({x: b for x, b in old.items() if x not in left}, mark)

    def close(self) -> None:
        pass


class CacheHits(StatefulProcessor):
    """Hits of one key: an entry is in force for ``ttl`` seconds, the first request after that makes it anew."""

    names = ["event_id", "key", "anchor", "hit"]
    schema = "event_id bigint, key bigint, anchor timestamp, hit boolean"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", EVENT)
        self.anchor = handle.getValueState("anchor", PLACE)  # the entry in force before the open requests
        self.due = handle.getValueState("due", PLACE)

    def settle(self, events: list[tuple[int, int, bool]], mark: int, out: list | None = None, first: tuple | None = None, key=None) -> int:
        """Walk the open requests in order; those that the watermark has passed go into the anchor. Gives the last anchor."""
        anchor = self.anchor.get()[0] if self.anchor.exists() else NEVER
        settled, left = anchor, []
        for x in events:
            t = x[0] // MICROS
            hit = t - anchor <= self.ttl
            if not hit:
                anchor = t
            if out is not None and x >= first:
                out.append((x[1], key, pd.Timestamp(anchor, unit="s"), hit))
            if x[0] < mark:
                settled = anchor
            else:
                left.append(x)
        if settled != NEVER:
            self.anchor.update((settled,))
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        return anchor

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _events(rows)
        events = sorted(([tuple(x) for x in self.open.get()] if self.open.exists() else []) + new)
        out: list = []
        anchor = self.settle(events, timerValues.getCurrentWatermarkInMs() * 1000, out, min(new), key[0])
        due = (max(anchor + self.ttl, events[-1][0] // MICROS) + 2) * 1000
        if self.due.exists():
            if self.due.get()[0] != due:
                self.handle.deleteTimer(self.due.get()[0])
                self.handle.registerTimer(due)
        else:
            self.handle.registerTimer(due)
        self.due.update((due,))
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the last entry is too old for any request that may still come
        self.open.clear()
        self.anchor.clear()
        self.due.clear()
        yield pd.DataFrame([], columns=self.names)

    def close(self) -> None:
        pass


def _in_time(events: DataFrame, late: str, *columns) -> DataFrame:
    return events.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("at"), *columns)


def _grouped(events: DataFrame, *parts: str):
    return events.withColumn("part", F.pmod(F.xxhash64(*parts), F.lit(GROUPS))).groupBy("part")


def _windows(events: DataFrame, owner: str, seconds: int):
    """Events with the start of their window; an owner may be null, which numbers in pandas would not bear."""
    width = seconds * MICROS
    own = events.select("ts", "at", "event_id", "ok", F.coalesce(owner, F.lit(0)).cast("long").alias("owner"), F.col(owner).isNotNull().alias("known"))
    return _grouped(own.withColumn("start", F.col("at") - F.pmod("at", F.lit(width))), "owner", "known", "start")


def rate_limit(events: DataFrame, limit: int, late: str = "1 hour", seconds: int = 3600) -> DataFrame:
    """(event_id, owner, window_start, n, passed) of (user_id, ts, event_id): the first ``limit`` events of a user in each window pass."""
    own = _in_time(events, late, "event_id", "user_id", F.lit(True).alias("ok"))
    return _windows(own, "user_id", seconds).transformWithStateInPandas(RateLimit(limit, seconds), RateLimit.schema, "Update", "EventTime")


def login_throttle(attempts: DataFrame, failures: int = LOGIN_FAILURES, minutes: int = LOGIN_MINUTES, late: str = "1 hour") -> DataFrame:
    """(event_id, owner, window_start, n, passed) of (ip, ts, event_id, ok): what ``windows.login_throttle`` does not block passes."""
    own = _in_time(attempts, late, "event_id", "ip", "ok")
    return _windows(own, "ip", minutes * 60).transformWithStateInPandas(LoginThrottle(failures, minutes * 60), LoginThrottle.schema, "Update", "EventTime")


def sessions(events: DataFrame, began, hours: float, late: str, closed_at_expiry: bool = False) -> DataFrame:
    """(session_id, expires_at, live): sessions begin with the events for which ``began`` holds, and end a fixed time after by the
    watermark that all events move on. A session that begins twice counts from the first time."""
    # a filter without the time of the event would move below the watermark, which all events move on
    own = events.withWatermark("ts", late).where(F.when(F.unix_micros("ts") > NEVER, began)).select("ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(0)).cast("long").alias("session_id"), F.col("event_id").isNotNull().alias("known"))
    return _grouped(own, "session_id", "known").transformWithStateInPandas(Sessions(int(hours * 3600), closed_at_expiry), Sessions.schema, "Update", "EventTime")


def cache_hits(requests: DataFrame, ttl: int = CACHE_TTL, late: str = "1 hour") -> DataFrame:
    """(event_id, key, anchor, hit) of (key, ts, event_id): what ``windows.cache_hits`` gives."""
    own = _in_time(requests, late, "event_id", F.col("key").cast("long").alias("key"), F.lit(True).alias("ok"))
    return own.groupBy("key").transformWithStateInPandas(CacheHits(ttl), CacheHits.schema, "Update", "EventTime")

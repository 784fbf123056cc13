"""Time rules over event tables: rate limits, login throttling, sessions, response cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMITS = {"message": (50, "hour"), "conversation": (10, "day")}
LOGIN_MINUTES, LOGIN_FAILURES = 15, 5
CACHE_TTL, CACHE_SIZE, CACHE_CONFIDENCE = 3600, 500, 0.55


def rate_limit(events: DataFrame, limit: int, unit: str) -> DataFrame:
    """Adds window_start, n and allowed to (user_id, ts, event_id): the first ``limit`` events of a user in each fixed window pass."""
    own = events.withColumn("window_start", F.date_trunc(unit, "ts"))
    w = Window.partitionBy("user_id", "window_start").orderBy("ts", "event_id")
    return own.withColumn("n", F.row_number().over(w)).withColumn("allowed", F.col("n") <= limit)


def usage(events: DataFrame, limit: int, unit: str) -> DataFrame:
    """(user_id, window_start, used): events that passed."""
    return events.groupBy("user_id", F.date_trunc(unit, "ts").alias("window_start")).agg(F.least(F.count("*"), F.lit(limit)).alias("used"))


def login_throttle(attempts: DataFrame, failures: int = LOGIN_FAILURES, minutes: int = LOGIN_MINUTES) -> DataFrame:
    """Adds window_start and blocked to (ip, ts, event_id, ok).

    Within a window of an address, an attempt is blocked once ``failures`` have failed since the last
    success; blocked attempts neither fail nor succeed, so the first block lasts until the window ends.
    """
    seconds = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds)
    own = attempts.withColumn("window_start", start)
    w = Window.partitionBy("ip", "window_start").orderBy("ts", "event_id")
    own = own.withColumn("island", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = Window.partitionBy("ip", "window_start", "island").orderBy("ts", "event_id")
    own = own.withColumn("run", F.sum((~F.col("ok")).cast("int")).over(i.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w))
    full = F.min(F.when(~F.col("ok") & (F.col("run") == failures), F.col("rn"))).over(Window.partitionBy("ip", "window_start"))
    return own.withColumn("blocked", F.coalesce(F.col("rn") > full, F.lit(False))).drop("island", "run", "rn")


def live_sessions(sessions: DataFrame, as_of: Column, hours: float, closed_at_expiry: bool = False) -> DataFrame:
    """Adds expires_at and live to (session_id, created_at). A session ends a fixed time after it began; with
    ``closed_at_expiry`` it is over at that very moment, else just after."""
    out = sessions.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(secs=F.lit(hours * 3600)))
    return out.withColumn("live", F.col("expires_at") > as_of if closed_at_expiry else F.col("expires_at") >= as_of)


def request_key(question: str, conversation: str, user: str, languages: str, types: str) -> Column:
    """Fingerprint of a request: case and outer blanks of the question, the order of lists and null against empty
    lists do not matter. Parts are told apart as JSON, so no text can stand for several of them."""
    lists = [F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(x) for c, x in ((languages, "l"), (types, "t"))]
    parts = F.struct(F.lower(F.trim(question)).alias("q"), F.col(conversation).cast("string").alias("c"), F.col(user).cast("string").alias("u"), *lists)
    return F.sha2(F.to_json(parts), 256)


def admitted(puts: DataFrame, least: float = CACHE_CONFIDENCE) -> DataFrame:
    """Cache writes (key, ts, event_id, response, confidence) -> one entry for each key: confident ones only, created at the first, the rest from the last."""
    last = F.struct("ts", "event_id")
    g = puts.where(F.col("confidence") >= least).groupBy("key")
    return g.agg(F.min("ts").alias("created_at"), F.max_by("response", last).alias("response"), F.max_by("confidence", last).alias("confidence"), F.max("ts").alias("accessed_at"))


def cache_hits(requests: DataFrame, ttl: int = CACHE_TTL) -> DataFrame:
    """Adds anchor (when the entry in force was made) and hit to (key, ts, event_id).

    A request hits while the entry is at most ``ttl`` seconds old; the first one after that makes it anew.
    A key's different seconds fold in order; what is copied on the way are its entries, one for each ``ttl`` at most.
    """
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    own = requests.withColumn("__t", t)
    times = own.groupBy("key").agg(F.array_sort(F.collect_set("__t")).alias("ts"))
    anchors = F.aggregate("ts", F.array().cast("array<bigint>"), lambda s, x: F.when((F.size(s) > 0) & (x - F.try_element_at(s, F.lit(-1)) <= ttl), s).otherwise(F.concat(s, F.array(x))))
    # an entry answers requests of its own ``ttl`` seconds alone, which two spans of that width hold, so requests meet one or two entries each
    span = lambda c: F.floor(c / F.lit(ttl + 1))
    spans = times.select("key", F.explode(anchors).alias("__a")).select("key", "__a", F.explode(F.array_distinct(F.array(span(F.col("__a")), span(F.col("__a") + ttl)))).alias("__s"))
    j = own.withColumn("__s", span(F.col("__t"))).join(spans, ["key", "__s"]).where((F.col("__t") >= F.col("__a")) & (F.col("__t") <= F.col("__a") + ttl)).drop("__s")
    w = Window.partitionBy("key", "__a").orderBy("ts", "event_id")
    return j.withColumn("hit", F.row_number().over(w) > 1).withColumn("anchor", F.timestamp_seconds("__a")).drop("__t", "__a")


def evicted(entries: DataFrame, limit: int = CACHE_SIZE) -> DataFrame:
    """The tenth of a full cache (one at least) that was used least recently; nothing while there is room."""
    n = max(1, limit // 10)
    full = F.broadcast(entries.agg((F.count("*") >= limit).alias("full")))
    return entries.orderBy("accessed_at", "key").limit(n).crossJoin(full).where("full").drop("full")


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, n_events, n_errors, last_ts) from status events (job_id, status, ts, event_id)."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("n_events"), F.count_if(F.col("status") == "error").alias("n_errors"), F.max("ts").alias("last_ts"))

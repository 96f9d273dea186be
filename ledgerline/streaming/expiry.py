"""Sessions and leases as streams whose state ends: event-time timers remove what has run out, and say so.

The same folds in batch are `session_log` here and `lifecycle.lease_answers`. State lives in RocksDB, which the session must name as its state store (`with_timers`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline.shipping import ship
from ledgerline.streaming.lifecycle import lease_step

SESSION_LOG = "session string, event string, at timestamp"
LEASE_LOG = "target string, request_id string, answer string, token long, at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["at"] = pd.to_datetime(out["at"], unit="ms")
    return out


class _Sessions(StatefulProcessor):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.expires = handle, handle.getValueState("expires", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, before = [], self.expires.get()[0] if self.expires.exists() else None
        expires = before
        for ts in sorted(int(t.timestamp() * 1000) for batch in rows for t in batch["at"]):
            if expires is not None and ts >= expires:
                out.append((key[0], "expired", expires))
                expires = None
            out.append((key[0], "registered" if expires is None else "renewed", ts))
            expires = max(expires or 0, ts + self.ttl)
        if expires != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(expires)
            self.expires.update((expires,))
        yield _frame(out, SESSION_LOG)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.expires.clear()
        yield _frame([(key[0], "expired", at)], SESSION_LOG)


def session_stream(beats: DataFrame, ttl_ms: int, delay: str = "0 seconds") -> DataFrame:
    """session, event (registered, renewed, expired) and at of a stream of beats (session, at). A session ends ttl_ms after its last beat, once the watermark is past that; nothing of it is kept then."""
    with_timers(beats.sparkSession)
    own = beats.select("session", "at").withWatermark("at", delay)
    return own.groupBy("session").transformWithStateInPandas(_Sessions(ttl_ms), SESSION_LOG, "Append", "EventTime")


def session_log(beats: DataFrame, ttl_ms: int, until: Column) -> DataFrame:
    """The same of a table of beats, with the sessions that have ended by `until`."""
    ttl = F.make_dt_interval(secs=F.lit(ttl_ms / 1000))
    w = Window.partitionBy("session").orderBy("at")
    own = beats.select("session", "at", F.lag("at").over(w).alias("_before"), F.lead("at").over(w).alias("_next"))
    came = own.select("session", F.when(F.col("_before").isNull() | (F.col("at") >= F.col("_before") + ttl), "registered").otherwise("renewed").alias("event"), "at")
    ended = own.where(F.col("_next").isNull() | (F.col("_next") >= F.col("at") + ttl)).select("session", F.lit("expired").alias("event"), (F.col("at") + ttl).alias("at"))
    return came.unionByName(ended.where(F.col("at") <= until))


class _Leases(StatefulProcessor):
    """A target's lease goes with its timer; its last token stays as one number, for tokens only grow."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "owner string, token long, expires long")
        self.token = handle.getValueState("token", "last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(self.lease.get()) if self.lease.exists() else None
        token = self.token.get()[0] if self.token.exists() else 0
        before, first, out = held, token, []
        requests = sorted((r for batch in rows for r in batch.to_dict("records")), key=lambda r: (r["at"], r["request_id"]))
        for r in requests:
            now = int(r["at"].timestamp() * 1000)
            if held and now >= held[2]:
                out.append((key[0], None, "expired", held[1], held[2]))
                held = None
            held, token, answer = lease_step(held, token, r | {"now": now})
            out.append((key[0], r["request_id"], answer, held[1] if held else None, now))
        if held != before:
            if before:
                self.handle.deleteTimer(before[2])
            if held:
                self.handle.registerTimer(held[2])
                self.lease.update(held)
            else:
                self.lease.clear()
        if token != first:
            self.token.update((token,))
        yield _frame(out, LEASE_LOG)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(self.lease.get()) if self.lease.exists() else None
        if held:
            self.lease.clear()
            yield _frame([(key[0], None, "expired", held[1], held[2])], LEASE_LOG)


def expiring_leases(requests: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """target, request_id, answer, token and at for a stream of requests (target, request_id, action, owner, token, at, ttl in milliseconds), and an `expired` row when a lease runs out, by its time and the watermark."""
    with_timers(requests.sparkSession)
    own = requests.select("target", "request_id", "action", "owner", "token", "at", "ttl").withWatermark("at", delay)
    return own.groupBy("target").transformWithStateInPandas(_Leases(), LEASE_LOG, "Append", "EventTime")

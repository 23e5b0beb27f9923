"""State that expires: generations, whose lease every event renews, and conversations, whose days count from their creation.

Both as a batch over a table of events and as a stream with event-time timers; on the same events they give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

GENERATION_SECONDS = 30 * 60
CONVERSATION_SECONDS = 7 * 86_400
STREAMING, COMPLETED, FAILED, CANCELLED = "STREAMING", "COMPLETED", "FAILED", "CANCELLED"
#: The status that an event of a kind ends a generation with; all other kinds are chunks.
ENDS = {"completed": COMPLETED, "failed": FAILED, "cancelled": CANCELLED}
MICRO = 1_000_000
GENERATION = "user_id long, began timestamp, status string, chunks long, ended timestamp, expires timestamp"
CONVERSATION = "user_id long, began timestamp, expires timestamp, events long"


def _moment(us: int) -> datetime:
    return datetime.fromtimestamp(us // MICRO, UTC).replace(microsecond=us % MICRO)


def generations(events: DataFrame, seconds: int = GENERATION_SECONDS) -> DataFrame:
    """user_id, began, status, chunks, ended, expires of each generation in events (user_id, ts, kind).

    The first event of a user, and the first after a lease ran out, begins a generation; every event renews its lease. The first
    event that ends it decides its status and its end; chunks count before that, and later ends change nothing. A generation
    without one stays STREAMING and ends when its lease does, at `expires`. Events of one instant are in the order chunk, then ends by kind.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    status = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in ENDS.items()))
    e = events.select("user_id", us.alias("us"), status.alias("end"), F.when(status.isNotNull(), F.col("kind")).alias("order"))
    own = Window.partitionBy("user_id").orderBy("us", F.asc_nulls_first("order"))
    new = F.coalesce(F.col("us") - F.lag("us").over(own) >= seconds * MICRO, F.lit(True))
    numbered = e.withColumn("new", new).withColumn("n", F.sum(F.col("new").cast("int")).over(own))
    whole = Window.partitionBy("user_id", "n")
    first = F.min(F.when(F.col("end").isNotNull(), F.struct("us", "order", "end"))).over(whole)
    rows = numbered.withColumn("first", first).groupBy("user_id", "n").agg(
        F.min("us").alias("began"), F.max("us").alias("last"), F.first("first").alias("first"), F.count_if(F.col("end").isNull() & (F.col("first").isNull() | (F.col("us") <= F.col("first.us")))).alias("chunks")
    )
    expires = F.timestamp_micros(F.col("last") + seconds * MICRO)
    ended = F.coalesce(F.timestamp_micros("first.us"), expires)
    return rows.select("user_id", F.timestamp_micros("began").alias("began"), F.coalesce("first.end", F.lit(STREAMING)).alias("status"), "chunks", ended.alias("ended"), expires.alias("expires"))


def _anchored(seconds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by user and time: a few steps for each conversation, none for each event. Holds one open conversation."""
        open_ = None  # user, began, events
        for b in batches:
            user, us, out = b["user_id"].to_numpy(), b["us"].to_numpy(), []
            edges = [0, *(np.flatnonzero(user[1:] != user[:-1]) + 1), len(user)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                at = a
                while at < z:
                    if open_ is not None and (open_[0] != user[a] or us[at] >= open_[1] + seconds * MICRO):
                        out.append(open_)
                        open_ = None
                    began = us[at] if open_ is None else open_[1]
                    upto = a + int(np.searchsorted(us[a:z], began + seconds * MICRO))
                    open_ = (user[a], began, upto - at + (open_[2] if open_ else 0))
                    at = upto
            yield pd.DataFrame(out, columns=["user_id", "us", "events"]).astype("int64")
        if open_ is not None:
            yield pd.DataFrame([open_], columns=["user_id", "us", "events"]).astype("int64")

    return run


def conversations(events: DataFrame, seconds: int = CONVERSATION_SECONDS) -> DataFrame:
    """user_id, began, expires, events of each current conversation in events (user_id, ts): the first event of a user creates
    one; it lasts `seconds` from then, however often it is used; the first event after that creates the next. Null users are left out."""
    rows = events.where("user_id IS NOT NULL").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    found = rows.repartition("user_id").sortWithinPartitions("user_id", "us").mapInPandas(_anchored(seconds), "user_id long, us long, events long")
    return found.select("user_id", F.timestamp_micros("us").alias("began"), F.timestamp_micros(F.col("us") + seconds * MICRO).alias("expires"), "events")


class _Expiring(StatefulProcessor):
    """State of a user: what is open. An event-time timer at its expiry brings it out; an event after that begins the next."""

    def __init__(self, seconds: int) -> None:
        self.us = seconds * MICRO

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = self.open.get() if self.open.exists() else None, []
        before = None if state is None else self.expires(state)
        batch = pd.concat(list(rows))
        for us, kind in sorted(zip(batch["us"].tolist(), [None if pd.isna(k) else k for k in batch["kind"]], strict=True), key=lambda x: (x[0], x[1] or "")):
            if state is not None and us >= self.expires(state):
                out.append(self.row(key[0], state))
                state = None
            state = self.step(state, us, ENDS.get(kind))
        if before is not None and before != self.expires(state):
            self.handle.deleteTimer(before // 1000 + 1)
        self.open.update(state)
        self.handle.registerTimer(self.expires(state) // 1000 + 1)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            state = self.open.get()
            if self.expires(state) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield pd.DataFrame([self.row(key[0], state)], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class _Generations(_Expiring):
    """began, last, chunks, and status with its time once it has ended."""

    STATE = "began long, last long, chunks long, status string, ended long"
    COLUMNS = [c.split()[0] for c in GENERATION.split(", ")]

    def expires(self, s) -> int:
        return s[1] + self.us

    def step(self, s, us: int, end: str | None) -> tuple:
        began, _, chunks, status, ended = s or (us, us, 0, None, None)
        if status is None:
            chunks, status, ended = (chunks + 1, None, None) if end is None else (chunks, end, us)
        return began, us, chunks, status, ended

    def row(self, user: int, s) -> tuple:
        return user, _moment(s[0]), s[3] or STREAMING, s[2], _moment(self.expires(s) if s[4] is None else s[4]), _moment(self.expires(s))


class _Conversations(_Expiring):
    """began and events."""

    STATE = "began long, events long"
    COLUMNS = [c.split()[0] for c in CONVERSATION.split(", ")]

    def expires(self, s) -> int:
        return s[0] + self.us

    def step(self, s, us: int, end: str | None) -> tuple:
        return (s[0], s[1] + 1) if s else (us, 1)

    def row(self, user: int, s) -> tuple:
        return user, _moment(s[0]), _moment(self.expires(s)), s[1]


def _stream(events: DataFrame, processor: _Expiring, schema: str, late: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = events.select("user_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("kind") if "kind" in events.columns else F.lit(None).cast("string").alias("kind"))
    return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(processor, schema, "append", "EventTime")


def generations_stream(events: DataFrame, seconds: int = GENERATION_SECONDS, late: str = "1 minute") -> DataFrame:
    """generations() of a stream: each comes out when the watermark passes its expiry. Events more than `late` behind are dropped."""
    return _stream(events, _Generations(seconds), GENERATION, late)


def conversations_stream(events: DataFrame, seconds: int = CONVERSATION_SECONDS, late: str = "1 minute") -> DataFrame:
    """conversations() of a stream, likewise."""
    return _stream(events, _Conversations(seconds), CONVERSATION, late)

"""Anchored request limits over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.usage import anchored_limit


def anchored_windows_stream(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """event_id, user_id and accepted for a stream of (event_id, user_id, ts): same rule as the batch operator.

    State of a user: begin and count of the open window. Rows of one micro-batch are decided in the order of event_id;
    order across micro-batches is that of arrival.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("event_id")  # one user's events of one micro-batch
        verdicts = []
        for at in rows["at"]:
            held, ok = anchored_limit(held, at, most, seconds)
            verdicts.append(ok)
        state.update((float(held[0]), int(held[1])))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "accepted": verdicts})

    timed = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(decide, "event_id long, user_id long, accepted boolean", "began double, n long", "append", GroupStateTimeout.NoTimeout)


def generation_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, began, ended and events of sessions that end after a gap; `late` sets a watermark for streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    s = timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "events")


def usage_by_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Aligned tumbling minutes, for dashboards: not the anchored rule."""
    w = F.window(F.col("ts"), "1 minute")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("requests"), F.sum("value").alias("amount")).select("user_id", F.col("w.start").alias("minute"), "requests", "amount")

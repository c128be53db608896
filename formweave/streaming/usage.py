"""Usage events as streams.

Event rows as in operators/telemetry.py plus ts (event time).  Late data is
bounded by a watermark.  Sessions, daily counts and session ids go by event
time: they give what the batch operator gives in whatever order rows arrive
within the lateness.  Firsts and caps go by arrival: they give what the batch
operator gives if rows arrive in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from formweave import schemas
from formweave.operators import telemetry as T
from formweave.rules import telemetry as rules

LATENESS = "10 minutes"


def read_events(spark: SparkSession, folder: str, format: str = "json", schema: str = schemas.USAGE_EVENTS) -> DataFrame:
    raw = spark.readStream.schema(schema).format(format).load(folder)
    return raw.withColumn("ts", F.timestamp_micros("ts_us"))


def sanitized(stream: DataFrame, schema: dict[str, list[str]] | None = None) -> DataFrame:
    return T.sanitize(stream, schema)


def opted_in(stream: DataFrame, toggles: DataFrame) -> DataFrame:
    """Join with the static table of switch changes."""
    return T.drop_opted_out_stream(stream, toggles)


def sessions(stream: DataFrame, lateness: str = LATENESS, gap_minutes: int = rules.SESSION_GAP_MINUTES) -> DataFrame:
    """Closed sessions: client_id, session_start, session_end, events."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy("client_id", F.session_window("ts", f"{gap_minutes} minutes"))
        .agg(F.min("ts_us").alias("session_start"), F.max("ts_us").alias("session_end"), F.count("*").alias("events"))
        .drop("session_window")
    )


def first_events(stream: DataFrame) -> DataFrame:
    """The first arrival per client and event; kept for ever, as a milestone must be."""
    return stream.dropDuplicates(["client_id", "event"])


def parse_requests(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One request per job id; repeats arrive within the watermark delay."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["job_id"])


def daily_activity(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events per client and UTC day, for the daily heartbeat."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "client_id")
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("day"), "client_id", "events")
    )


def capped_errors(
    stream: DataFrame, lateness: str = LATENESS, limit: int = rules.MAX_ERRORS_PER_CONTEXT_PER_DAY
) -> DataFrame:
    """The first `limit` errors per client, context and UTC day, in arrival order of micro-batches.

    The state of a day is one counter, dropped once the watermark has left
    the day.  A key's rows come in Arrow batches, so a hot key is read in
    pieces and only up to `limit` rows are ever kept.
    """
    names = ["client_id", "context", "event_id", "ts_us"]
    kinds = dict(stream.dtypes)
    output = ", ".join(f"{n} {kinds[n]}" for n in names)
    day_us = T.US_PER_DAY

    def cap(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        kept = None
        for frame in frames:
            rows = frame[names] if kept is None else pd.concat([kept, frame[names]])
            kept = rows.sort_values(["ts_us", "event_id"]).head(max(limit - seen, 0))
        total = seen + (0 if kept is None else len(kept))
        state.update((total,))
        state.setTimeoutTimestamp(max((int(key[2]) + 1) * day_us // 1000, state.getCurrentWatermarkMs() + 1))
        if kept is not None and len(kept):
            yield kept

    return (
        stream.withColumn("day", T.utc_day(F.col("ts_us")))
        .withWatermark("ts", lateness)
        .groupBy("client_id", "context", "day")
        .applyInPandasWithState(cap, output, "n int", "append", GroupStateTimeout.EventTimeTimeout)
    )


class _Sessions(StatefulProcessor):
    """Of one client: rows that wait for the watermark, and the session that may still go on."""

    def __init__(self, gap_us: int, waiting: str, columns: list[str]):
        self.gap_us, self.schema, self.columns = gap_us, waiting, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.open = handle.getValueState("open", "last long, start long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:
            taken = [(k, int(t)) for k, t in zip(frame["event_id"], frame["ts_us"], strict=True)]
            self.waiting.appendList(taken)
            least = min(t for _, t in taken)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((t, k) for k, t in rows if t < passed)
        last, start = self.open.get() if self.open.exists() else (None, None)
        found = []
        for t, k in ready:
            if last is None or t - last > self.gap_us:
                start = t
            last = t
            found.append((key[0], k, str(start // 1000)))
        later = [(k, t) for k, t in rows if t >= passed]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(max(min(t for _, t in later) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.waiting.clear()
        if later or last is not None and passed <= last + self.gap_us:
            if last is not None:
                self.open.update((last, start))
                # what comes after the gap begins anew, so nothing need be known of the session then
                self.handle.registerTimer((last + self.gap_us) // 1000 + 2)
        else:
            self.open.clear()
        if found:
            yield pd.DataFrame(found, columns=self.columns)

    def close(self) -> None:
        pass


def event_sessions(stream: DataFrame, lateness: str = LATENESS, gap_minutes: int = rules.SESSION_GAP_MINUTES) -> DataFrame:
    """client_id, event_id, session_id, given out when the watermark has passed an event.

    Rows wait in their client's list state until then and are taken in order
    of event time, so the result is that of the batch operator in whatever
    order rows arrive within `lateness`; rows that come later than that are
    dropped.  A client's state ends a gap after its last event.  Needs a
    state store with lists and timers (RocksDB; session.SETTINGS names it).
    """
    kinds = dict(stream.dtypes)
    names = ["client_id", "event_id", "session_id"]
    output = f"client_id {kinds['client_id']}, event_id {kinds['event_id']}, session_id string"
    processor = _Sessions(gap_minutes * T.US_PER_MINUTE, f"event_id {kinds['event_id']}, ts_us long", names)
    return (
        stream.select("client_id", "event_id", "ts_us", "ts").withWatermark("ts", lateness).groupBy("client_id")
        .transformWithStateInPandas(processor, output, "Append", "EventTime")
    )


def write_payloads(stream: DataFrame, folder: str, checkpoint: str, user_properties: dict[str, str]):
    """Start writing collection records of a sanitised stream with session ids, as text files."""
    records = T.collection_payload(stream, user_properties).select(F.col("payload").alias("value"))
    return records.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint)

"""Streaming sessions and funnel state.

Funnel state is order-free, so it stays a native streaming aggregation: the batch operator itself, in update
mode. Only what depends on order (anchored sessions, progressions and abandonment) is a keyed processor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmark.operators.state import USER, funnel_user_state
from trailmark.params import FUNNEL, SCOPE

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VISITOR = [*SCOPE, "anonymous_id"]
TIMEOUT_US = 30 * 60 * 1_000_000
DAY_US = 86_400_000_000


def use_state_store(spark) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def state_stream(matched: DataFrame) -> DataFrame:
    """Funnel state per user, updated as matched events arrive (update mode)."""
    return funnel_user_state(matched)


def gap_sessions(events: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """Sessions by idle gap, closed by the watermark (append mode)."""
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(*VISITOR, F.session_window("timestamp", "30 minutes").alias("w"))
        .agg(F.count("*").alias("events"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"))
        .select(*VISITOR, "started_at", "ended_at", "events"))


def live_counts(progressions: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """Entries and conversions per funnel and minute (append mode)."""
    return (
        progressions.withWatermark("timestamp", lateness)
        .groupBy(*FUNNEL, F.window("timestamp", "1 minute").alias("w"))
        .agg(F.count_if("is_entry").alias("entries"), F.count_if("is_conversion").alias("conversions"))
        .select(*FUNNEL, F.col("w.start").alias("minute"), "entries", "conversions"))


def trailing_counts(progressions: DataFrame, span: str = "1 hour", slide: str = "1 minute",
                    lateness: str = "5 minutes") -> DataFrame:
    """The same over a trailing span that moves every minute."""
    return (
        progressions.withWatermark("timestamp", lateness)
        .groupBy(*FUNNEL, F.window("timestamp", span, slide).alias("w"))
        .agg(F.count_if("is_entry").alias("entries"), F.count_if("is_conversion").alias("conversions"))
        .select(*FUNNEL, F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "entries", "conversions"))


# ------------------------------------------------------------ keyed processors
class AnchoredSessions(StatefulProcessor):
    """Holds a visitor's events until the watermark passes them, then anchors sessions in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "us long")
        self.waiting = handle.getListState("waiting", "id long, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(int(i), int(u)) for i, u in zip(frame["id"], frame["us"])])
            for at in {int(u) // 1000 + 1 for u in frame["us"]}:
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs() * 1000
        pending = sorted(self.waiting.get(), key=lambda r: (r[1], r[0]))
        ready = [r for r in pending if r[1] <= limit]
        if not ready:
            return
        rest = [r for r in pending if r[1] > limit]
        self.waiting.put(rest) if rest else self.waiting.clear()
        start = self.start.get()[0] if self.start.exists() else None
        out = []
        for row_id, us in ready:
            if start is None or us - start > TIMEOUT_US:
                start = us
            out.append((*key, row_id, us, start))
        self.start.update((start,))
        yield pd.DataFrame(out, columns=[*VISITOR, "id", "us", "start_us"])

    def close(self) -> None:
        pass


def anchored_sessions(events: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """Every event with its anchored session start (append mode); late rows are put in order first."""
    rows = events.withWatermark("timestamp", lateness).withColumn("us", F.unix_micros("timestamp"))
    out = rows.groupBy(*VISITOR).transformWithStateInPandas(
        statefulProcessor=AnchoredSessions(),
        outputStructType="tenant_id long, workspace_id long, anonymous_id string, id long, us long, start_us long",
        outputMode="Append", timeMode="EventTime")
    return out.select(*VISITOR, "id", F.timestamp_micros("us").alias("timestamp"),
                      F.timestamp_micros("start_us").alias("session_start"))


class FunnelProgress(StatefulProcessor):
    """A user's position in a funnel: emits entries, new steps, advances, conversions and abandonment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "state", "steps string, furthest int, last_us long, window_days int, converted boolean, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["us", "id"])
        if self.state.exists():
            text, furthest, last, days, converted, timer = self.state.get()
            steps = set(text.split(","))
        else:
            steps, furthest, last, days, converted, timer = set(), -1, 0, None, False, None
        out = []
        for row in frame.itertuples(index=False):
            step, is_conversion = int(row.step_order), row.step_type == "conversion"
            entry = not steps
            if str(step) not in steps:
                out.append((*key, step, int(row.us), entry, step > furthest, is_conversion and not converted, False))
                steps.add(str(step))
            furthest, converted = max(furthest, step), converted or is_conversion
            last = max(last, int(row.us))
            days = None if pd.isna(row.window_days) else int(row.window_days)
        if timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        if days is not None and not converted:
            timer = (last + days * DAY_US) // 1000 + 1
            self.handle.registerTimer(timer)
        self.state.update((",".join(sorted(steps)), furthest, last, days, converted, timer))
        if out:
            yield pd.DataFrame(out, columns=PROGRESS_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            text, furthest, last, days, converted, _ = self.state.get()
            self.state.update((text, furthest, last, days, converted, None))
            yield pd.DataFrame([(*key, furthest, last, False, False, False, True)], columns=PROGRESS_COLUMNS)

    def close(self) -> None:
        pass


PROGRESS_COLUMNS = [*USER, "step_order", "us", "is_entry", "is_advance", "is_conversion", "is_abandoned"]


def progression_stream(matched: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """Significant changes of each user as they happen, and abandonment by event time (append mode)."""
    rows = matched.withWatermark("timestamp", lateness).withColumn("us", F.unix_micros("timestamp"))
    out = rows.groupBy(*USER).transformWithStateInPandas(
        statefulProcessor=FunnelProgress(),
        outputStructType="tenant_id long, workspace_id long, funnel_id long, anonymous_id string, step_order int, us long, "
                         "is_entry boolean, is_advance boolean, is_conversion boolean, is_abandoned boolean",
        outputMode="Append", timeMode="EventTime")
    return out.withColumn("timestamp", F.timestamp_micros("us")).drop("us")

"""Sessions for events whose client gave none."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.blocks import block_of, carry_forward, number_rows
from trailmark.params import SCOPE
from trailmark.session import checkpoint_dir

VISITOR = [*SCOPE, "anonymous_id"]
TIMEOUT = 30 * 60 * 1_000_000
# Visitors with more events than this take the distributed way; the rest fit one short array each.
FOLD_LIMIT = 1000


def sessionize(events: DataFrame, mode: str = "anchored", fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Adds `session_start` and completes `session_id`; a session_id from the client is kept.

    `anchored`: a session lasts 30 minutes from its first event; the first event after that opens the next.
    `gap`: a session ends after 30 minutes without an event.
    """
    open_events = events.where(F.col("session_id").isNull())
    if mode == "anchored":
        found = anchored_starts(open_events, fold_limit)
    elif mode == "gap":
        found = gap_starts(open_events)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    made = F.concat(F.lit("s_"), F.col("anonymous_id"), F.lit("_"), F.unix_micros("session_start").cast("string"))
    given = events.where(F.col("session_id").isNotNull()).withColumn("session_start", F.lit(None).cast("timestamp"))
    return found.withColumn("session_id", made).unionByName(given)


def sessions_of(sessionized: DataFrame) -> DataFrame:
    """One row per session with its span and events."""
    return sessionized.groupBy(*VISITOR, "session_id").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").alias("events"))


def gap_starts(events: DataFrame) -> DataFrame:
    """Session starts by idle gap, hour by hour of each visitor."""
    numbered = number_rows(events, VISITOR)
    opens = F.col("previous_at").isNull() | (F.unix_micros("timestamp") - F.unix_micros("previous_at") >= TIMEOUT)
    marked = numbered.withColumn("_opened", F.when(opens, F.col("timestamp"))).drop("position", "previous_at")
    return carry_forward(marked, VISITOR, "_opened", "session_start", last=F.max("_opened")).drop("_opened")


def anchored_starts(events: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Session starts by first event; the few visitors over `fold_limit` are looked for first.

    That look is one aggregation. Without such visitors the plan is a single shuffle.
    """
    busy = events.groupBy(*VISITOR).agg(F.count("*").alias("_n")).where(F.col("_n") > fold_limit).select(*VISITOR)
    if busy.isEmpty():
        return _folded(events)
    rest = events.join(busy, VISITOR, "left_anti")
    return _folded(rest).unionByName(_chained(events.join(busy, VISITOR, "left_semi")))


def _folded(events: DataFrame) -> DataFrame:
    """One array of at most `fold_limit` rows per visitor, folded into session starts in the JVM."""
    rows = events.groupBy(*VISITOR).agg(
        F.collect_list(F.struct(*[c for c in events.columns if c not in VISITOR])).alias("_rows"))
    times = F.array_sort(F.transform("_rows", lambda r: F.unix_micros(r["timestamp"])))
    none = F.array().cast("array<bigint>")

    def step(starts: Column, at: Column) -> Column:
        fits = (F.size(starts) > 0) & (at - F.try_element_at(starts, F.lit(-1)) <= TIMEOUT)
        return F.when(fits, starts).otherwise(F.concat(starts, F.array(at)))

    starts = rows.withColumn("_starts", F.aggregate(times, none, step))
    exploded = starts.select(*VISITOR, "_starts", F.explode("_rows").alias("_r"))
    at = F.unix_micros("_r.timestamp")
    own = F.array_max(F.filter("_starts", lambda s: s <= at))
    return exploded.select(*VISITOR, "_r.*", F.timestamp_micros(own).alias("session_start")).select(
        *events.columns, "session_start")


def _chained(events: DataFrame) -> DataFrame:
    """The same for visitors too busy for one array.

    Gaps over the timeout always open a session, so they cut a visitor into stretches. Inside a stretch every
    event points to the first one more than 30 minutes later; the session starts are what the stretch's first
    event reaches, found by doubling the pointers with equi-joins on (visitor, time).
    """
    spark = events.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    stretches = stretches_of(events)
    points = stretches.select(*VISITOR, F.col("_stretch"), F.unix_micros("timestamp").alias("us")).distinct()
    span = points.groupBy(*VISITOR, "_stretch").agg((F.max("us") - F.min("us")).alias("span"))
    longest = span.agg(F.max("span")).first()[0] or 0
    rounds = max(1, math.ceil(math.log2(longest / TIMEOUT + 2)))
    links = _first_after_timeout(points.select(*VISITOR, "us")).checkpoint()
    reached = points.where(F.unix_micros("_stretch") == F.col("us")).select(*VISITOR, "us")
    for _ in range(rounds):
        hop = reached.join(links, [*VISITOR, "us"]).where("target is not null").select(
            *VISITOR, F.col("target").alias("us"))
        reached = reached.unionByName(hop).distinct().checkpoint()
        onward = links.select(*VISITOR, F.col("us").alias("target"), F.col("target").alias("_next"))
        links = links.join(onward, [*VISITOR, "target"]).select(*VISITOR, "us", F.col("_next").alias("target")).checkpoint()
    starts = reached.select(*VISITOR, F.timestamp_micros("us").alias("timestamp"), F.lit(True).alias("_opens"))
    marked = events.join(starts, [*VISITOR, "timestamp"], "left").withColumn(
        "_opened", F.when(F.col("_opens"), F.col("timestamp"))).drop("_opens")
    return carry_forward(marked, VISITOR, "_opened", "session_start", last=F.max("_opened")).drop("_opened").select(
        *events.columns, "session_start")


def stretches_of(events: DataFrame) -> DataFrame:
    """Events with `_stretch`, the start of their stretch: cut where the gap exceeds the timeout."""
    numbered = number_rows(events, VISITOR)
    opens = F.col("previous_at").isNull() | (F.unix_micros("timestamp") - F.unix_micros("previous_at") > TIMEOUT)
    marked = numbered.withColumn("_opened", F.when(opens, F.col("timestamp")))
    return carry_forward(marked, VISITOR, "_opened", "_stretch", last=F.max("_opened")).drop("_opened", "position", "previous_at")


def _first_after_timeout(points: DataFrame) -> DataFrame:
    """(visitor, us, target): the first time more than the timeout after us.

    A target further than the hour after the probe's lies in another stretch, so the first time of each hour is
    copied to the hour before and every (visitor, hour) is searched by itself.
    """
    first = points.groupBy(*VISITOR, block_of(F.col("us")).alias("block")).agg(F.min("us").alias("us"))
    hit = lambda df: df.select(*VISITOR, "block", F.col("us").alias("probe"), "us", F.col("us").alias("hit"))
    probe = F.col("us") + TIMEOUT
    rows = (
        points.select(*VISITOR, block_of(probe).alias("block"), probe.alias("probe"), "us",
                      F.lit(None).cast("bigint").alias("hit"))
        .unionByName(hit(points.withColumn("block", block_of(F.col("us")))))
        .unionByName(hit(first.withColumn("block", F.col("block") - 1)))
    )
    later = Window.partitionBy(*VISITOR, "block").orderBy(-F.col("probe")).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("target", F.min("hit").over(later)).where("hit is null").select(*VISITOR, "us", "target")

"""Rollup tables callers read by name; rebuilt by a batch job and written partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import round_half_up
from trailmark.params import FUNNEL, SCOPE, timestamp

DAILY_DAYS = 90
PATH_DAYS = 30


def days_before(as_of: str, days: int) -> Column:
    return F.date_trunc("day", timestamp(as_of)) - F.expr(f"interval {days} days")


def _exited() -> Column:
    return F.col("exited_at").isNotNull() | (F.col("status") == "exited")


def daily_step_completions(state: DataFrame, as_of: str) -> DataFrame:
    """Users, completions, exits and mean conversion seconds by funnel, step and day of last activity.

    A user has exited who gave up (see `state.abandon_users`) or left."""
    return state.where(F.col("last_activity_at") >= days_before(as_of, DAILY_DAYS)).groupBy(
        *FUNNEL, "current_step_index", F.to_date("last_activity_at").alias("activity_date")).agg(
        F.count("*").alias("users_at_step"), F.count_if(F.col("status") == "completed").alias("completions"),
        F.count_if(_exited()).alias("exits"),
        F.avg("conversion_time_seconds").alias("avg_conversion_time"))


def conversion_summary(funnels: DataFrame, state: DataFrame) -> DataFrame:
    """Lifetime totals of every live funnel, also of those nobody entered."""
    status = lambda name: F.count_if(F.col("status") == name)
    facts = state.groupBy(*FUNNEL).agg(
        F.count("*").alias("total_users"), status("completed").alias("conversions"),
        F.count_if(_exited()).alias("exits"), status("abandoned").alias("abandoned"),
        F.avg(F.when(F.col("status") == "completed", F.col("conversion_time_seconds"))).alias("avg_conversion_time"),
        F.min("entered_at").alias("first_entry"), F.max("last_activity_at").alias("last_activity"))
    live = funnels.where(F.col("archived_at").isNull()).select(*SCOPE, F.col("id").alias("funnel_id"),
                                                              F.col("name").alias("funnel_name"))
    zero = F.lit(0).cast("bigint")
    counts = ("total_users", "conversions", "exits", "abandoned")
    return live.join(facts, FUNNEL, "left").select(
        *FUNNEL, "funnel_name", *[F.coalesce(c, zero).alias(c) for c in counts],
        F.when(F.col("total_users") > 0, round_half_up(F.col("conversions") / F.col("total_users") * 100))
        .alias("conversion_rate"),
        "avg_conversion_time", "first_entry", "last_activity")


def progression_paths(state: DataFrame, as_of: str) -> DataFrame:
    """Per-user state of the last 30 days with the number of steps completed."""
    step = F.col("current_step_index")
    return state.where(F.col("entered_at") >= days_before(as_of, PATH_DAYS)).select(
        *FUNNEL, "anonymous_id", "lead_id", "current_step_index", "exit_step_index", "status", "entered_at", "completed_at",
        "conversion_time_seconds", F.when(step > 0, step).otherwise(0).cast("bigint").alias("steps_completed"))


def write_daily(rollup: DataFrame, path: str) -> None:
    """One folder per day; a day's rows are few, so one file each."""
    rollup.repartition("activity_date").write.mode("overwrite").partitionBy("activity_date").parquet(path)

"""Per-user funnel state as a closed form, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import seconds_between
from trailmark.params import FUNNEL, SCOPE, timestamp
from trailmark.operators.matching import FUNNEL_COLUMNS
from trailmark.sources.definitions import Definitions

USER = [*FUNNEL, "anonymous_id"]


def funnel_user_state(matched: DataFrame) -> DataFrame:
    """Fold of the matched events of each (funnel, visitor).

    Entry and activity are the first and last matched event, the position is the furthest step, and the
    completion time moves with every later matched event once a conversion step was matched. All are
    order-free aggregates that combine before the shuffle, so late rows and hot visitors are no problem. The lead is that of
    the latest matched event that has one.
    """
    completed = F.bool_or(F.col("step_type") == "conversion")
    last = F.max("timestamp")
    # a struct to order by makes Spark sort the rows of a task, so it is there only with leads
    lead = (F.max_by("lead_id", F.when(F.col("lead_id").isNotNull(), F.struct("timestamp", "id")))
            if "lead_id" in matched.columns else F.max(F.lit(None).cast("bigint")))
    state = matched.groupBy(*SCOPE, *FUNNEL_COLUMNS, "anonymous_id").agg(
        F.min("timestamp").alias("entered_at"),
        last.alias("last_activity_at"),
        F.max("step_order").alias("current_step_index"),
        F.when(completed, last).alias("completed_at"),
        lead.alias("lead_id"),
    )
    done = F.col("completed_at").isNotNull()
    return state.select(
        *SCOPE, *FUNNEL_COLUMNS, "anonymous_id", "lead_id", "current_step_index", "entered_at", "last_activity_at",
        "completed_at",
        F.lit(None).cast("timestamp").alias("exited_at"),
        F.lit(None).cast("int").alias("exit_step_index"),
        F.when(done, seconds_between(F.col("completed_at"), F.col("entered_at"))).alias("conversion_time_seconds"),
        F.when(done, "completed").otherwise("active").alias("status"),
    )


def state_as_of(matched: DataFrame, now: str) -> DataFrame:
    """The state that was known at an instant: later events do not count yet."""
    return funnel_user_state(matched.where(F.col("timestamp") <= timestamp(now)))


def reached_all_steps() -> Column:
    """At the last step and completed."""
    return (F.col("current_step_index") + 1 == F.col("total_steps")) & F.col("completed_at").isNotNull()


def abandon_users(state: DataFrame, as_of: str) -> DataFrame:
    """Active users idle for longer than the funnel's window become abandoned at their last activity."""
    idle = seconds_between(timestamp(as_of), F.col("last_activity_at")) > F.col("window_days") * 86400
    gone = (F.col("status") == "active") & F.coalesce(idle, F.lit(False))
    return state.withColumns({
        "exited_at": F.when(gone, F.col("last_activity_at")).otherwise(F.col("exited_at")),
        "exit_step_index": F.when(gone, F.col("current_step_index")).otherwise(F.col("exit_step_index")),
        "status": F.when(gone, "abandoned").otherwise(F.col("status")),
    })


def progression_events(matched: DataFrame) -> DataFrame:
    """Significant changes only: the first time each user reaches each step.

    `is_entry` marks the first matched event, `is_advance` a step further than any earlier one, and
    `is_conversion` the first conversion step. Rows per user are bounded by the funnel's steps.
    """
    firsts = matched.groupBy(*USER, "step_order", "step_type").agg(
        F.min(F.struct("timestamp", "id")).alias("_first"))
    by_time = Window.partitionBy(*USER).orderBy("_first")
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    return firsts.select(
        *USER, "step_order", F.col("_first.timestamp").alias("timestamp"),
        (F.row_number().over(by_time) == 1).alias("is_entry"),
        F.coalesce(F.col("step_order") > F.max("step_order").over(earlier), F.lit(True)).alias("is_advance"),
        ((F.col("step_type") == "conversion")
         & (F.count_if(F.col("step_type") == "conversion").over(earlier) == 0)).alias("is_conversion"),
    )


def strict_funnel(matched: DataFrame, definitions: Definitions) -> DataFrame:
    """Ordered funnels: each step after the one before it, all within the window that the entry opens.

    The entry is the user's first event on step 0; step k is reached at the earliest event on step k after
    step k-1 was reached. One join and one aggregation per step of the longest funnel, on the same keys.
    """
    keep = ["window_days", "total_steps"]
    times = matched.select(*USER, *keep, "step_order", "timestamp")
    reached = (
        times.where("step_order = 0").groupBy(*USER, *keep).agg(F.min("timestamp").alias("entered_at"))
        .withColumns({"reached_at": F.col("entered_at"), "step_reached": F.lit(0)})
    )
    last = definitions.steps_of_latest().agg(F.max("order_index")).first()[0] or 0
    for step in range(1, last + 1):
        at = times.where(F.col("step_order") == step).select(*USER, F.col("timestamp").alias("_at"))
        deadline = F.col("entered_at") + F.make_dt_interval(days=F.col("window_days"))
        fits = (F.col("step_reached") == step - 1) & (F.col("_at") > F.col("reached_at")) & (F.col("_at") <= deadline)
        reached = reached.join(at, USER, "left").groupBy(*USER, *keep, "entered_at", "reached_at", "step_reached").agg(
            F.min(F.when(fits, F.col("_at"))).alias("_next")).withColumns({
                "step_reached": F.when(F.col("_next").isNotNull(), F.lit(step)).otherwise(F.col("step_reached")),
                "reached_at": F.coalesce("_next", "reached_at")}).drop("_next")
    return reached.withColumn("completed", F.col("step_reached") + 1 == F.col("total_steps"))

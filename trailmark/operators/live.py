"""Live funnel metrics, alerts and user progression as of an explicit instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import mean_seconds, rate, round_half_up, seconds_between
from trailmark.operators.blocks import number_rows
from trailmark.operators.conversion import zero
from trailmark.params import FUNNEL, SCOPE, timestamp

# Windows and thresholds of the live view.
ACTIVE_MINUTES, RECENT_HOURS, HISTORY_HOURS = 30, 1, 24
STUCK_MINUTES, STUCK_USERS, STUCK_HIGH = 10, 5, 20
DROP_ALERT, DROP_CRITICAL = -20.0, -50.0
# Abandonment risk points (hours above, points) and early-step points (step at most, points).
AGE_RISK, IDLE_RISK, STEP_RISK = [(24.0, 30), (4.0, 15)], [(6.0, 40), (1.0, 20)], [(1, 20), (2, 10)]
# Time against the mean -> percentile.
PERCENTILE_BANDS = [(0.5, 10), (0.8, 25), (1.2, 50), (1.8, 75)]


def _ago(now: str, amount: int, unit: str) -> Column:
    return timestamp(now) - F.expr(f"interval {amount} {unit}")


def _active(now: str) -> Column:
    return (F.col("status") == "active") & _since("last_activity_at", now, ACTIVE_MINUTES, "minutes")


def _since(column: str, now: str, amount: int, unit: str) -> Column:
    """From so long ago up to the instant: what came after it is not known yet."""
    return F.col(column).between(_ago(now, amount, unit), timestamp(now))


def _funnels(steps: DataFrame) -> DataFrame:
    return steps.select(*FUNNEL).distinct()


def live_basic(state: DataFrame, steps: DataFrame, now: str) -> DataFrame:
    """Active users, entries and conversions of the last hour and their rate; zeros for quiet funnels.

    Every condition implies recent activity, so that predicate prunes state first.
    """
    hour = _ago(now, RECENT_HOURS, "hours")
    recent = state.where(F.col("last_activity_at") >= hour).groupBy(*FUNNEL).agg(
        F.count_if(_active(now)).alias("active_users"),
        F.count_if(_since("entered_at", now, RECENT_HOURS, "hours")).alias("entries"),
        F.count_if((F.col("status") == "completed") & _since("completed_at", now, RECENT_HOURS, "hours")).alias("conversions"))
    count = lambda c: F.coalesce(c, zero())
    return _funnels(steps).join(recent, FUNNEL, "left").select(
        *FUNNEL, count("active_users").alias("active_users"), count("entries").alias("entries_last_hour"),
        count("conversions").alias("conversions_last_hour"),
        rate(count("conversions"), count("entries")).alias("current_conversion_rate"))


def live_steps(state: DataFrame, now: str) -> DataFrame:
    """Active users per step with their share."""
    counts = state.where(_active(now)).groupBy(*FUNNEL, F.col("current_step_index").cast("bigint").alias("step_order")).agg(
        F.count("*").alias("current_users"))
    total = F.sum("current_users").over(Window.partitionBy(*FUNNEL))
    return counts.withColumn("percentage", round_half_up(F.col("current_users") * 100.0 / total))


def live_trend(state: DataFrame, steps: DataFrame, now: str) -> DataFrame:
    """Entries, conversions and rate per minute of the last half hour, without gaps."""
    since = _ago(now, ACTIVE_MINUTES, "minutes")
    per_minute = lambda column, name: state.where(_since(column, now, ACTIVE_MINUTES, "minutes")).groupBy(
        *FUNNEL, F.date_trunc("minute", F.col(column)).alias("minute")).agg(F.count("*").alias(name))
    minutes = F.sequence(F.date_trunc("minute", since), F.date_trunc("minute", timestamp(now)), F.expr("interval 1 minute"))
    spine = _funnels(steps).withColumn("minute", F.explode(minutes))
    keys = [*FUNNEL, "minute"]
    rows = spine.join(per_minute("entered_at", "entries"), keys, "left").join(
        per_minute("completed_at", "conversions"), keys, "left")
    entries, conversions = F.coalesce("entries", zero()), F.coalesce("conversions", zero())
    return rows.select(*keys, entries.alias("entries"), conversions.alias("conversions"),
                       rate(conversions, entries).alias("conversion_rate"))


def rate_anomaly(state: DataFrame, now: str) -> DataFrame:
    """Rate of users who entered in the last hour against the 23 hours before."""
    hour, day = _ago(now, RECENT_HOURS, "hours"), _ago(now, HISTORY_HOURS, "hours")
    fresh, done = F.col("entered_at") >= hour, F.col("status") == "completed"
    facts = state.where(F.col("entered_at").between(day, timestamp(now))).groupBy(*FUNNEL).agg(
        F.count_if(fresh).alias("current_entries"), F.count_if(~fresh).alias("historical_entries"),
        F.count_if(fresh & done).alias("c"), F.count_if(~fresh & done).alias("h"))
    facts = facts.withColumns({"current_rate": rate(F.col("c"), F.col("current_entries")),
                               "historical_rate": rate(F.col("h"), F.col("historical_entries"))})
    change = F.when(F.col("historical_rate") > 0, round_half_up(
        (F.col("current_rate") - F.col("historical_rate")) / F.col("historical_rate") * 100)).otherwise(F.lit(0.0))
    return facts.select(*FUNNEL, "current_rate", "historical_rate", change.alias("rate_change_pct"),
                        "current_entries", "historical_entries")


def stuck_users(state: DataFrame, now: str) -> DataFrame:
    """Steps where at least five active users have been idle for more than ten minutes."""
    idle = (F.col("status") == "active") & (F.col("last_activity_at") < _ago(now, STUCK_MINUTES, "minutes"))
    return state.where(idle).groupBy(*FUNNEL, F.col("current_step_index").cast("bigint").alias("step_order")).agg(
        F.count("*").alias("users_stuck"), mean_seconds(timestamp(now), F.col("last_activity_at")).alias("avg_idle_seconds"),
        F.max(seconds_between(timestamp(now), F.col("last_activity_at"))).alias("max_idle_seconds"),
    ).where(F.col("users_stuck") >= STUCK_USERS)


def live_alerts(anomaly: DataFrame, stuck: DataFrame) -> DataFrame:
    """Alerts for falling rates and for steps with stuck users."""
    change = F.col("rate_change_pct")
    drops = anomaly.where(change < DROP_ALERT).select(
        *FUNNEL, F.lit("conversion_drop").alias("type"), F.lit(None).cast("bigint").alias("step_order"),
        F.when(change < DROP_CRITICAL, "critical").otherwise("high").alias("severity"),
        (F.col("historical_rate") * 0.8).alias("threshold"), F.col("current_rate").alias("current_value"),
        change.alias("change_pct"))
    jams = stuck.select(
        *FUNNEL, F.lit("bottleneck").alias("type"), "step_order",
        F.when(F.col("users_stuck") > STUCK_HIGH, "high").otherwise("medium").alias("severity"),
        F.lit(float(STUCK_USERS)).alias("threshold"), F.col("users_stuck").cast("double").alias("current_value"),
        F.lit(None).cast("double").alias("change_pct"))
    return drops.unionByName(jams)


# ---------------------------------------------------------------- progression
def user_progression(state: DataFrame, now: str) -> DataFrame:
    """Every user's time in the funnel, speed, time to convert and risk of abandoning."""
    def points(value: Column, bands: list[tuple[float, int]]) -> Column:
        (high, most), (low, some) = bands
        return F.when(value > high, most).when(value > low, some).otherwise(0)

    spent = F.floor(seconds_between(timestamp(now), F.col("entered_at")))
    idle = seconds_between(timestamp(now), F.col("last_activity_at")) / 3600
    step, hours = F.col("current_step_index"), spent / F.lit(3600.0)
    (first, most), (second, some) = STEP_RISK
    risk = points(hours, AGE_RISK) + points(idle, IDLE_RISK) + F.when(step <= first, most).when(
        step <= second, some).otherwise(0)
    return state.select(
        *FUNNEL, "anonymous_id", step.cast("bigint").alias("current_step"),
        F.col("entered_at").alias("entry_time"), F.col("last_activity_at").alias("last_activity"),
        F.when(F.col("status") == "completed", "converted").when(F.col("status") == "abandoned", "abandoned")
        .otherwise("in_progress").alias("conversion_status"),
        spent.alias("time_in_funnel"),
        F.when(hours > 0, round_half_up(step / hours)).otherwise(F.lit(0.0)).alias("steps_per_hour"),
        F.when(F.col("status") == "completed", F.floor(seconds_between(F.col("completed_at"), F.col("entered_at"))))
        .alias("time_to_conversion"),
        F.least(F.lit(100), risk).cast("bigint").alias("abandonment_risk"))


def progression_timing(state: DataFrame, beyond: bool = False) -> DataFrame:
    """Every user against the mean time of users at each step up to their own; with `beyond` also at the steps that others
    stand on and the user has not reached, without a time of the user's."""
    means = state.groupBy(*FUNNEL, F.col("current_step_index").alias("step_order")).agg(
        mean_seconds(F.col("last_activity_at"), F.col("entered_at")).alias("avg_seconds"))
    spent = F.floor(seconds_between(F.col("last_activity_at"), F.col("entered_at")))
    users = state.select(
        *FUNNEL, "anonymous_id", spent.alias("spent"),
        F.explode(F.sequence(F.lit(0), F.col("current_step_index"))).alias("step_order"))
    rows = users.join(means, [*FUNNEL, "step_order"])
    if beyond:
        own = state.select(*FUNNEL, "anonymous_id", "current_step_index", spent.alias("_spent"))
        rows = own.join(means, FUNNEL).withColumn("spent", F.when(F.col("step_order") <= F.col("current_step_index"), F.col("_spent")))
    ratio = F.try_divide(F.col("spent"), F.col("avg_seconds"))
    rank = None
    for bound, percentile in PERCENTILE_BANDS:
        rank = F.when(ratio <= bound, percentile) if rank is None else rank.when(ratio <= bound, percentile)
    moved = F.col("spent") > 0
    return rows.select(
        *FUNNEL, "anonymous_id", F.col("step_order").cast("bigint").alias("step_order"), "avg_seconds",
        F.col("spent").alias("user_seconds"),
        F.when(moved & (F.col("spent") < F.col("avg_seconds") * 0.8), "faster")
        .when(moved & (F.col("spent") > F.col("avg_seconds") * 1.2), "slower").otherwise("average").alias("performance"),
        F.when(moved, rank.otherwise(90)).cast("bigint").alias("percentile"))


def progression_history(state: DataFrame, events: DataFrame) -> DataFrame:
    """Every user's events since entering the funnel, numbered, with seconds from entry and from the last event."""
    keys = [*SCOPE, "anonymous_id"]
    users = state.select(*FUNNEL, "anonymous_id", "entered_at")
    rows = events.select(
        *keys, "id", "event_name", "timestamp", F.col("page.url").alias("page_url"),
        F.col("utm.source").alias("utm_source"), F.col("device.type").alias("device_type"),
    ).join(users, keys).where(F.col("timestamp") >= F.col("entered_at"))
    numbered = number_rows(rows, [*FUNNEL, "anonymous_id"])
    return numbered.select(
        *FUNNEL, "anonymous_id", F.col("position").cast("bigint").alias("step_order"), "event_name", "timestamp",
        "page_url", "utm_source", "device_type",
        F.floor(seconds_between(F.col("timestamp"), F.col("entered_at"))).alias("time_from_start"),
        F.coalesce(F.floor(seconds_between(F.col("timestamp"), F.col("previous_at"))), zero()).alias("time_from_previous"))


def whole_progression(state: DataFrame, steps: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Every user's progression in three parts: one row of `progression`, one of `step_timing` for each step that users of
    the funnel stand on, one of `journey_history` for each event since the user entered. Columns of other parts are null.

    `state` tells who abandoned (`abandon_users`). Parts are rows, not arrays, as a journey may be of any length.
    """
    labels = steps.groupBy(*FUNNEL, F.col("order_index").cast("bigint").alias("step_order")).agg(
        F.min_by("step_label", "step_id").alias("step_label"))

    def labelled(rows: DataFrame, part: str) -> DataFrame:
        named = F.when(F.col("step_label") != "", F.col("step_label")).otherwise(F.concat(F.lit("Step "), F.col("step_order")))
        return rows.join(labels, [*FUNNEL, "step_order"], "left").withColumns({"step_label": named, "part": F.lit(part)})

    known = events.where(F.col("timestamp") <= timestamp(now))
    own = user_progression(state, now).withColumn("step_order", F.col("current_step"))
    parts = [labelled(own, "progression"),
             labelled(progression_timing(state, beyond=True), "step_timing"),
             labelled(progression_history(state, known), "journey_history")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)

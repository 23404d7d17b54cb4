"""Funnel conversion: steps, totals, significance, segments, time series and peers.

State has one row per (funnel, visitor), so users are plain row counts here, and every per-step figure comes
from one histogram by furthest step and a suffix sum over the few steps of a funnel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    banded, mean_seconds, micros_between, period_label, rate, round_half_up, share, two_sided_p,
)
from trailmark.operators.percentiles import distribution
from trailmark.operators.state import reached_all_steps
from trailmark.params import FUNNEL, SCOPE, Period, timestamp

# Fixed values of the conversion report.
BOTTLENECK_ABOVE = 50.0
SEVERITY_BANDS = [(75.0, "critical"), (60.0, "high"), (45.0, "medium")]
PEER_MIN_ENTRIES = 100
PEER_DAYS = 30
TREND_THRESHOLD = 0.1
MOVING_AVERAGE = 7
PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def zero() -> Column:
    return F.lit(0).cast("bigint")


def step_histogram(state: DataFrame, *extra: Column) -> DataFrame:
    """Users by the furthest step they reached."""
    return state.groupBy(*FUNNEL, F.col("current_step_index").alias("order_index")).agg(
        F.count("*").alias("stopped_here"), *extra)


def step_reach(state: DataFrame, steps: DataFrame, *extra: Column) -> DataFrame:
    """Every step of every funnel with the users at it and at it or beyond (`users`)."""
    table = steps.select(*FUNNEL, "total_steps", "order_index", "step_type", "step_label").join(
        step_histogram(state, *extra), [*FUNNEL, "order_index"], "left")
    beyond = Window.partitionBy(*FUNNEL).orderBy(F.desc("order_index")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return table.withColumns({
        "stopped_here": F.coalesce("stopped_here", zero()),
        "users": F.coalesce(F.sum("stopped_here").over(beyond), zero()),
    })


def step_completions(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Users who entered in the period and reached each step (numbered from 1)."""
    reach = step_reach(state.where(period.contains("entered_at")), steps)
    return reach.select(*FUNNEL, (F.col("order_index") + 1).cast("bigint").alias("step_order"), "users")


def conversion_steps(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Per step: users, conversion from the previous step and from the start, drop-off, minutes to get there.

    Users are expanded to the steps they reached, so one distribution gives users, mean and percentiles at once.
    """
    reached = state.where(period.contains("entered_at")).select(
        *FUNNEL, F.explode(F.sequence(F.lit(0), F.col("current_step_index"))).alias("order_index"),
        micros_between(F.col("last_activity_at"), F.col("entered_at")).alias("spent"))
    times = distribution(reached, [*FUNNEL, "order_index"], F.col("spent"), PERCENTILES)
    table = steps.select(*FUNNEL, "order_index", "step_type", "step_label").join(
        times.withColumnRenamed("rows", "users"), [*FUNNEL, "order_index"], "left")
    by_step = Window.partitionBy(*FUNNEL).orderBy("order_index")
    table = table.withColumn("users", F.coalesce("users", zero()))
    table = table.withColumns({"before": F.coalesce(F.lag("users").over(by_step), F.col("users")),
                               "start": F.first("users").over(by_step)})
    lost = F.col("before") - F.col("users")
    drop = share(lost, F.col("before"))
    minutes = lambda c: F.coalesce(round_half_up(c / 60), F.lit(0.0))
    return table.select(
        *FUNNEL, (F.col("order_index") + 1).cast("bigint").alias("step_order"), "step_label", "step_type", "users",
        rate(F.col("users"), F.col("before")).alias("conversion_from_previous"),
        rate(F.col("users"), F.col("start")).alias("conversion_from_start"),
        round_half_up(drop).alias("drop_off_rate"), lost.alias("drop_off_count"),
        (drop > BOTTLENECK_ABOVE).alias("is_bottleneck"),
        banded(drop, SEVERITY_BANDS, "low").alias("bottleneck_severity"),
        minutes(F.col("mean")).alias("average_minutes"),
        *[minutes(F.col(p)).alias(f"{p}_minutes") for p in PERCENTILES],
    )


def conversion_overall(state: DataFrame, period: Period) -> DataFrame:
    """Per funnel: entries, users at the last step, rate, drop-offs, minutes to convert, conversions per hour."""
    entered, done = period.contains("entered_at"), reached_all_steps()
    hours = period.length.total_seconds() / 3600
    minutes = F.avg(F.when(entered & done, micros_between(F.col("completed_at"), F.col("entered_at"))).cast("double"))
    facts = state.where(entered | period.contains("completed_at")).groupBy(*FUNNEL).agg(
        F.count_if(entered).alias("total_entries"),
        F.count_if(entered & (F.col("current_step_index") + 1 == F.col("total_steps"))).alias("total_conversions"),
        (minutes / F.lit(60e6)).alias("minutes"),
        F.count_if(done & period.contains("completed_at")).alias("in_period"),
    )
    raw = share(F.col("total_conversions"), F.col("total_entries"))
    return facts.select(
        *FUNNEL, "total_entries", "total_conversions", round_half_up(raw).alias("conversion_rate"),
        (F.col("total_entries") - F.col("total_conversions")).alias("total_drop_offs"),
        F.coalesce(round_half_up(F.col("minutes")), F.lit(0.0)).alias("average_minutes_to_convert"),
        (round_half_up(F.col("in_period") / F.lit(hours)) if hours > 0 else F.lit(0.0)).alias("conversion_velocity"),
        round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 10))).alias("engagement_score"),
    )


def conversion_significance(state: DataFrame, period: Period) -> DataFrame:
    """Two-proportion z-test of the period against the one before, both from one pass over state."""
    before = period.previous_days()
    now_in, before_in = period.contains("entered_at"), before.contains("entered_at")
    last = F.col("current_step_index") + 1 == F.col("total_steps")
    facts = state.where(now_in | before_in).groupBy(*FUNNEL).agg(
        F.count_if(now_in).alias("n"), F.count_if(now_in & last).alias("c"),
        F.count_if(before_in).alias("pn"), F.count_if(before_in & last).alias("pc"))
    facts = facts.withColumns({
        "current_rate": rate(F.col("c"), F.col("n")) / 100, "previous_rate": rate(F.col("pc"), F.col("pn")) / 100})
    pooled = (F.col("c") + F.col("pc")) / (F.col("n") + F.col("pn"))
    error = F.when((F.col("n") > 0) & (F.col("pn") > 0), F.sqrt(
        pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("pn"))))
    facts = facts.withColumn("z", F.when(error > 0, (F.col("current_rate") - F.col("previous_rate")) / error))
    facts = facts.withColumn("p", two_sided_p(F.col("z")))
    return facts.select(
        *FUNNEL, "current_rate", "previous_rate",
        round_half_up(F.when(F.col("previous_rate") > 0, (F.col("current_rate") - F.col("previous_rate"))
                             / F.col("previous_rate") * 100)).alias("improvement"),
        round_half_up(F.col("z"), 3).alias("z_score"), round_half_up(F.col("p"), 4).alias("p_value"),
        F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("is_significant"),
        F.when(F.col("p") < 0.01, 99).when(F.col("p") < 0.05, 95).otherwise(90).cast("bigint")
        .alias("confidence_level"),
    )


def user_segments(events: DataFrame) -> DataFrame:
    """Distinct (visitor, segment type, segment value): device and traffic source in one pass."""
    pairs = F.array(
        F.struct(F.lit("device").alias("segment_type"),
                 F.coalesce("device.type", F.lit("unknown")).alias("segment_value")),
        F.struct(F.lit("traffic_source").alias("segment_type"),
                 F.coalesce("utm.source", F.lit("direct")).alias("segment_value")),
    )
    seen = events.select(*SCOPE, "anonymous_id", F.explode(pairs).alias("_s"))
    return seen.select(*SCOPE, "anonymous_id", "_s.*").distinct()


def segment_conversion(state: DataFrame, events: DataFrame, period: Period) -> DataFrame:
    """Entries and conversions per device type and traffic source; a user counts in every segment they used."""
    entered = state.where(period.contains("entered_at"))
    done = reached_all_steps()
    average = entered.groupBy(*FUNNEL).agg(rate(F.count_if(done), F.count("*")).alias("average_rate"))
    facts = entered.join(user_segments(events), [*SCOPE, "anonymous_id"]).groupBy(
        *FUNNEL, "segment_type", "segment_value").agg(
        F.count("*").alias("total_entries"), F.count_if(done).alias("total_conversions"))
    raw = share(F.col("total_conversions"), F.col("total_entries"))
    facts = facts.join(average, FUNNEL).withColumn("conversion_rate", round_half_up(raw))
    value = F.col("conversion_rate")
    return facts.select(
        *FUNNEL, "segment_type", "segment_value", "total_entries", "total_conversions", "conversion_rate",
        F.when(F.col("average_rate") > 0, round_half_up((raw - F.col("average_rate")) / F.col("average_rate") * 100))
        .alias("performance_vs_average"),
        (F.col("total_entries") > 100).alias("is_significant"),
        F.greatest(F.lit(0.0), value - 5).alias("lower_bound"), F.least(F.lit(100.0), value + 5).alias("upper_bound"),
        F.when(value > 5, "outperforming").when(value < 2, "underperforming").otherwise("stable").alias("insight"),
        F.least(F.lit(100.0), F.col("total_entries") / 10).alias("impact_score"),
    )


UNITS = {"hourly": "hour", "daily": "day", "weekly": "week"}


def conversion_timeseries(state: DataFrame, funnels: DataFrame, period: Period, granularity: str = "daily") -> DataFrame:
    """Entries by entry period, conversions by completion period, rate, 7-point mean and direction.

    `funnels` gives the funnels that get a gap-free series. The window runs over series points, not events.
    """
    unit = UNITS[granularity]
    label = lambda c: period_label(F.col(c), unit)
    entries = state.where(period.contains("entered_at")).groupBy(*FUNNEL, label("entered_at").alias("date")).agg(
        F.count("*").alias("entries"))
    conversions = state.where(reached_all_steps() & period.contains("completed_at")).groupBy(
        *FUNNEL, label("completed_at").alias("date")).agg(F.count("*").alias("conversions"))
    points = F.sequence(timestamp(period.start), timestamp(period.end), F.expr(f"interval 1 {unit}"))
    spine = funnels.select(*FUNNEL).distinct().withColumn("at", F.explode(points)).withColumn("date", label("at"))
    rows = spine.join(entries, [*FUNNEL, "date"], "left").join(conversions, [*FUNNEL, "date"], "left").select(
        *FUNNEL, "at", "date", F.coalesce("entries", zero()).alias("entries"),
        F.coalesce("conversions", zero()).alias("conversions"),
        rate(F.coalesce("conversions", zero()), F.coalesce("entries", zero())).alias("conversion_rate"))
    by_time = Window.partitionBy(*FUNNEL).orderBy("at")
    mean = F.avg("conversion_rate").over(by_time.rowsBetween(-(MOVING_AVERAGE - 1), 0))
    rows = rows.withColumn("moving_average", round_half_up(mean))
    previous = F.lag("moving_average").over(by_time)
    return rows.withColumn(
        "trend_direction",
        F.when(F.col("conversion_rate") > previous + TREND_THRESHOLD, "up")
        .when(F.col("conversion_rate") < previous - TREND_THRESHOLD, "down").otherwise("stable"),
    ).withColumnRenamed("at", "period_start")


def peer_comparison(state: DataFrame, period: Period, as_of: str) -> DataFrame:
    """Percentile of each funnel's rate among its workspace's funnels of the last 30 days with enough entries.

    A running count over rates stands in for comparing every pair of funnels.
    """
    recent = state.where(F.col("entered_at") >= F.date_trunc("day", timestamp(as_of)) - F.expr(
        f"interval {PEER_DAYS} days"))
    peers = recent.groupBy(*FUNNEL).agg(
        F.count("*").alias("n"), F.count_if(reached_all_steps()).alias("c")
    ).where(F.col("n") >= PEER_MIN_ENTRIES).select(
        *FUNNEL, share(F.col("c"), F.col("n")).alias("rate"), F.lit(1).alias("is_peer"))
    own = conversion_overall(state, period).where("total_entries > 0").select(
        *FUNNEL, F.col("conversion_rate").alias("rate"), F.lit(0).alias("is_peer"))
    in_scope = Window.partitionBy(*SCOPE)
    by_rate = in_scope.orderBy("rate").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = peers.unionByName(own).select(
        *FUNNEL, "rate", "is_peer", F.sum("is_peer").over(by_rate).alias("at_or_below"),
        F.sum("is_peer").over(in_scope).alias("peers"),
        F.avg(F.when(F.col("is_peer") == 1, F.col("rate"))).over(in_scope).alias("mean"))
    return ranked.where("is_peer = 0").select(
        *FUNNEL, F.col("rate").alias("conversion_rate"),
        F.when(F.col("peers") > 0, round_half_up(F.col("at_or_below") / F.col("peers") * 100, 0))
        .otherwise(F.lit(50.0)).alias("percentile"),
        F.coalesce(round_half_up(F.col("mean")), F.lit(0.0)).alias("peer_average"))


def step_metrics_window(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Per step: users of the funnel in the window, share at or beyond the step, seconds to complete.

    The step number is the stored order (from 0) while a user's position counts from 1, so users of the step
    before count as well; that is the published behaviour of this report.
    """
    entered = state.where(period.contains("entered_at"))
    totals = entered.groupBy(*FUNNEL).agg(
        F.count("*").alias("total_entries"),
        mean_seconds(F.col("completed_at"), F.col("entered_at")).alias("seconds"))
    reach = step_reach(entered, steps).select(*FUNNEL, "order_index", "step_label", "users")
    by_step = Window.partitionBy(*FUNNEL).orderBy("order_index")
    at_least = F.coalesce(F.lag("users").over(by_step), F.col("users"))
    reach = reach.withColumn("at_least", at_least)
    return reach.join(totals, FUNNEL, "left").select(
        *FUNNEL, F.col("order_index").cast("bigint").alias("step_order"), "step_label",
        F.coalesce("total_entries", zero()).alias("total_entries"),
        share(F.col("at_least"), F.col("total_entries")).alias("conversion_rate"),
        F.coalesce("seconds", F.lit(0.0)).alias("avg_completion_seconds"))

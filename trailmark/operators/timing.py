"""Time to convert and time between steps, from matched events.

No pair of events of a user is ever materialised. What needs pairs is written as probes into running counts,
kept per (user, hour) so that a very busy user is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import banded, ceilinged, change_percent, duration_text, rate, round_half_up
from trailmark.operators.blocks import BLOCK, block_of, carry_forward
from trailmark.operators.percentiles import distribution
from trailmark.params import FUNNEL, Period, timestamp

USER = [*FUNNEL, "anonymous_id"]
DAY = 86_400_000_000
LOOK_AHEAD_DAYS = 7
WEEK = LOOK_AHEAD_DAYS * DAY // BLOCK  # in blocks

# Buckets of the time-to-convert distribution (upper bound in seconds, bucket, range).
TIME_BUCKETS = [
    (300, "0-5min", "0-5 minutes"), (900, "5-15min", "5-15 minutes"), (1800, "15-30min", "15-30 minutes"),
    (3600, "30-60min", "30-60 minutes"), (86400, "1-24h", "1-24 hours"), (604800, "1-7d", "1-7 days"),
]
LAST_BUCKET = ("7d+", "Over 7 days")
# Velocity score by mean seconds to convert.
VELOCITY = [(300.0, 100), (1800.0, 85), (3600.0, 70), (86400.0, 50)]
VELOCITY_WORST = 25
MIN_SEGMENT_CONVERSIONS = 10
PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def velocity_score(seconds: Column) -> Column:
    return ceilinged(seconds, VELOCITY, VELOCITY_WORST, strict=False).cast("bigint")


def completed_users(matched: DataFrame, period: Period, *extra: Column) -> DataFrame:
    """Users who matched every step of their funnel in the period, with first and last matched event.

    The set of steps is bounded by the funnel and combines before the shuffle.
    """
    users = matched.where(period.contains("timestamp")).groupBy(*USER, "total_steps").agg(
        F.size(F.collect_set("step_order")).alias("steps"), F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"), *extra)
    return users.where((F.col("steps") == F.col("total_steps")) & (F.col("steps") > 1)).withColumn(
        "micros", F.unix_micros("last_at") - F.unix_micros("first_at"))


def timing_distribution(matched: DataFrame, period: Period) -> DataFrame:
    """Per funnel: percentiles, mean, deviation and range of seconds to convert."""
    times = completed_users(matched, period).where("micros > 0")
    rows = distribution(times, FUNNEL, F.col("micros"), PERCENTILES)
    return rows.select(*FUNNEL, F.col("mean").alias("mean_seconds"), F.col("stddev").alias("stddev_seconds"),
                       F.col("least").alias("min_seconds"), F.col("most").alias("max_seconds"),
                       F.col("n").alias("conversions"), *PERCENTILES)


def timing_buckets(matched: DataFrame, period: Period) -> DataFrame:
    """Per funnel: users and share per time-to-convert bucket."""
    times = completed_users(matched, period).where("micros > 0")
    pick = lambda at: ceilinged(F.col("micros"), [(b[0] * 1_000_000, b[at]) for b in TIME_BUCKETS],
                                LAST_BUCKET[at - 1], strict=False)
    counts = times.groupBy(*FUNNEL, pick(1).alias("time_bucket"), pick(2).alias("time_range")).agg(
        F.count("*").alias("user_count"))
    total = F.sum("user_count").over(Window.partitionBy(*FUNNEL))
    return counts.withColumn("percentage", round_half_up(F.col("user_count") * 100.0 / total))


# ---------------------------------------------------------------- transitions
def _link_rows(matched: DataFrame, period: Period) -> DataFrame:
    """Each matched event as source of its own link and as target of the link before, from one scan.

    Sources lie in the period, targets up to seven days after it.
    """
    start, end = timestamp(period.start), timestamp(period.end)
    as_source = F.when(F.col("timestamp") <= end, F.struct(
        F.col("step_order").alias("link"), F.lit(False).alias("is_target")))
    as_target = F.when(F.col("step_order") > 0, F.struct(
        (F.col("step_order") - 1).alias("link"), F.lit(True).alias("is_target")))
    near = matched.where((F.col("timestamp") >= start) & (
        F.col("timestamp") <= end + F.expr(f"interval {LOOK_AHEAD_DAYS} days")))
    rows = near.select(*USER, F.unix_micros("timestamp").alias("us"), F.explode(F.array(as_source, as_target)).alias("_l"))
    return rows.where("_l is not null").select(*USER, "_l.link", "us", "_l.is_target")


def nearest_next(matched: DataFrame, period: Period) -> DataFrame:
    """For every matched event, microseconds to the user's nearest event on the next step within 7 days.

    Backwards in time, the last target seen is the nearest later one; sources come before targets of the same
    instant, so only strictly later ones count.
    """
    rows = _link_rows(matched, period).withColumns({
        "back": -F.col("us"), "target": F.when(F.col("is_target"), F.col("us"))})
    found = carry_forward(rows, [*USER, "link"], "target", "next_us", at="back", tie="is_target", last=F.min("target"))
    wait = F.col("next_us") - F.col("us")
    return found.where(~F.col("is_target")).select(
        *USER, F.col("link").alias("step_order"), F.when(wait <= LOOK_AHEAD_DAYS * DAY, wait).alias("wait_micros"))


def step_transition_pairs(matched: DataFrame, period: Period) -> DataFrame:
    """Per step: events, those without a next-step event within 7 days, and all (event, later event) pairs.

    Pairs of a source at t are targets(<= t + 7 days) - targets(<= t). Both terms are probes into the running
    count of the hour they fall in, plus the count of the hours before, which is one row per user and hour.

    The hour of t + 7 days is WEEK hours after that of t. So the sources of an hour have no next event where no hour
    between the two has a target, and then those at or after the last target of their own hour, less those whose later
    probe stands at or after the first target of its hour. Matched events are read, moved and sorted once.
    """
    origin = F.unix_micros(timestamp(period.start)) / F.lit(1e6)
    seconds = F.col("us") / F.lit(1e6) - origin
    row = lambda us, sign, target_at: F.struct(
        us.alias("us"), F.lit(sign).alias("sign"), target_at.alias("target_at"))
    none, us = F.lit(None).cast("double"), F.col("us")
    probes = F.array(row(us + LOOK_AHEAD_DAYS * DAY, 1, none), row(us, -1, none))
    rows = _link_rows(matched, period).select(
        *USER, "link", F.explode(F.when(F.col("is_target"), F.array(row(us, 0, seconds))).otherwise(probes)).alias("_p")).select(
        *USER, "link", "_p.*").withColumn("block", block_of(us))
    inside = Window.partitionBy(*USER, "link", "block").orderBy("us")
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_target, is_source, is_late = F.col("sign") == 0, F.col("sign") == -1, F.col("sign") == 1
    rows = rows.withColumns({
        "n": F.count_if(is_target).over(upto), "s": F.coalesce(F.sum("target_at").over(upto), F.lit(0.0)),
        "sources_before": F.count_if(is_source).over(inside.rangeBetween(Window.unboundedPreceding, -1))})
    at = (us - F.when(is_late, LOOK_AHEAD_DAYS * DAY).otherwise(0)) / F.lit(1e6) - origin
    probe_at = F.when(is_target, 0.0).otherwise(at)
    blocks = rows.groupBy(*USER, "link", "block").agg(
        F.count_if(is_target).alias("targets"), F.sum("target_at").alias("target_sum"),
        F.sum("sign").alias("net"), F.sum(F.col("sign") * probe_at).alias("net_at"),
        F.sum(F.col("sign") * F.col("n")).alias("pairs"),
        F.sum(F.col("sign") * (F.col("s") - probe_at * F.col("n"))).alias("wait"),
        F.count_if(is_source).alias("sources"), F.count_if(is_late).alias("late"),
        F.min(F.when(is_target, us)).alias("first_target"), F.max(F.when(is_target, us)).alias("last_target"),
        F.max(F.when(is_target, F.col("sources_before"))).alias("followed"),
        F.count_if(is_late & (F.col("n") > 0)).alias("reached"))
    hours = Window.partitionBy(*USER, "link").orderBy("block")
    before, week_ago = hours.rowsBetween(Window.unboundedPreceding, -1), hours.rangeBetween(-WEEK, -WEEK)
    blocks = blocks.withColumns({
        "n0": F.coalesce(F.sum("targets").over(before), F.lit(0)),
        "s0": F.coalesce(F.sum("target_sum").over(before), F.lit(0.0)),
        "n_week_ago": F.coalesce(F.sum("targets").over(hours.rangeBetween(Window.unboundedPreceding, -WEEK)), F.lit(0)),
        "unfollowed": F.sum(F.col("sources") - F.coalesce("followed", F.lit(0))).over(week_ago),
        "week_ago_last": F.max("last_target").over(week_ago)})
    nothing_between = (F.col("late") > 0) & (F.col("n0") == F.col("n_week_ago"))
    in_time = F.coalesce(F.col("week_ago_last") + LOOK_AHEAD_DAYS * DAY > F.col("first_target"), F.lit(False))
    # users or funnels without a key are no one's: their events are not counted
    known = F.lit(True)
    for name in (*USER, "link"):
        known = known & F.col(name).isNotNull()
    totals = blocks.groupBy(*FUNNEL, F.col("link").alias("step_order")).agg(
        F.sum(F.col("pairs") + F.col("net") * F.col("n0")).cast("bigint").alias("pairs"),
        F.sum(F.col("wait") + F.col("net") * F.col("s0") - F.col("net_at") * F.col("n0")).alias("wait"),
        F.sum(F.when(known, F.col("sources")).otherwise(0)).alias("events"),
        F.sum(F.when(known & nothing_between & ~in_time, F.col("unfollowed") - F.col("reached")).otherwise(0)).alias("without_next"))
    counted = F.col("pairs") + F.col("without_next")
    return totals.where("events > 0").select(
        *FUNNEL, F.col("step_order").cast("bigint").alias("step_order"), "events", "without_next", "pairs",
        F.when(F.col("pairs") > 0, F.col("wait") / F.col("pairs")).otherwise(F.lit(0.0)).alias("avg_pair_seconds"),
        rate(F.col("without_next"), counted).alias("abandonment_rate"))


def step_timing(matched: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Per step: mean, median and p90 seconds to the nearest next-step event, and the share that has none."""
    keys = [*FUNNEL, "step_order"]
    waits = distribution(nearest_next(matched, period), keys, F.col("wait_micros"), {"p50": 0.5, "p90": 0.9})
    labels = steps.select(*FUNNEL, F.col("order_index").alias("step_order"), "step_label")
    return waits.join(labels, keys).select(
        *FUNNEL, F.col("step_order").cast("bigint").alias("step_order"), "step_label",
        F.coalesce("mean", F.lit(0.0)).alias("avg_seconds"), F.coalesce("p50", F.lit(0.0)).alias("median_seconds"),
        F.coalesce("p90", F.lit(0.0)).alias("p90_seconds"), F.col("rows").alias("user_count"),
        rate(F.col("rows") - F.col("n"), F.col("rows")).alias("abandonment_rate"))


# --------------------------------------------------------------------- trends
def velocity_trends(matched: DataFrame, period: Period, granularity: str = "daily") -> DataFrame:
    """Per day or week of first event: mean and median seconds to convert, score, faster or slower than before."""
    unit = {"daily": "day", "weekly": "week"}[granularity]
    times = completed_users(matched, period).where("micros > 0").withColumn(
        "period", F.date_trunc(unit, F.col("first_at")))
    keys = [*FUNNEL, "period"]
    table = distribution(times, keys, F.col("micros"), {"median_seconds": 0.5}).withColumnsRenamed(
        {"rows": "conversion_count", "mean": "avg_seconds"})
    before = F.lag("avg_seconds").over(Window.partitionBy(*FUNNEL).orderBy("period"))
    change = change_percent(F.col("avg_seconds"), before)
    return table.select(
        *FUNNEL, F.date_format("period", "yyyy-MM-dd").alias("period"), "avg_seconds", "median_seconds",
        "conversion_count", velocity_score(F.col("avg_seconds")).alias("velocity_score"),
        F.when(before.isNull(), "stable").when(change < -10, "improving").when(change > 10, "declining")
        .otherwise("stable").alias("trend_indicator"))


def segment_timing(matched: DataFrame, period: Period) -> DataFrame:
    """Seconds to convert by device, source and platform, for segments with at least 10 conversions.

    A user who used several devices or sources counts once per combination with more than one step.
    """
    kind = F.col("device.type")
    rows = matched.where(period.contains("timestamp")).groupBy(
        *USER, "total_steps", F.coalesce(kind, F.lit("unknown")).alias("device_type"),
        F.coalesce("utm.source", F.lit("direct")).alias("traffic_source"),
        F.when(F.col("page.url").contains("mobile") | (kind == "mobile"), "mobile").when(kind == "desktop", "desktop")
        .otherwise("unknown").alias("platform"),
    ).agg(F.collect_set("step_order").alias("steps"),
          (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))).alias("micros"))
    # A user has one row per combination used; together they tell whether every step was matched.
    seen = F.size(F.array_distinct(F.flatten(F.collect_set("steps").over(Window.partitionBy(*USER)))))
    rows = rows.withColumn("seen", seen).where(
        (F.col("seen") == F.col("total_steps")) & (F.size("steps") > 1) & (F.col("micros") > 0))
    segment = F.explode(F.array(*[
        F.struct(F.lit(n).alias("segment_name"), F.col(n).alias("segment_value"))
        for n in ("device_type", "traffic_source", "platform")]))
    long = rows.select(*FUNNEL, "micros", segment.alias("_s")).select(*FUNNEL, "micros", "_s.*")
    keys = [*FUNNEL, "segment_name", "segment_value"]
    table = distribution(long, keys, F.col("micros"), {"median_seconds": 0.5, "p90_seconds": 0.9},
                         min_rows=MIN_SEGMENT_CONVERSIONS).withColumnsRenamed(
        {"rows": "conversion_count", "mean": "avg_seconds"})
    mean = F.avg("avg_seconds").over(Window.partitionBy(*FUNNEL))
    return table.select(
        *keys, "avg_seconds", "median_seconds", "p90_seconds", "conversion_count",
        velocity_score(F.col("avg_seconds")).alias("velocity_score"),
        F.when(F.col("avg_seconds") < mean * 0.8, "fast").when(F.col("avg_seconds") > mean * 1.2, "slow")
        .otherwise("average").alias("performance_indicator"))


def timing_insights(overall: DataFrame, steps: DataFrame, trends: DataFrame, segments: DataFrame) -> DataFrame:
    """Findings, one row each: slow funnel, slow or leaky step, falling velocity, slowest slow segment."""
    row = lambda kind, severity, subject, value: [
        *FUNNEL, F.lit(kind).alias("insight"), severity.alias("severity"), subject.alias("subject"), value.alias("value")]
    slow = overall.where("mean_seconds > 86400").select(*row(
        "slow_funnel", F.lit("high"), duration_text(F.col("mean_seconds")), F.col("mean_seconds")))
    whole = Window.partitionBy(*FUNNEL)
    step = steps.withColumns({"mean_time": F.avg("avg_seconds").over(whole),
                              "mean_lost": F.avg("abandonment_rate").over(whole)})
    spent, lost = F.col("avg_seconds"), F.col("abandonment_rate")
    slow_step = step.where(spent > F.col("mean_time") * 2).select(*row(
        "slow_progression", F.when(spent > F.col("mean_time") * 3, "high").otherwise("medium"),
        F.col("step_label"), spent))
    leaky = step.where((lost > F.col("mean_lost") * 1.5) & (lost > 20)).select(*row(
        "high_abandonment", banded(lost, [(50.0, "high"), (30.0, "medium")], "low"), F.col("step_label"), lost))
    newest = Window.partitionBy(*FUNNEL).orderBy(F.desc("period"))
    recent = trends.withColumn("_rn", F.row_number().over(newest)).where("_rn <= 3").groupBy(*FUNNEL).agg(
        F.count("*").alias("n"), F.count_if(F.col("trend_indicator") == "declining").alias("declining"))
    falling = recent.where("n >= 2 and declining >= 2").select(*row(
        "declining_velocity", F.lit("medium"), F.lit("recent periods"), F.col("declining").cast("double")))
    slowest = segments.where("performance_indicator = 'slow'").groupBy(*FUNNEL).agg(
        F.min(F.struct((-F.col("avg_seconds")).alias("k"), "segment_name", "segment_value")).alias("s"))
    slow_segment = slowest.select(*row("slow_segment", F.lit("medium"), F.col("s.segment_value"), -F.col("s.k")))
    return slow.unionByName(slow_step).unionByName(leaky).unionByName(falling).unionByName(slow_segment)

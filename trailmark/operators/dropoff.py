"""Drop-off, exits, bottlenecks and what to do about them; all from one histogram per funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import banded, ceilinged, labels_where, micros_between, rate, round_half_up, share
from trailmark.operators.conversion import step_reach, zero
from trailmark.params import FUNNEL, Period

# Bands of the drop-off report.
EXIT_VELOCITY = [(30.0, "immediate"), (300.0, "quick"), (1800.0, "delayed")]
DROPOFF_CLASSES = [(75.0, "critical"), (50.0, "high"), (25.0, "medium")]
EFFORT_BANDS = [(70.0, "high"), (40.0, "medium")]
TOP_BOTTLENECKS = 5


def _exits(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Every step with entries (at or beyond) and exits (stopped here without completing)."""
    left = F.col("completed_at").isNull()
    spent = micros_between(F.col("last_activity_at"), F.col("entered_at"))
    at_once = F.col("last_activity_at") == F.col("entered_at")
    return step_reach(
        state.where(period.contains("entered_at")), steps,
        F.count_if(left).alias("exits"), F.count_if(left & at_once).alias("immediate"),
        F.avg(F.when(left, spent).cast("double")).alias("exit_micros"),
        F.sum(spent.cast("double")).alias("spent"), F.count_if(~left).alias("completions"),
    ).withColumns({"exits": F.coalesce("exits", zero()), "immediate": F.coalesce("immediate", zero())})


def _step_order() -> Column:
    return F.col("order_index").cast("bigint").alias("step_order")


def dropoff_steps(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Per step: entries, exits, drop-off %, mean seconds before leaving, how fast users leave."""
    seconds = F.col("exit_micros") / F.lit(1e6)
    drop = rate(F.col("exits"), F.col("users"))
    return _exits(state, steps, period).select(
        *FUNNEL, _step_order(), "step_label", F.col("users").alias("entries"), "exits", drop.alias("drop_off_rate"),
        F.coalesce(seconds, F.lit(0.0)).alias("avg_seconds_before_exit"),
        ceilinged(seconds, EXIT_VELOCITY, "hesitant").alias("exit_velocity"),
        banded(drop, DROPOFF_CLASSES, "low", strict=False).alias("drop_off_severity"))


def exit_triggers(dropoffs: DataFrame) -> DataFrame:
    """Likely reasons for leaving a step, one row per reason with its share of users."""
    drop, speed = F.col("drop_off_rate"), F.col("exit_velocity")
    reason = lambda name, weight: F.struct(
        F.lit(name).alias("trigger_type"), round_half_up(drop * weight, 0).alias("frequency"))
    found = labels_where(
        ((speed == "immediate") & (drop > 30), reason("error", 0.6)),
        ((speed == "hesitant") & (F.col("avg_seconds_before_exit") > 600), reason("confusion", 0.5)),
        ((speed == "quick") & (drop > 40), reason("friction", 0.4)),
        ((drop > 20) & (drop < 40), reason("distraction", 0.3)),
    )
    return dropoffs.select(*FUNNEL, "step_order", F.explode(found).alias("_t")).select(
        *FUNNEL, "step_order", "_t.*")


def exit_paths(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Per step with exits: those who left at once and those who stayed a while."""
    delayed = F.col("exits") - F.col("immediate")
    return _exits(state, steps, period).where("exits > 0").select(
        *FUNNEL, _step_order(), "step_label", F.col("exits").alias("total_exits"),
        F.col("immediate").alias("immediate_exits"), delayed.alias("delayed_exits"),
        rate(F.col("immediate"), F.col("exits"), 1).alias("immediate_pct"),
        rate(delayed, F.col("exits"), 1).alias("delayed_pct"))


def bottleneck_severity(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Steps with exits by severity: drop-off weighted by the share of all users who got there."""
    whole = Window.partitionBy(*FUNNEL)
    rows = _exits(state, steps, period).withColumns({
        "total_entries": F.sum("stopped_here").over(whole),
        "total_conversions": F.coalesce(F.sum("completions").over(whole), zero()),
        "avg_seconds": F.try_divide(F.sum("spent").over(whole), F.sum("stopped_here").over(whole)) / F.lit(1e6),
    }).where("exits > 0")
    drop = rate(F.col("exits"), F.col("users"))
    score = F.least(F.lit(100.0), share(F.col("exits"), F.col("users"))
                    * F.try_divide(F.col("users"), F.col("total_entries")) * 2)
    rows = rows.select(
        *FUNNEL, _step_order(), "step_label", "step_type", F.col("users").alias("entries"), "exits",
        "total_entries", "total_conversions", "avg_seconds", drop.alias("drop_off_rate"),
        score.alias("severity_score"),
        rate(F.col("exits"), F.col("total_entries")).alias("impact_on_conversion"))
    return rows.withColumns({
        "conservative_estimate": round_half_up(F.col("drop_off_rate") * 0.2, 0),
        "optimistic_estimate": round_half_up(F.col("drop_off_rate") * 0.5, 0),
        "effort": banded(F.col("severity_score"), EFFORT_BANDS, "low"),
    })


def likely_causes(severity: DataFrame) -> DataFrame:
    """One row per likely cause of a bottleneck with its confidence."""
    score, drop, spent, kind = (F.col(c) for c in ("severity_score", "drop_off_rate", "avg_seconds", "step_type"))
    cause = lambda name, reason, cap, plus: F.struct(
        F.lit(name).alias("cause_type"), F.lit(reason).alias("reason"),
        F.least(F.lit(float(cap)), score + float(plus)).alias("confidence"))
    found = labels_where(
        (spent < 30, cause("ux", "leaves_at_once", 95, 20)),
        ((spent > 300) & (drop > 50), cause("content", "long_before_exit", 90, 15)),
        ((kind == "page") & (drop > 60), cause("technical", "page_drop_off", 85, 10)),
        ((kind == "event") & (drop > 40), cause("ux", "interaction_drop_off", 80, 5)),
    )
    other = F.array(F.struct(
        F.lit("external").alias("cause_type"), F.lit("unclear").alias("reason"),
        F.greatest(F.lit(40.0), score - 20).alias("confidence")))
    causes = F.when(F.size(found) > 0, found).otherwise(other)
    return severity.select(*FUNNEL, "step_order", F.explode(causes).alias("_c")).select(
        *FUNNEL, "step_order", "_c.*")


# One recommendation per severity band of a bottleneck.
# (score above, score up to, type, priority, factor, confidence, effort, days, test days, least sample, sample factor)
RECOMMENDATIONS = [
    (70.0, None, "ux", "critical", 1.0, 85, "high", 8, 14, 1000, 2),
    (50.0, 70.0, "content", "high", 0.8, 70, "medium", 4, 10, 500, 1),
    (30.0, 50.0, "flow", "medium", 0.6, 60, "low", 2, None, None, None),
]
# The recommendation of a funnel without a bottleneck.
DEFAULT_RECOMMENDATION = ("timing", "low", 5.0, 100.0, 40, "low", 1)
MONTHLY_USERS = 1000


def dropoff_recommendations(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Rule table over the five worst bottlenecks of each funnel; a default row where no rule applies."""
    worst = Window.partitionBy(*FUNNEL).orderBy(F.desc("severity_score"), "step_order")
    top = bottleneck_severity(state, steps, period).withColumn("_rn", F.row_number().over(worst)).where(
        F.col("_rn") <= TOP_BOTTLENECKS)
    score = F.col("severity_score")
    affected = round_half_up(F.col("impact_on_conversion") * MONTHLY_USERS, 0)
    rules = []
    for above, upto, kind, priority, factor, confidence, effort, days, test, least, times in RECOMMENDATIONS:
        scaled = lambda c, f=factor: c if f == 1.0 else round_half_up(c * f, 0)
        sample = F.greatest(F.lit(float(least)), affected * times) if least else F.lit(None).cast("double")
        hit = score > above if upto is None else (score > above) & (score <= upto)
        rules.append((hit, F.struct(
            F.lit(kind).alias("type"), F.lit(priority).alias("priority"),
            scaled(F.col("conservative_estimate")).alias("rate_lift"), scaled(affected).alias("affected_users"),
            F.lit(confidence).cast("bigint").alias("confidence"), F.lit(effort).alias("effort"),
            F.lit(days).cast("bigint").alias("dev_days"), F.lit(test).cast("bigint").alias("test_days"),
            sample.alias("test_sample"))))
    found = top.select(*FUNNEL, "step_order", F.explode(labels_where(*rules)).alias("_r")).select(
        *FUNNEL, "step_order", "_r.*")
    kind, priority, lift, users, confidence, effort, days = DEFAULT_RECOMMENDATION
    default = (
        steps.select(*FUNNEL).distinct().join(found.select(*FUNNEL).distinct(), FUNNEL, "left_anti")
        .select(*FUNNEL, F.lit(None).cast("bigint").alias("step_order"), F.lit(kind).alias("type"),
                F.lit(priority).alias("priority"), F.lit(lift).alias("rate_lift"),
                F.lit(users).alias("affected_users"), F.lit(confidence).cast("bigint").alias("confidence"),
                F.lit(effort).alias("effort"), F.lit(days).cast("bigint").alias("dev_days"),
                F.lit(None).cast("bigint").alias("test_days"), F.lit(None).cast("double").alias("test_sample"))
    )
    return found.unionByName(default)


def dropoff_summary(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Per funnel: all exits, the worst step and the mean severity."""
    return bottleneck_severity(state, steps, period).groupBy(*FUNNEL).agg(
        F.sum("exits").alias("total_drop_offs"),
        F.min(F.struct((-F.col("severity_score")).alias("s"), F.col("step_order").alias("step")))["step"]
        .alias("biggest_bottleneck_step"),
        round_half_up(F.least(F.lit(100.0), F.avg("severity_score")), 0).alias("optimization_potential"))

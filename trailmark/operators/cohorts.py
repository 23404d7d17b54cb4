"""Cohorts of users by entry period: make-up, progression, retention and how cohorts compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import micros_between, period_label, rate
from trailmark.operators.conversion import zero
from trailmark.params import FUNNEL, SCOPE, Period

UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}
COHORT = [*FUNNEL, "cohort_period"]

# Thresholds of the cohort comparison.
VOLATILE_ABOVE, VARIANCE_ABOVE, STABLE_BELOW = 0.3, 0.2, 0.05
P_LOW, P_HIGH = 0.01, 0.95
GAP_ABOVE = 10.0


def cohort_users(state: DataFrame, period: Period, cohort_period: str = "weekly") -> DataFrame:
    unit = UNITS[cohort_period]
    start = F.date_trunc(unit, F.col("entered_at"))
    return state.where(period.contains("entered_at")).withColumns(
        {"cohort_start": start, "cohort_period": period_label(start, unit)})


def _first_day_events(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users with their events of the day that follows entry: an equi-join with the interval as residual."""
    seen = events.select(
        *SCOPE, "anonymous_id", F.col("timestamp").alias("_at"), F.col("device.type").alias("_device"),
        F.col("utm.source").alias("_source"), F.col("geo.country").alias("_country"))
    keys = [*SCOPE, "anonymous_id"]
    u, s = users.alias("u"), seen.alias("s")
    same = [F.col(f"u.{k}") == F.col(f"s.{k}") for k in keys]
    inside = (F.col("_at") >= F.col("entered_at")) & (F.col("_at") <= F.col("entered_at") + F.expr("interval 1 day"))
    on = inside
    for condition in same:
        on = on & condition
    return u.join(s, on, "left").select("u.*", "_at", "_device", "_source", "_country")


def cohort_window(state: DataFrame, events: DataFrame, period: Period, cohort_period: str = "weekly") -> DataFrame:
    """Per cohort: users and the events of their first day."""
    rows = _first_day_events(cohort_users(state, period, cohort_period), events)
    per_user = rows.groupBy(*COHORT, "anonymous_id").agg(F.count("_at").alias("events"))
    return per_user.groupBy(*COHORT).agg(F.count("*").alias("users"), F.sum("events").alias("events"),
                                         F.count_if(F.col("events") == 0).alias("without_events"))


def cohorts(state: DataFrame, events: DataFrame, period: Period, cohort_period: str = "weekly") -> DataFrame:
    """Cohort size and its distinct users per device, source and country of their first day, one row per value."""
    users = cohort_users(state, period, cohort_period)
    rows = _first_day_events(users, events)
    seen = lambda column, default: F.collect_set(F.coalesce(F.col(column), F.lit(default)))
    per_user = rows.groupBy(*COHORT, "anonymous_id").agg(
        seen("_device", "unknown").alias("device"), seen("_source", "direct").alias("source"), seen("_country", "unknown").alias("geo"))
    labelled = lambda kind: F.transform(kind, lambda v: F.struct(F.lit(kind).alias("dimension"), v.alias("value")))
    values = F.concat(labelled("device"), labelled("source"), labelled("geo"))
    per_value = per_user.select(*COHORT, F.explode(values).alias("_v")).groupBy(
        *COHORT, F.col("_v.dimension").alias("dimension"), F.col("_v.value").alias("value")).agg(F.count("*").alias("users"))
    sizes = users.groupBy(*COHORT).agg(F.count("*").alias("cohort_size"))
    return per_value.join(sizes, COHORT)


def cohort_breakdowns(rows: DataFrame) -> DataFrame:
    """The same as one row per cohort with maps `<dimension>_<value>` -> users; values of a dimension are few."""
    def breakdown(kind: str) -> Column:
        entry = F.struct(F.concat(F.col("dimension"), F.lit("_"), F.col("value")), F.col("users"))
        return F.map_from_entries(F.collect_list(F.when(F.col("dimension") == kind, entry))).alias(f"{kind}_breakdown")

    return rows.groupBy(*COHORT, "cohort_size").agg(breakdown("device"), breakdown("source"), breakdown("geo"))


def cohort_totals(state: DataFrame, period: Period, cohort_period: str = "weekly") -> DataFrame:
    """Per cohort: size, conversions, final rate and mean minutes to convert."""
    done = F.col("completed_at").isNotNull()
    minutes = F.avg(F.when(done, micros_between(F.col("completed_at"), F.col("entered_at"))).cast("double"))
    return cohort_users(state, period, cohort_period).groupBy(*COHORT).agg(
        F.count("*").alias("cohort_size"), F.count_if(done).alias("conversions"),
        F.coalesce(minutes / F.lit(60e6), F.lit(0.0)).alias("average_minutes"),
    ).withColumn("final_conversion_rate", rate(F.col("conversions"), F.col("cohort_size")))


def cohort_progression(state: DataFrame, steps: DataFrame, period: Period, cohort_period: str = "weekly") -> DataFrame:
    """Per cohort and step: users who got there, retention, conversion from the step before."""
    users = cohort_users(state, period, cohort_period)
    histogram = users.groupBy(*COHORT, F.col("current_step_index").alias("order_index")).agg(
        F.count("*").alias("stopped_here"))
    totals = cohort_totals(state, period, cohort_period)
    spine = totals.join(steps.select(*FUNNEL, "order_index"), FUNNEL)
    table = spine.join(histogram, [*COHORT, "order_index"], "left")
    by_step = Window.partitionBy(*COHORT)
    beyond = by_step.orderBy(F.desc("order_index")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = table.withColumn("users", F.coalesce(F.sum("stopped_here").over(beyond), zero()))
    before = F.lag("users").over(by_step.orderBy("order_index"))
    return table.withColumn("before", before).select(
        *COHORT, F.col("order_index").cast("bigint").alias("step_order"), F.col("users").alias("users_reached"),
        rate(F.col("users"), F.col("cohort_size")).alias("retention_rate"),
        F.when(F.col("before").isNull(), F.lit(100.0)).otherwise(rate(F.col("users"), F.col("before")))
        .alias("step_conversion_rate"),
        "cohort_size", "final_conversion_rate", "average_minutes")


def retention_curve(state: DataFrame, period: Period, cohort_period: str = "weekly", offsets: int = 4) -> DataFrame:
    """Per cohort and offset k: users still active k periods after the cohort started."""
    unit = UNITS[cohort_period]
    users = cohort_users(state, period, cohort_period)
    counts = users.groupBy(*COHORT, "cohort_start").agg(F.count("*").alias("cohort_size"), *[
        F.count_if(F.col("last_activity_at") >= F.col("cohort_start") + F.expr(f"interval {k} {unit}")).alias(f"_{k}")
        for k in range(1, offsets + 1)])
    points = F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("period_offset"),
                 F.col("cohort_size" if k == 0 else f"_{k}").alias("retained_users")) for k in range(offsets + 1)])
    return counts.select(*COHORT, "cohort_size", F.explode(points).alias("_p")).select(
        *COHORT, "cohort_size", "_p.*", rate(F.col("_p.retained_users"), F.col("cohort_size"))
        .alias("retention_percentage"))


def _series(totals: DataFrame) -> DataFrame:
    """Cohort metrics as ordered series. Time series run backwards, since a shorter time is better."""
    metric = F.explode(F.array(
        F.struct(F.lit("conversion_rate").alias("metric"), F.col("final_conversion_rate").alias("value")),
        F.struct(F.lit("time_to_convert").alias("metric"), F.col("average_minutes").alias("value"))))
    rows = totals.select(*COHORT, metric.alias("_m")).select(*COHORT, "_m.*").where(
        (F.col("metric") == "conversion_rate") | (F.col("value") > 0))
    series = Window.partitionBy(*FUNNEL, "metric")
    forward = F.row_number().over(series.orderBy("cohort_period"))
    count = F.count("*").over(series)
    rows = rows.withColumns({"i": forward, "n": count})
    return rows.withColumn("i", F.when(F.col("metric") == "time_to_convert", F.col("n") + 1 - F.col("i"))
                           .otherwise(F.col("i")))


def cohort_comparison(totals: DataFrame) -> DataFrame:
    """Best and worst cohort, direction and strength of the trend, and how much cohorts vary."""
    rows = _series(totals)
    third = F.floor(F.col("n") / 3)
    lower_first = F.when(F.col("metric") == "time_to_convert", F.col("value")).otherwise(-F.col("value"))
    facts = rows.groupBy(*FUNNEL, "metric").agg(
        F.count("*").alias("n"),
        F.min(F.struct(lower_first.alias("k"), "cohort_period", "value")).alias("best"),
        F.min(F.struct((-lower_first).alias("k"), "cohort_period", "value")).alias("worst"),
        F.avg(F.when(F.col("i") <= third, F.col("value"))).alias("first_mean"),
        F.avg(F.when(F.col("i") > F.col("n") - third, F.col("value"))).alias("last_mean"),
        F.corr(F.col("i").cast("double"), F.col("value")).alias("corr"),
        F.stddev_pop("value").alias("sd"), F.avg("value").alias("mean"),
    ).where("n >= 2")
    variation = F.when(F.col("mean") != 0, F.col("sd") / F.col("mean"))
    change = F.when(F.col("first_mean") != 0, (F.col("last_mean") - F.col("first_mean")) / F.col("first_mean"))
    trend = (
        F.when(F.col("n") < 3, "stable").when(variation > VOLATILE_ABOVE, "volatile")
        .when(F.abs(change) < STABLE_BELOW, "stable").when(change > 0, "improving")
        .when(change.isNull() & (F.col("last_mean") > 0), "improving").otherwise("declining"))
    p_value = (
        F.when((variation > 0.5) | (F.col("n") < 3), F.lit(P_HIGH)).when(variation < 0.1, F.lit(P_LOW))
        .otherwise(F.least(F.lit(P_HIGH), F.greatest(F.lit(P_LOW), variation * 2))))
    strength = F.when(F.isnan("corr") | F.col("corr").isNull(), F.lit(0.0)).otherwise(F.abs("corr"))
    return facts.select(
        *FUNNEL, "metric", F.col("best.cohort_period").alias("best_cohort"), F.col("best.value").alias("best_value"),
        F.col("worst.cohort_period").alias("worst_cohort"), F.col("worst.value").alias("worst_value"),
        trend.alias("trend_direction"), strength.alias("trend_strength"),
        ((F.col("n") >= 3) & F.coalesce(variation > VARIANCE_ABOVE, F.lit(False))).alias("variance_significance"),
        p_value.alias("p_value"))


def cohort_insights(totals: DataFrame) -> DataFrame:
    """Findings about a funnel's cohorts, one row each: overall level, trend, gap and variance."""
    rows = _series(totals).where("metric = 'conversion_rate'")
    half = F.floor(F.col("n") / 2)
    facts = rows.groupBy(*FUNNEL).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("best"), F.min("value").alias("worst"),
        F.avg(F.when(F.col("i") <= half, F.col("value"))).alias("early"),
        F.avg(F.when(F.col("i") > F.col("n") - half, F.col("value"))).alias("late"))
    change = F.when(F.col("early") > 0, (F.col("late") - F.col("early")) / F.col("early") * 100)
    trend = F.when(F.abs(change) < 5, "stable").when(change > 0, "improving").otherwise("declining")
    gap = F.col("best") - F.col("worst")
    finding = lambda kind, detail, value, impact, act: F.struct(
        F.lit(kind).alias("insight"), detail.alias("detail"), value.alias("value"), impact.alias("impact_score"),
        act.alias("actionable"))
    found = F.array(
        finding("overall", F.lit("level"), F.col("mean"), F.least(F.lit(100.0), F.col("mean") * 10), F.col("mean") < 5),
        F.when((F.col("n") >= 3) & change.isNotNull(), finding(
            "trend", trend, change, F.abs(change) * 5, trend == "declining")),
        F.when(gap > GAP_ABOVE, finding("gap", F.lit("best_to_worst"), gap, F.least(F.lit(100.0), gap * 5), F.lit(True))),
    )
    general = facts.select(*FUNNEL, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_f")).select(
        *FUNNEL, "_f.*")
    variance = cohort_comparison(totals).where("variance_significance and p_value < 0.05").select(
        *FUNNEL, F.lit("variance").alias("insight"), F.col("metric").alias("detail"), F.col("p_value").alias("value"),
        ((F.lit(1.0) - F.col("p_value")) * 100).alias("impact_score"), F.lit(True).alias("actionable"))
    return general.unionByName(variance)

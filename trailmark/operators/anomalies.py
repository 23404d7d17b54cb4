"""Bottlenecks against history, control-chart and trend anomalies, and recommendations from both.

Series here are funnel time series: hundreds of points per funnel, never events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import banded, round_half_up
from trailmark.params import FUNNEL

# Least drop %, least time increase % and significance level by sensitivity.
SENSITIVITY = {"low": (25.0, 50.0, 0.01), "medium": (15.0, 30.0, 0.05), "high": (10.0, 20.0, 0.1)}
DROP_SEVERITY = [(150.0, "critical"), (75.0, "high"), (25.0, "medium")]
TIME_SEVERITY = [(1.5, "critical"), (1.0, "high"), (0.5, "medium")]
SPC_SEVERITY = [(20.0, "critical"), (10.0, "high"), (5.0, "medium")]
TREND_SEVERITY = [(0.1, "high"), (0.05, "medium")]
SPC_MIN_POINTS, TREND_MIN_POINTS, MAX_SLOPE_WINDOW = 24, 12, 6
SEVERITY_ORDER = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def compare_windows(current: DataFrame, historical: DataFrame) -> DataFrame:
    """Step metrics of two windows side by side with the drop, its pseudo p-value and the time increase."""
    keys = [*FUNNEL, "step_order"]
    old = historical.select(
        *keys, F.col("total_entries").alias("old_entries"), F.col("conversion_rate").alias("old_rate"),
        F.col("avg_completion_seconds").alias("old_seconds"))
    rows = current.join(old, keys)
    p1, p2 = F.col("conversion_rate") / 100, F.col("old_rate") / 100
    n1, n2 = F.col("total_entries"), F.col("old_entries")
    pooled = F.when(n1 + n2 > 0, (p1 * n1 + p2 * n2) / (n1 + n2))
    error = F.when((n1 > 0) & (n2 > 0), F.sqrt(F.greatest(
        F.lit(0.0), pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))))
    t = F.when(error > 0, F.abs(p1 - p2) / error)
    spent, before = F.col("avg_completion_seconds"), F.col("old_seconds")
    return rows.withColumns({
        "drop_pct": F.when(F.col("old_rate") > 0, (F.col("old_rate") - F.col("conversion_rate")) / F.col("old_rate") * 100)
        .otherwise(F.lit(0.0)),
        "p_value": F.when(error == 0, F.lit(1.0)).otherwise(
            F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.exp(t * -2)))),
        "time_increase_pct": F.when((spent > 0) & (before > 0), (spent - before) / before * 100),
    })


def bottlenecks(compared: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Steps whose rate fell significantly, or whose time to complete rose, against history."""
    least_drop, least_time, level = SENSITIVITY[sensitivity]
    drop, users = F.col("drop_pct"), F.col("total_entries")
    rise, spent = F.col("time_increase_pct"), F.col("avg_completion_seconds")
    finding = lambda kind, severity, confidence, lost: F.struct(
        F.lit(kind).alias("detection_type"), severity.alias("severity"), confidence.alias("confidence"),
        lost.alias("lost_conversions"))
    found = F.array(
        F.when((drop >= least_drop) & (F.col("p_value") <= level), finding(
            "conversion_drop", banded(drop * F.log10(F.greatest(users, F.lit(10))), DROP_SEVERITY, "low"),
            F.least(F.lit(100.0), (F.lit(1.0) - F.col("p_value")) * 100), round_half_up(drop / 100 * users, 0))),
        F.when(rise >= least_time, finding(
            "time_stuck", banded(rise / 100 * F.log10(F.greatest(spent, F.lit(10.0))), TIME_SEVERITY, "low"),
            F.least(F.lit(100.0), rise / 20 * 100), round_half_up(rise / 100 * users * 0.1, 0))),
    )
    rows = compared.withColumn("_f", F.explode(F.filter(found, lambda f: f.isNotNull()))).select(
        *FUNNEL, "step_order", "step_label", "_f.*", "conversion_rate", "old_rate", "drop_pct", "time_increase_pct",
        F.col("total_entries").alias("users_affected"), "p_value")
    weight = F.create_map(*[F.lit(x) for pair in SEVERITY_ORDER.items() for x in pair])
    order = Window.partitionBy(*FUNNEL).orderBy(
        F.desc(F.element_at(weight, F.col("severity"))), F.desc("confidence"), "step_order", "detection_type")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint"))


def _points(series: DataFrame) -> DataFrame:
    """Series (funnel, period_start, conversion_rate, entries) with position and length."""
    whole = Window.partitionBy(*FUNNEL)
    return series.withColumns({"i": F.row_number().over(whole.orderBy("period_start")), "n": F.count("*").over(whole)})


def spc_anomalies(series: DataFrame) -> DataFrame:
    """Runs of at least two points beyond three standard deviations, closed by a normal point."""
    whole = Window.partitionBy(*FUNNEL)
    y = F.col("conversion_rate")
    rows = _points(series).where(F.col("n") >= SPC_MIN_POINTS).withColumns({
        "mean": F.avg("conversion_rate").over(whole), "sd": F.stddev_pop("conversion_rate").over(whole)})
    rows = rows.withColumn("outside", (y > F.col("mean") + F.col("sd") * 3) | (y < F.col("mean") - F.col("sd") * 3))
    run = F.col("i") - F.row_number().over(Window.partitionBy(*FUNNEL, "outside").orderBy("i"))
    runs = rows.withColumn("run", run).where("outside").groupBy(*FUNNEL, "run").agg(
        F.min("period_start").alias("started_at"), F.max("period_start").alias("ended_at"), F.count("*").alias("points"),
        F.max("i").alias("last"), F.first("n").alias("n"), F.avg("conversion_rate").alias("anomalous_value"),
        F.sum("entries").alias("affected_users"), F.first("mean").alias("baseline_value"), F.first("sd").alias("sd"),
    ).where((F.col("points") >= 2) & (F.col("last") < F.col("n")))
    hours = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(3600e6)
    magnitude = F.try_divide(F.abs(F.col("anomalous_value") - F.col("baseline_value")), F.col("sd"))
    return runs.select(
        *FUNNEL, "started_at", "ended_at", hours.alias("duration_hours"), magnitude.alias("magnitude"),
        F.when(F.col("anomalous_value") < F.col("baseline_value"), "sudden_drop").otherwise("spike").alias("type"),
        banded(magnitude * F.log10(hours + 1) * F.log10(F.col("points") + 1), SPC_SEVERITY, "low").alias("severity"),
        F.least(F.lit(100.0), magnitude * 20).alias("confidence"), "affected_users", "baseline_value", "anomalous_value")


def trend_anomalies(series: DataFrame) -> DataFrame:
    """Sudden drops and gradual declines of the slope over a rolling window of a quarter of the series, at most 6."""
    rows = _points(series).where(F.col("n") >= TREND_MIN_POINTS)
    by_time = Window.partitionBy(*FUNNEL).orderBy("i")
    width = F.least(F.lit(MAX_SLOPE_WINDOW), F.floor(F.col("n") / 4))
    x = F.col("i").cast("double")
    slope = end_at = end_value = end_users = None
    for w in range(TREND_MIN_POINTS // 4, MAX_SLOPE_WINDOW + 1):
        frame = by_time.rowsBetween(0, w - 1)
        chosen = (width == w) & (F.col("i") + w - 1 <= F.col("n"))
        values = (F.regr_slope(F.col("conversion_rate"), x).over(frame), F.lead("period_start", w - 1).over(by_time),
                  F.lead("conversion_rate", w - 1).over(by_time), F.lead("entries", w - 1).over(by_time))
        if slope is None:
            slope, end_at, end_value, end_users = (F.when(chosen, v) for v in values)
        else:
            slope, end_at, end_value, end_users = (
                c.when(chosen, v) for c, v in zip((slope, end_at, end_value, end_users), values))
    rows = rows.withColumns({"slope": slope, "end_at": end_at, "end_value": end_value, "end_users": end_users}).where(
        "slope is not null")
    rows = rows.withColumns({
        "previous": F.lag("slope").over(by_time), "before_at": F.lag("period_start").over(by_time),
        "before_value": F.lag("conversion_rate").over(by_time)})
    change = F.abs(F.col("slope") - F.col("previous"))
    finding = lambda kind, at, value, size: F.struct(
        F.lit(kind).alias("type"), at.alias("started_at"), value.alias("baseline_value"), size.alias("magnitude"))
    found = F.array(
        F.when((change > 0.05) & (F.col("slope") < -0.02), finding(
            "sudden_drop", F.col("period_start"), F.col("conversion_rate"), change)),
        F.when((F.col("slope") < -0.01) & (F.col("previous") < -0.01), finding(
            "gradual_decline", F.col("before_at"), F.col("before_value"), F.abs("slope"))),
    )
    rows = rows.withColumn("_f", F.explode(F.filter(found, lambda f: f.isNotNull())))
    size = F.col("_f.magnitude")
    return rows.select(
        *FUNNEL, F.col("_f.started_at").alias("started_at"), F.col("end_at").alias("ended_at"),
        ((F.unix_micros("end_at") - F.unix_micros("_f.started_at")) / F.lit(3600e6)).alias("duration_hours"),
        size.alias("magnitude"), F.col("_f.type").alias("type"), banded(size, TREND_SEVERITY, "low").alias("severity"),
        F.least(F.lit(100.0), size * 200).alias("confidence"), F.col("end_users").alias("affected_users"),
        F.col("_f.baseline_value").alias("baseline_value"), F.col("end_value").alias("anomalous_value"))


def trend_analysis(series: DataFrame) -> DataFrame:
    """Direction, strength, volatility and weekly pattern of a whole series."""
    by_time = Window.partitionBy(*FUNNEL).orderBy("i")
    y = F.col("conversion_rate")
    rows = _points(series).withColumn("lagged", y * F.lag("conversion_rate", 7).over(by_time))
    facts = rows.groupBy(*FUNNEL).agg(
        F.count("*").alias("n"), F.regr_slope(y, F.col("i").cast("double")).alias("slope"), F.stddev_pop(y).alias("sd"),
        F.avg(y).alias("mean"), F.avg("lagged").alias("weekly"))
    short = F.col("n") < 7
    varied = F.coalesce(F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")) > 0.3, F.lit(False))
    seasonal = (F.col("n") >= 14) & F.coalesce(F.col("weekly") > 0.6, F.lit(False))
    return facts.select(
        *FUNNEL, F.when(short, "stable").when(varied, "volatile").when(F.abs("slope") < 0.001, "stable")
        .when(F.col("slope") > 0, "improving").otherwise("declining").alias("overall_direction"),
        F.when(short, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.abs("slope") * 1000)).alias("trend_strength"),
        seasonal.alias("seasonality_detected"), F.when(seasonal, F.lit(7)).cast("bigint").alias("cycle_length_days"))


def anomaly_context(anomalies: DataFrame) -> DataFrame:
    """Flags: touches a weekend; starts and ends within business hours (9 to 17)."""
    weekend = lambda c: F.dayofweek(c).isin(1, 7)
    working = lambda c: F.hour(c).between(9, 17)
    return anomalies.withColumns({
        "on_weekend": weekend("started_at") | weekend("ended_at"),
        "in_business_hours": working("started_at") & working("ended_at")})


def bottleneck_recommendations(found: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One recommendation per bottleneck and anomaly: priority, expected lift, confidence, days and hours."""
    critical = F.col("severity") == "critical"
    drop = F.col("detection_type") == "conversion_drop"
    row = lambda source, category, subject, priority, lift, confidence, days, difficulty, hours: [
        *FUNNEL, source.alias("source"), F.lit(category).alias("category"), subject.alias("subject"),
        priority.alias("priority"), lift.alias("lift_pct"), confidence.alias("confidence"),
        days.cast("bigint").alias("days_to_results"), difficulty.alias("difficulty"), hours.cast("bigint").alias("hours")]
    steps = found.select(*row(
        F.col("detection_type"), "ui_ux", F.col("step_label"),
        F.when(critical, "critical").when(drop & (F.col("severity") != "high"), "medium").otherwise("high"),
        F.when(drop, F.least(F.col("drop_pct") * 0.7, F.lit(25.0))).otherwise(F.lit(15.0)),
        F.when(drop, F.greatest(F.col("confidence") - 10, F.lit(60.0))).otherwise(F.col("confidence")),
        F.when(drop, 14).otherwise(7), F.when(drop & ~critical, "easy").otherwise("medium"),
        F.when(drop, F.when(critical, 40).otherwise(20)).otherwise(25)))
    points = anomalies.select(*row(
        F.lit("anomaly"), "technical", F.col("type"), F.when(critical, "critical").otherwise("high"),
        F.col("magnitude") * 10, F.col("confidence"), F.lit(3), F.lit("medium"), F.lit(16)))
    return steps.unionByName(points)

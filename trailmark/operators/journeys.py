"""User journeys and the conversion paths they form.

Journeys have any length: steps are numbered per (person, hour) and small rows per hour carry the numbers on, and a path
is known by an order-sensitive hash of all its steps, which combines before the shuffle. Only its first steps, as many as
the caller asks for, are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import labels_where, round_half_up, share
from trailmark.operators.blocks import block_of
from trailmark.operators.percentiles import distribution
from trailmark.params import SCOPE, Period

PERSON = [*SCOPE, "user_id"]
JOURNEY = [*PERSON, "anonymous_id"]
PATH = [*SCOPE, "pattern"]
PATH_KEY = [*SCOPE, "path", "pattern", "length"]

# Fixed values of the journey and path reports.
LAST_STEP_SECONDS = 60
MIN_JOURNEY_STEPS = 2
CONVERTED_STEPS = 3
MIN_PATH_USERS = 10
EFFICIENCY_WEIGHTS = {"conversion": 0.4, "speed": 0.3, "simplicity": 0.3}


def person() -> Column:
    """The lead where there is one, else the visitor."""
    return F.coalesce(F.col("lead_id").cast("string"), F.col("anonymous_id"))


def journey_steps(events: DataFrame, period: Period) -> DataFrame:
    """Every step of each person's journeys: its number among the person's (`step_order`) and the journey's steps
    (`position`), the step before it in the journey, and seconds to the person's next step."""
    inside = events.where(period.contains("timestamp")).select(
        *SCOPE, "id", "anonymous_id", person().alias("user_id"), "timestamp", F.col("event_name").alias("step_identifier"),
        F.coalesce("page.title", "event_name").alias("step_label"),
        F.when(F.col("page").isNotNull(), "page").otherwise("event").alias("step_type"))
    rows = inside.withColumn("_block", block_of(F.unix_micros("timestamp")))
    blocks = rows.groupBy(*JOURNEY, "_block").agg(
        F.count("*").alias("_n"), F.min("timestamp").alias("_first"), F.max_by("step_identifier", F.struct("timestamp", "id")).alias("_last"))
    of_person = Window.partitionBy(*PERSON)
    earlier = of_person.orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    later = of_person.orderBy(-F.col("_block")).rangeBetween(Window.unboundedPreceding, -1)
    of_journey = Window.partitionBy(*JOURNEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *JOURNEY, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_person_before"), F.min("_first").over(later).alias("_next"),
        F.coalesce(F.sum("_n").over(of_journey), F.lit(0)).alias("_journey_before"), F.last("_last").over(of_journey).alias("_from"))
    in_person = Window.partitionBy(*PERSON, "_block").orderBy("timestamp", "id")
    in_journey = Window.partitionBy(*JOURNEY, "_block").orderBy("timestamp", "id")
    steps = rows.join(carried, [*JOURNEY, "_block"]).withColumns({
        "_k": F.row_number().over(in_journey), "_before": F.lag("step_identifier").over(in_journey),
        "step_order": F.col("_person_before") + F.row_number().over(in_person),
        "_next": F.coalesce(F.lead("timestamp").over(in_person), "_next")})
    spent = (F.unix_micros("_next") - F.unix_micros("timestamp")) / F.lit(1e6)
    return steps.select(
        *JOURNEY, "step_order", (F.col("_journey_before") + F.col("_k")).alias("position"), "step_type", "step_identifier", "step_label",
        "timestamp", F.when(F.col("_k") == 1, F.col("_from")).otherwise(F.col("_before")).alias("from_step"),
        F.coalesce(spent, F.lit(float(LAST_STEP_SECONDS))).alias("time_spent_seconds"))


def user_journeys(steps: DataFrame, spelled: int) -> DataFrame:
    """One row per person and visitor with at least two steps. `path` stands for all steps in their order; `pattern` spells
    the first `spelled` of them and says how many there are if there are more."""
    label = F.concat("step_type", F.lit(":"), "step_identifier")
    place = ("position", "step_type", "step_identifier")
    rows = steps.groupBy(*JOURNEY).agg(
        F.count("*").alias("total_events"),
        (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))).alias("completion_micros"),
        F.max("step_order").alias("last_order"), F.max_by("step_identifier", "position").alias("last_step"),
        F.bit_xor(F.xxhash64(*place)).alias("_a"), F.bit_xor(F.xxhash64(F.lit("again"), *place)).alias("_b"),
        F.array_sort(F.collect_list(F.when(F.col("position") <= spelled, F.struct("position", label.alias("label"))))).alias("_spelled"),
    ).where(F.col("total_events") >= MIN_JOURNEY_STEPS)
    more = F.when(F.col("total_events") > spelled, F.concat(F.lit(" -> ("), F.col("total_events").cast("string"), F.lit(" steps)"))).otherwise("")
    return rows.select(
        *JOURNEY, "total_events", "completion_micros", "last_order", "last_step",
        ((F.col("total_events") >= CONVERTED_STEPS) & (F.col("last_order") >= CONVERTED_STEPS)).alias("converted"),
        F.concat_ws("-", F.hex("_a"), F.hex("_b")).alias("path"), F.col("total_events").alias("length"),
        F.concat(F.array_join(F.col("_spelled.label"), " -> "), more).alias("pattern"))


def path_groups(journeys: DataFrame, min_users: int = MIN_PATH_USERS) -> DataFrame:
    """Paths taken by at least `min_users` journeys: conversion, time, drop-out, scores and popularity."""
    timed = F.when(F.col("completion_micros") > 0, F.col("completion_micros"))
    facts = distribution(journeys, PATH_KEY, timed, {"median_seconds": 0.5}, min_rows=min_users,
                         sums={"conversions": F.col("converted").cast("bigint")}).withColumnsRenamed(
        {"rows": "users", "mean": "mean_seconds", "length": "path_steps"})
    rate, mean = share(F.col("conversions"), F.col("users")), F.col("mean_seconds")
    speed = F.when(mean > 0, F.greatest(F.lit(0.0), F.lit(1.0) - mean / 3600)).otherwise(F.lit(1.0))
    simplicity = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("path_steps") / 20)
    weights = EFFICIENCY_WEIGHTS
    efficiency = (F.least(rate / 100, F.lit(1.0)) * weights["conversion"] + speed * weights["speed"]
                  + simplicity * weights["simplicity"]) * 100
    velocity = F.least(F.lit(100.0), (F.greatest(F.lit(0.0), F.lit(100.0) - mean / 60) + rate) / 2)
    by_users = Window.partitionBy(*SCOPE).orderBy(F.desc("users"), "pattern", "path")
    return facts.select(
        *PATH, F.row_number().over(by_users).cast("bigint").alias("popularity_rank"), "users", "conversions",
        rate.alias("conversion_rate"), F.coalesce(mean, F.lit(0.0)).alias("avg_seconds"),
        F.coalesce("median_seconds", F.lit(0.0)).alias("median_seconds"), (F.lit(100.0) - rate).alias("dropout_rate"),
        F.coalesce(round_half_up(velocity, 0), F.lit(0.0)).alias("velocity_score"),
        round_half_up(efficiency, 0).alias("efficiency_score"), "path_steps",
    ).withColumn("path_type", F.when(F.col("popularity_rank") == 1, "primary").otherwise("alternative"))


def _popular(journeys: DataFrame, min_users: int) -> DataFrame:
    counts = journeys.groupBy(*SCOPE, "path", "length").agg(F.count("*").alias("path_users")).where(F.col("path_users") >= min_users)
    return journeys.join(counts, [*SCOPE, "path", "length"])


def path_steps(journeys: DataFrame, steps: DataFrame, min_users: int = MIN_PATH_USERS) -> DataFrame:
    """Per path and position: share that got there, mean seconds spent, bounces and exits."""
    rows = steps.join(_popular(journeys, min_users).select(*JOURNEY, "path", "pattern", "length", "path_users"), JOURNEY)
    last = F.col("position") == F.col("length")
    spent = F.when(F.col("time_spent_seconds") > 0, F.col("time_spent_seconds"))
    return rows.groupBy(*PATH_KEY, "path_users", "position", "step_type", "step_identifier").agg(
        share(F.count("*"), F.first("path_users")).alias("completion_rate"),
        F.coalesce(F.avg(spent), F.lit(0.0)).alias("avg_time_spent"),
        F.when(F.col("step_type") == "page", share(F.count_if(last), F.count("*"))).alias("bounce_rate"),
        F.count_if(last).alias("alternative_exits"),
    ).select(*PATH, F.col("position").cast("bigint").alias("step_order"), "step_type", "step_identifier",
             "completion_rate", "avg_time_spent", "bounce_rate", "alternative_exits")


def path_indicators(paths: DataFrame) -> DataFrame:
    """What a path does well, one row per indicator with its score."""
    mark = lambda name, score: F.struct(F.lit(name).alias("indicator"), score.alias("score"))
    rate, spent, lost = F.col("conversion_rate"), F.col("avg_seconds"), F.col("dropout_rate")
    found = labels_where(
        (rate > 15, mark("high_conversion", F.least(F.lit(100.0), rate * 5))),
        (spent < 300, mark("fast_completion", F.greatest(F.lit(0.0), F.lit(100.0) - spent / 6))),
        (lost < 20, mark("low_dropout", F.greatest(F.lit(0.0), F.lit(100.0) - lost * 5))),
    )
    return paths.select(*PATH, F.explode(found).alias("_i")).select(*PATH, "_i.*")


def abandonment_points(journeys: DataFrame, min_users: int = MIN_PATH_USERS) -> DataFrame:
    """Per path: the last step of journeys that did not convert."""
    return _popular(journeys, min_users).where(~F.col("converted")).groupBy(
        *PATH_KEY, "path_users", F.col("last_order").cast("bigint").alias("step_order"), F.col("last_step").alias("step_identifier")
    ).agg(F.count("*").alias("abandonment_count")).select(
        *PATH, "step_order", "step_identifier", "abandonment_count",
        share(F.col("abandonment_count"), F.col("path_users")).alias("abandonment_rate"))


def path_transitions(steps: DataFrame) -> DataFrame:
    """Moves between consecutive steps of journeys: volume, share of the outflow, branching and merging."""
    moves = steps.where(F.col("position") > 1).groupBy(*SCOPE, "from_step", F.col("step_identifier").alias("to_step")).agg(
        F.count("*").alias("moves"))
    out, into = Window.partitionBy(*SCOPE, "from_step"), Window.partitionBy(*SCOPE, "to_step")
    return moves.withColumns({
        "out_degree": F.count("*").over(out), "in_degree": F.count("*").over(into),
        "outflow_pct": share(F.col("moves"), F.sum("moves").over(out)),
        "inflow_pct": share(F.col("moves"), F.sum("moves").over(into)),
    }).withColumns({"is_branch": F.col("out_degree") > 1, "is_merge": F.col("in_degree") > 1})


def path_comparison(paths: DataFrame) -> DataFrame:
    """Best and worst path of each workspace per metric; equal values go to the smaller pattern."""
    metrics = {"conversion_rate": -1, "avg_seconds": 1, "dropout_rate": 1, "efficiency_score": -1, "users": -1}
    values = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"),
                 (F.col(name).cast("double") * sign).alias("k")) for name, sign in metrics.items()]))
    rows = paths.select(*PATH, values.alias("_v")).select(*PATH, "_v.*")
    best = F.min(F.struct("k", "pattern", "value"))
    worst = F.min(F.struct((-F.col("k")).alias("k"), "pattern", "value"))
    return rows.groupBy(*SCOPE, "metric").agg(best.alias("b"), worst.alias("w")).select(
        *SCOPE, "metric", F.col("b.pattern").alias("best_pattern"), F.col("b.value").alias("best_value"),
        F.col("w.pattern").alias("worst_pattern"), F.col("w.value").alias("worst_value"))

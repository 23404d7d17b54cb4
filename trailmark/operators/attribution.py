"""Multi-touch attribution: every model from one pass over the touches.

Touches of one journey that are alike (channel, campaign, device, referrer) get alike credit but for the first and the
last, so they combine before the shuffle to one row with their number, first, last and decayed weight. A window over
these few rows of a journey gives its totals; touches are never numbered, joined or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import share
from trailmark.operators.blocks import number_rows
from trailmark.operators.journeys import CONVERTED_STEPS, JOURNEY, PERSON, person
from trailmark.params import SCOPE, Period, timestamp

# Fixed values of the attribution report.
LOOKBACK_DAYS = 30
HALF_LIFE_DAYS = 7
POSITION_WEIGHTS = (0.4, 0.4)  # first, last; the middle shares the rest
TOP = 10

MODELS = ("first_touch", "last_touch", "linear", "time_decay", "position_based", "custom")
DIMENSIONS = ("utm_source", "utm_medium", "utm_campaign", "device_type", "referrer_domain")
TOUCH = ("touchpoint_type", *DIMENSIONS)


def touchpoint_type(utm_source: Column, referrer: Column) -> Column:
    """Channel of a touch, by campaign source first and referrer second."""
    return (
        F.when(utm_source.isNotNull(), "paid_search").when(referrer.contains("google"), "organic_search")
        .when(referrer.isNull(), "direct").when(referrer.contains("social"), "social").otherwise("referral"))


def touchpoints(events: DataFrame, period: Period, lookback_days: int = LOOKBACK_DAYS, as_of: str | None = None) -> DataFrame:
    """Each person's touches since `lookback_days` before `as_of` (the period's end by default)."""
    since = timestamp(as_of or period.end) - F.expr(f"interval {lookback_days} days")
    inside = events.where((F.col("timestamp") >= since) & (F.col("timestamp") <= timestamp(period.end)))
    source, referrer = F.col("utm.source"), F.col("page.referrer")
    rows = inside.select(
        *SCOPE, "id", "anonymous_id", "lead_id", "timestamp", touchpoint_type(source, referrer).alias("touchpoint_type"),
        source.alias("utm_source"), F.col("utm.medium").alias("utm_medium"), F.col("utm.campaign").alias("utm_campaign"),
        F.col("device.type").alias("device_type"),
        F.regexp_replace(referrer, "https?://([^/]+).*", "$1").alias("referrer_domain"))
    return rows.withColumn("user_id", person()).drop("lead_id")


def numbered_touches(touches: DataFrame, max_touches: int | None = None) -> DataFrame:
    """Touches with their place among their person's; `max_touches` keeps the first ones only."""
    numbered = number_rows(touches, PERSON).drop("previous_at").withColumnRenamed("position", "touchpoint_order")
    return numbered if max_touches is None else numbered.where(F.col("touchpoint_order") <= max_touches)


def _decayed(at: Column, until: Column) -> Column:
    """Weight of a touch: half for every half-life before `until`."""
    return F.pow(F.lit(0.5), (F.unix_micros(until) - F.unix_micros(at)) / F.lit(86_400e6) / HALF_LIFE_DAYS)


def journey_touches(touches: DataFrame, period: Period, conversions: DataFrame | None = None) -> DataFrame:
    """Alike touches of each journey whose first touch is in the period: one row per (journey, kind of touch) with their
    number `n`, `weight`, first and last, and the journey's `touches`, `first_at`, `last_at`, `weights`.

    A journey with at least three touches counts as converted; `conversions` (visitors, such as those who
    completed a funnel) replaces that rule. Rows of a journey are bounded by the kinds of touches, not by its touches.
    """
    at, until = F.struct("timestamp", "id"), timestamp(period.end)
    alike = touches.groupBy(*JOURNEY, *TOUCH).agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"),
        F.sum(_decayed(F.col("timestamp"), until)).alias("weight"))
    journey = Window.partitionBy(*JOURNEY)
    rows = alike.withColumns({
        "touches": F.sum("n").over(journey), "_first": F.min("first").over(journey), "_last": F.max("last").over(journey),
        "weights": F.sum("weight").over(journey)})
    rows = rows.withColumns({
        "has_first": F.col("first") == F.col("_first"), "has_last": (F.col("last") == F.col("_last")) & (F.col("touches") > 1),
        "first_at": F.col("_first.timestamp"), "last_at": F.col("_last.timestamp"),
        "first_weight": _decayed(F.col("_first.timestamp"), until), "last_weight": _decayed(F.col("_last.timestamp"), until)})
    rows = rows.where(period.contains("first_at")).drop("_first", "_last")
    if conversions is None:
        return rows.withColumn("converted", F.col("touches") >= CONVERTED_STEPS)
    keys = [*SCOPE, "anonymous_id"]
    done = conversions.select(*keys).distinct().withColumn("converted", F.lit(True))
    return rows.join(done, keys, "left").withColumn("converted", F.coalesce("converted", F.lit(False)))


def touchpoint_journeys(touches: DataFrame, period: Period) -> DataFrame:
    """One row per journey: touches, first and last, converted, duration, distinct channels."""
    rows = touches.groupBy(*JOURNEY).agg(
        F.count("*").alias("touches"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
        F.size(F.collect_set("touchpoint_type")).cast("bigint").alias("channels"))
    return rows.where(period.contains("first_at")).withColumns({
        "converted": F.col("touches") >= CONVERTED_STEPS,
        "duration_seconds": (F.unix_micros("last_at") - F.unix_micros("first_at")) / F.lit(1e6)})


def check_custom_weights(first: float, middle: float, last: float) -> None:
    if not all(0 <= w <= 1 for w in (first, middle, last)) or abs(first + middle + last - 1) > 0.01:
        raise ValueError("custom weights are 0 to 1 each and add up to 1")


def credits(touches: DataFrame, models: tuple[str, ...] = MODELS,
            custom: tuple[float, float, float] = (0.5, 0.2, 0.3)) -> DataFrame:
    """Credit of the alike touches of converted journeys: a column per model, and its parts from the journey's first and
    last touch (`<model>_first`, `<model>_last`).

    `custom` is (first, middle, last). With two touches the middle share is lost, in both weighted models.
    """
    check_custom_weights(*custom)
    n, one = F.col("touches"), F.lit(1.0)
    first, middle, last = (w / sum(custom) for w in custom)
    alone = lambda value: F.when(n == 1, one).otherwise(value)
    among = lambda whole: F.when(n > 2, F.lit(whole) / (n - 2)).otherwise(0.0)
    ends = F.col("has_first").cast("int") + F.col("has_last").cast("int")
    position = (*map(F.lit, POSITION_WEIGHTS), 1 - sum(POSITION_WEIGHTS))
    each = {  # credit of a first touch, of a last one, and of each between
        "first_touch": (one, F.lit(0.0), F.lit(0.0)), "last_touch": (alone(0.0), one, F.lit(0.0)),
        "linear": (one / n, one / n, one / n), "position_based": (alone(position[0]), position[1], among(position[2])),
        "custom": (alone(first), F.lit(last), among(middle))}
    columns = {}
    for m in models:
        if m == "time_decay":
            a, b = F.col("first_weight") / F.col("weights"), F.col("last_weight") / F.col("weights")
        else:
            a, b, c = each[m]
        of_first, of_last = F.when(F.col("has_first"), a).otherwise(0.0), F.when(F.col("has_last"), b).otherwise(0.0)
        rest = F.col("weight") / F.col("weights") - of_first - of_last if m == "time_decay" else (F.col("n") - ends) * c
        columns |= {m: of_first + of_last + rest, f"{m}_first": of_first, f"{m}_last": of_last}
    return touches.where("converted").withColumns(columns)


def credit_table(credited: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Credit per channel, source, medium, campaign, device and referrer, split by position.

    Touches combine to this small table before anything else; every report below reads it.
    """
    sums = [F.sum(f"{m}{part}").alias(f"{m}{part}") for m in models for part in ("", "_first", "_last")]
    return credited.groupBy(*SCOPE, *TOUCH).agg(*sums)


def _by_model(table: DataFrame, keys: list[str], models: tuple[str, ...]) -> DataFrame:
    """One row per (keys, model) with its credit; single-touch models only where they gave credit."""
    grouped = table.groupBy(*keys).agg(*[
        F.sum(f"{m}{part}").alias(f"{m}{part}") for m in models for part in ("", "_first", "_last")])
    entries = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("credit"), F.col(f"{m}_first").alias("first_credit"),
                 F.col(f"{m}_last").alias("last_credit")) for m in models]))
    rows = grouped.select(*keys, entries.alias("_e")).select(*keys, "_e.*")
    return rows.where(~F.col("model").isin("first_touch", "last_touch") | (F.col("credit") > 0))


def journey_stats(events: DataFrame, period: Period) -> DataFrame:
    """Persons, touches, conversions (distinct leads with at least 3 events) and channels of the period.

    One row per person first; the channel sets are bounded by the five channels.
    """
    inside = period.contains("timestamp")
    kind = touchpoint_type(F.col("utm.source"), F.col("page.referrer"))
    people = events.withColumn("user_id", person()).groupBy(*SCOPE, "user_id").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("inside"),
        F.bool_or(inside & F.col("lead_id").isNotNull()).alias("is_lead"),
        F.array_sort(F.collect_set(F.when(inside, kind))).alias("kinds")).where("inside > 0")
    return people.groupBy(*SCOPE).agg(
        F.count("*").alias("total_users"), F.sum("inside").alias("total_touchpoints"),
        F.count_if((F.col("n") >= CONVERTED_STEPS) & F.col("is_lead")).alias("total_conversions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("touchpoint_types"))


def attribution(table: DataFrame, stats: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Credit per touchpoint and model: share of conversions, split by position, rank and flags.

    `stats` gives `total_conversions` per workspace (journey_stats, or real funnel completions).
    """
    touch_id = F.concat_ws("_", "touchpoint_type", F.coalesce("utm_source", F.lit("direct")),
                           F.coalesce("utm_medium", F.lit("none")))
    keyed = table.withColumn("touchpoint_id", touch_id)
    rows = _by_model(keyed, [*SCOPE, "touchpoint_id", "touchpoint_type"], models)
    rows = rows.join(stats.select(*SCOPE, "total_conversions"), SCOPE)
    percent = F.when(F.col("total_conversions") > 0, F.col("credit") / F.col("total_conversions") * 100)
    split = F.col("model") != "custom"
    best = Window.partitionBy(*SCOPE, "model").orderBy(F.desc(F.round("credit", 6)), "touchpoint_id")
    return rows.select(
        *SCOPE, "model", "touchpoint_id", "touchpoint_type", "credit", percent.alias("attribution_pct"),
        F.when(split, F.col("first_credit") * 100).otherwise(0.0).alias("first_touch_pct"),
        F.when(split, (F.col("credit") - F.col("first_credit") - F.col("last_credit")) * 100).otherwise(0.0)
        .alias("middle_touch_pct"),
        F.when(split, F.col("last_credit") * 100).otherwise(0.0).alias("last_touch_pct"),
        F.row_number().over(best).cast("bigint").alias("rank"),
    ).withColumns({
        "high_converting": (F.col("rank") <= TOP) & (F.col("attribution_pct") > 10),
        "increase_investment": (F.col("rank") <= TOP) & (F.col("attribution_pct") > 15),
        "optimize_targeting": (F.col("rank") <= TOP) & (F.col("attribution_pct") < 5)})


def attr_by_dimension(table: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Credit and its share per value of each dimension and model."""
    value = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("none")).alias("value")) for d in DIMENSIONS]))
    long = table.withColumn("_d", value).select("*", "_d.*").drop("_d")
    rows = _by_model(long, [*SCOPE, "dimension", "value"], models)
    total = F.sum("credit").over(Window.partitionBy(*SCOPE, "dimension", "model"))
    return rows.select(*SCOPE, "dimension", "value", "model", "credit", share(F.col("credit"), total).alias("credit_pct"))


def attr_model_comparison(attributed: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Credit of each touchpoint side by side, with the spread between models."""
    wide = attributed.groupBy(*SCOPE, "touchpoint_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("model") == m, F.col("credit"))), F.lit(0.0)).alias(m) for m in models])
    return wide.withColumn("spread", F.greatest(*models) - F.least(*models))


def journey_complexity(journeys: DataFrame) -> DataFrame:
    """Touches and days per journey, and the share that used several channels."""
    return journeys.groupBy(*SCOPE).agg(
        F.count("*").alias("journeys"), F.avg("touches").alias("avg_touches"),
        (F.avg((F.unix_micros("last_at") - F.unix_micros("first_at")).cast("double")) / F.lit(86_400e6)).alias("avg_days"),
        share(F.count_if(F.col("channels") > 1), F.count("*")).alias("multi_channel_pct"))


def credit_distribution(table: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """Credit per channel and position."""
    rows = _by_model(table, [*SCOPE, "touchpoint_type"], models)
    part = lambda name, c: F.struct(F.lit(name).alias("position"), c.alias("credit"))
    parts = F.explode(F.array(
        part("first", F.col("first_credit")), part("last", F.col("last_credit")),
        part("middle", F.col("credit") - F.col("first_credit") - F.col("last_credit"))))
    return rows.select(*SCOPE, "model", "touchpoint_type", parts.alias("_p")).select(
        *SCOPE, "model", "touchpoint_type", "_p.*")


def credit_concentration(attributed: DataFrame) -> DataFrame:
    """Gini coefficient of credit over touchpoints and the share of the top tenth, per model."""
    group = Window.partitionBy(*SCOPE, "model")
    ascending = group.orderBy(F.round("credit", 6), F.desc("touchpoint_id"))
    rows = attributed.withColumns({"i": F.row_number().over(ascending), "n": F.count("*").over(group)})
    in_top = F.col("i") > F.col("n") - F.ceil(F.col("n") * 0.1)
    return rows.groupBy(*SCOPE, "model").agg(
        F.max("n").alias("touchpoints"),
        (F.sum(F.col("i") * F.col("credit")) * 2 / (F.max("n") * F.sum("credit"))
         - (F.max("n") + 1) / F.max("n")).alias("gini"),
        share(F.sum(F.when(in_top, F.col("credit")).otherwise(0.0)), F.sum("credit")).alias("top_tenth_pct"))

"""Traffic: overview, top events, activity, users and time series, for every workspace in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    change_percent, direction, micros_between, rate, round_half_up, share,
)
from trailmark.params import SCOPE, Period, timestamp

METRICS = ("events", "visitors", "sessions", "conversions")
# Activity levels by least number of events in a session.
ACTIVITY_LEVELS = (("high_activity", 10), ("medium_activity", 3), ("low_activity", 0))
ENGAGED_SHARE = 0.6  # fixed estimate of the engaged stage
STABLE_BELOW_PCT = 1.0
TREND_BELOW_PCT = 5.0


def _visits(events: DataFrame, keys: list[str | Column]) -> DataFrame:
    """One row per (keys, visitor, session): the exact distinct counts below then work on far fewer rows."""
    return events.groupBy(*keys, "anonymous_id", "session_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("lead_id").isNotNull()).alias("identified"))


def _traffic(visits: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    available = {
        "events": F.sum("n").alias("events"),
        "visitors": F.count_distinct("anonymous_id").alias("visitors"),
        "sessions": F.count_distinct("session_id").alias("sessions"),
        "conversions": F.count_distinct(F.when(F.col("identified"), F.col("anonymous_id"))).alias("conversions"),
    }
    return visits.groupBy(*keys).agg(*[available[m] for m in metrics])


def overview_counts(events: DataFrame, period: Period) -> DataFrame:
    """Events, visitors, sessions and visitors with a lead."""
    return _traffic(_visits(events.where(period.contains("timestamp")), SCOPE), SCOPE)


def overview_top_event(events: DataFrame, period: Period) -> DataFrame:
    """Most frequent event; equal counts go to the smaller name."""
    counts = events.where(period.contains("timestamp")).groupBy(*SCOPE, "event_name").agg(F.count("*").alias("n"))
    return counts.groupBy(*SCOPE).agg(
        F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("event_name"))).alias("_top")
    ).select(*SCOPE, F.col("_top.event_name").alias("event_name"), (-F.col("_top.minus_n")).alias("events"))


def session_events(sessions: DataFrame, events: DataFrame, period: Period) -> DataFrame:
    """Sessions started in the period with their events in the period; 0 where there are none.

    Events are reduced to one row per session before the join.
    """
    per_session = events.where(period.contains("timestamp")).groupBy(*SCOPE, "session_id").agg(
        F.count("*").alias("events"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))
    return (
        sessions.where(period.contains("started_at"))
        .join(per_session, [*SCOPE, "session_id"], "left")
        .withColumn("events", F.coalesce("events", F.lit(0).cast("bigint")))
    )


def session_metrics(sessions: DataFrame, events: DataFrame, period: Period) -> DataFrame:
    """Mean duration of sessions with more than one event, and the share of sessions with exactly one."""
    rows = session_events(sessions, events, period)
    several = F.col("events") > 1
    spent = F.when(several, micros_between(F.col("last_at"), F.col("first_at")))
    return rows.groupBy(*SCOPE).agg(
        F.count("*").alias("sessions"),
        F.coalesce(F.avg(spent.cast("double")) / F.lit(1e6), F.lit(0.0)).alias("avg_session_duration"),
        share(F.count_if(F.col("events") == 1), F.count("*")).alias("bounce_rate"),
    )


def overview(sessions: DataFrame, events: DataFrame, period: Period) -> DataFrame:
    """All KPIs of the period with the change against the previous one, from one scan of both."""
    before = period.previous()
    both = Period(before.start, period.end)
    which = F.when(period.contains("timestamp"), "current").when(before.contains("timestamp"), "previous")
    visits = _visits(events.where(both.contains("timestamp")).withColumn("which", which).where("which is not null"),
                     [*SCOPE, "which"])
    counts = _traffic(visits, [*SCOPE, "which"])
    side = lambda name, m: F.coalesce(
        F.max(F.when(F.col("which") == name, F.col(m))), F.lit(0).cast("bigint"))
    wide = counts.groupBy(*SCOPE).agg(
        *[side("current", m).alias(m) for m in METRICS],
        *[side("previous", m).alias(f"previous_{m}") for m in METRICS[:3]],
    )
    quality = session_metrics(sessions, events, period).select(
        *SCOPE, round_half_up(F.col("bounce_rate")).alias("bounce_rate"),
        round_half_up(F.col("avg_session_duration"), 1).alias("avg_session_duration"))
    top = overview_top_event(events, period).select(*SCOPE, F.col("event_name").alias("top_event"))
    joined = wide.join(quality, SCOPE, "left").join(top, SCOPE, "left")
    comparisons = []
    for metric in METRICS[:3]:
        change = change_percent(F.col(metric), F.col(f"previous_{metric}"))
        comparisons += [round_half_up(change, 1).alias(f"{metric}_change_pct"),
                        direction(change, STABLE_BELOW_PCT).alias(f"{metric}_direction")]
    return joined.select(
        *SCOPE, "events", "visitors", "sessions",
        rate(F.col("conversions"), F.col("visitors")).alias("conversion_rate"),
        F.coalesce("bounce_rate", F.lit(0.0)).alias("bounce_rate"),
        F.coalesce("avg_session_duration", F.lit(0.0)).alias("avg_session_duration"),
        F.coalesce("top_event", F.lit("N/A")).alias("top_event"),
        *[f"previous_{m}" for m in METRICS[:3]], *comparisons,
    )


def _event_stats(events: DataFrame) -> DataFrame:
    per_visitor = events.groupBy(*SCOPE, "event_name", "anonymous_id").agg(F.count("*").alias("n"))
    return per_visitor.groupBy(*SCOPE, "event_name").agg(
        F.sum("n").alias("events"), F.count("*").alias("visitors"))


def _ranked(stats: DataFrame) -> DataFrame:
    """Rank over event names of a workspace: names, not events, so a small frame."""
    by_count = Window.partitionBy(*SCOPE).orderBy(F.desc("events"), "event_name")
    return stats.withColumn("rank", F.row_number().over(by_count).cast("bigint"))


def top_events(events: DataFrame, period: Period, limit: int | None = 10) -> DataFrame:
    """Events by frequency with visitors, events per visitor and share of all events."""
    total = F.sum("events").over(Window.partitionBy(*SCOPE))
    ranked = _ranked(_event_stats(events.where(period.contains("timestamp")))).select(
        *SCOPE, "rank", "event_name", "events", "visitors",
        round_half_up(F.col("events") / F.col("visitors")).alias("avg_per_visitor"),
        rate(F.col("events"), total).alias("percentage"),
    )
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def top_events_trend(events: DataFrame, period: Period, limit: int = 10) -> DataFrame:
    """Top events with their change against the whole previous period; absent there means stable."""
    now = top_events(events, period, limit)
    before = events.where(period.previous().contains("timestamp")).groupBy(*SCOPE, "event_name").agg(
        F.count("*").alias("previous_events"))
    change = change_percent(F.col("events"), F.col("previous_events"))
    return now.join(before, [*SCOPE, "event_name"], "left").withColumns({
        "change_pct": F.coalesce(round_half_up(change, 1), F.lit(0.0)),
        "direction": F.coalesce(direction(change, TREND_BELOW_PCT), F.lit("stable")),
    }).withColumn("previous_events", F.coalesce("previous_events", F.lit(0).cast("bigint")))


def activity_levels(sessions: DataFrame, events: DataFrame, period: Period,
                    scopes: DataFrame | None = None) -> DataFrame:
    """Visitors by the activity of their sessions. Every level is present; a visitor may be in several.

    `scopes` adds workspaces without any session in the period.
    """
    level = None
    for name, least in ACTIVITY_LEVELS:
        hit = F.col("events") >= least
        level = F.when(hit, name) if level is None else level.when(hit, name)
    rows = session_events(sessions, events, period).withColumn("activity_level", level)
    per_visitor = rows.groupBy(*SCOPE, "anonymous_id", "activity_level").agg(
        F.count("*").alias("sessions"), F.sum("events").alias("events"))
    at = lambda name: F.col("activity_level") == name
    measures = [F.count_distinct("anonymous_id").alias("total")]
    for name, _ in ACTIVITY_LEVELS:
        measures += [F.count_if(at(name)).alias(f"{name}_visitors"),
                     F.try_divide(F.sum(F.when(at(name), F.col("events"))), F.sum(F.when(at(name), F.col("sessions"))))
                     .alias(f"{name}_mean")]
    facts = per_visitor.groupBy(*SCOPE).agg(*measures)
    if scopes is not None:
        facts = scopes.select(*SCOPE).distinct().join(facts, SCOPE, "left")
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("total", zero)
    levels = F.explode(F.array(*[F.struct(
        F.lit(name).alias("activity_level"), F.coalesce(f"{name}_visitors", zero).alias("visitors"),
        rate(F.coalesce(f"{name}_visitors", zero), total).alias("percentage"),
        F.coalesce(round_half_up(F.col(f"{name}_mean")), F.lit(0.0)).alias("avg_events_per_session"),
    ) for name, _ in ACTIVITY_LEVELS]))
    return facts.select(*SCOPE, levels.alias("_l")).select(*SCOPE, "_l.*")


def _visitor_facts(events: DataFrame, period: Period, first_seen: DataFrame | None = None) -> DataFrame:
    """One row per visitor of the period: identified in it, and seen before it.

    With `first_seen` (a maintained table of visitors with first_seen_at) only the period's events are read.
    """
    inside = period.contains("timestamp")
    if first_seen is not None:
        keys = [*SCOPE, "anonymous_id"]
        present = events.where(inside).groupBy(*keys).agg(F.bool_or(F.col("lead_id").isNotNull()).alias("identified"))
        return present.join(first_seen.select(*keys, "first_seen_at"), keys, "left").withColumn(
            "returning", F.coalesce(F.col("first_seen_at") < timestamp(period.start), F.lit(False)))
    return (
        events.where(F.col("timestamp") <= timestamp(period.end))
        .groupBy(*SCOPE, "anonymous_id")
        .agg(F.bool_or(inside).alias("present"),
             F.bool_or(inside & F.col("lead_id").isNotNull()).alias("identified"),
             (F.min("timestamp") < timestamp(period.start)).alias("returning"))
        .where("present")
    )


def user_summary(events: DataFrame, period: Period, first_seen: DataFrame | None = None) -> DataFrame:
    """Visitors of the period: all, identified, returning (any earlier event) and new."""
    return _visitor_facts(events, period, first_seen).groupBy(*SCOPE).agg(
        F.count("*").alias("total_visitors"), F.count_if("identified").alias("identified_leads"),
        F.count_if("returning").alias("returning_visitors"), F.count_if(~F.col("returning")).alias("new_visitors"))


def user_analytics(events: DataFrame, period: Period, first_seen: DataFrame | None = None) -> DataFrame:
    """Summary, identification rate and the visitor / engaged / identified stages, one row per stage."""
    summary = user_summary(events, period, first_seen).withColumn(
        "identification_rate", rate(F.col("identified_leads"), F.col("total_visitors")))
    stage = lambda name, n, pct: F.struct(
        F.lit(name).alias("stage"), n.cast("bigint").alias("stage_count"), pct.cast("double").alias("stage_pct"))
    stages = F.array(
        stage("visitor", F.col("total_visitors"), F.lit(100.0)),
        stage("engaged", F.floor(F.col("total_visitors") * ENGAGED_SHARE), F.lit(ENGAGED_SHARE * 100)),
        stage("identified", F.col("identified_leads"), F.col("identification_rate")),
    )
    return summary.withColumn("_s", F.explode(stages)).select(*summary.columns, "_s.*")


def timeseries(events: DataFrame, period: Period, granularity: str = "day", metrics: tuple[str, ...] = METRICS,
               timezone: str = "UTC", scopes: DataFrame | None = None) -> DataFrame:
    """Metrics per hour, day or week (from Monday) in a time zone, zeros where nothing happened.

    `scopes` adds workspaces without any event in the period.
    """
    unknown = [m for m in metrics if m not in METRICS]
    if unknown or not 1 <= len(metrics) <= len(METRICS):
        raise ValueError(f"choose 1 to {len(METRICS)} of {METRICS}, not {metrics}")
    if granularity not in ("hour", "day", "week"):
        raise ValueError(f"unknown granularity {granularity!r}")
    metrics = tuple(m for m in METRICS if m in metrics)
    local = lambda c: c if timezone == "UTC" else F.from_utc_timestamp(c, timezone)
    bucket = F.date_trunc(granularity, local(F.col("timestamp")))
    inside = events.where(period.contains("timestamp")).withColumn("period", bucket)
    if "conversions" not in metrics:
        inside = inside.withColumn("lead_id", F.lit(None).cast("bigint"))
    counts = _traffic(_visits(inside, [*SCOPE, "period"]), [*SCOPE, "period"], metrics)
    ends = [F.date_trunc(granularity, local(timestamp(t))) for t in (period.start, period.end)]
    if scopes is not None:
        quiet = scopes.select(*SCOPE).distinct().join(counts.select(*SCOPE).distinct(), SCOPE, "left_anti")
        zeros = {m: F.lit(0).cast("bigint") for m in metrics}
        counts = counts.select(*SCOPE, "period", *metrics).unionByName(quiet.withColumn("period", ends[0]).withColumns(zeros))
    return fill_gaps(counts, SCOPE, "period", metrics, *ends, granularity)


def fill_gaps(rows: DataFrame, keys: list[str], at: str, values: tuple[str, ...], start: Column, end: Column,
              unit: str) -> DataFrame:
    """Zero rows for the missing points of each key, from `start` to `end`.

    Every existing point brings the empty ones up to the next, and the first also those before it, so there is
    no calendar to join and no second look at the keys.
    """
    by_time = Window.partitionBy(*keys).orderBy(at)
    step = F.expr(f"interval 1 {unit}")
    until = F.coalesce(F.lead(at).over(by_time) - step, end)
    since = F.when(F.row_number().over(by_time) == 1, start).otherwise(F.col(at))
    points = rows.withColumn("_since", since).withColumn("_until", until).withColumn(
        "_point", F.explode(F.sequence("_since", "_until", step)))
    zero = F.lit(0).cast("bigint")
    return points.select(*keys, F.col("_point").alias(at), *[
        F.when(F.col("_point") == F.col(at), F.col(v)).otherwise(zero).alias(v) for v in values])


def event_details(events: DataFrame, period: Period, *, event_name: str | None = None,
                  anonymous_id: str | None = None, lead_id: int | None = None, session_id: str | None = None,
                  has_lead: bool | None = None) -> DataFrame:
    """Filtered events of the period in the shape of the detail listing."""
    rows = events.where(period.contains("timestamp"))
    for name, value in (("event_name", event_name), ("anonymous_id", anonymous_id), ("lead_id", lead_id),
                        ("session_id", session_id)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if has_lead is not None:
        rows = rows.where(F.col("lead_id").isNotNull() if has_lead else F.col("lead_id").isNull())
    return rows.select(
        *SCOPE, "id", F.concat(F.lit("evt_"), F.col("id").cast("string")).alias("event_id"), "event_name", "timestamp",
        "anonymous_id", F.col("lead_id").cast("string").alias("lead_id"), "session_id", "page", "utm", "device",
        "geo", "props")


def page_of(details: DataFrame, page: int = 1, limit: int = 50, sort_by: str = "timestamp",
            ascending: bool = False) -> DataFrame:
    """One page of a listing in a total order (id breaks ties)."""
    if sort_by not in ("timestamp", "event_name"):
        raise ValueError("sort by timestamp or event_name")
    order = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    return details.orderBy(order, "id").offset((page - 1) * limit).limit(limit)


def segment_filters(events: DataFrame, *, device_types: list[str] | None = None, utm_sources: list[str] | None = None,
                    countries: list[str] | None = None, user_type: str | None = None,
                    period: Period | None = None) -> DataFrame:
    """Events of the chosen devices, sources, countries and of new or returning visitors of the period.

    A visitor returns who had any event before the period, of whatever device, source or country.
    """
    history = events
    for column, values in (("device.type", device_types), ("utm.source", utm_sources), ("geo.country", countries)):
        if values:
            events = events.where(F.col(column).isin(values))
    if user_type is None:
        return events
    if period is None:
        raise ValueError("new and returning visitors need a period")
    earlier = history.where(F.col("timestamp") < timestamp(period.start)).select(*SCOPE, "anonymous_id").distinct()
    how = {"returning": "left_semi", "new": "left_anti"}[user_type]
    return events.where(period.contains("timestamp")).join(earlier, [*SCOPE, "anonymous_id"], how)


def sample_users(events: DataFrame, rate_: float) -> DataFrame:
    """A share of the visitors by the hash of their id, whole visitors only. Sampling is the feature here."""
    if not 0 < rate_ <= 1:
        raise ValueError("a sampling rate is above 0 and at most 1")
    if rate_ == 1:
        return events
    return events.where(F.substring(F.md5(F.col("anonymous_id").cast("binary")), 1, 8) < f"{int(rate_ * 16**8):08x}")


def approximate_counts(events: DataFrame, period: Period) -> DataFrame:
    """Overview counts by sketches of fixed size: one pass, nothing distinct is shuffled."""
    return events.where(period.contains("timestamp")).groupBy(*SCOPE).agg(
        F.count("*").alias("events"), F.approx_count_distinct("anonymous_id", 0.01).alias("visitors"),
        F.approx_count_distinct("session_id", 0.01).alias("sessions"))


def sampled_overview(events: DataFrame, period: Period, rate_: float) -> DataFrame:
    """Counts of a sample of the visitors, and whether the sketches of them come within 5 %."""
    sample = sample_users(events, rate_)
    exact = sample.where(period.contains("timestamp")).groupBy(*SCOPE, "anonymous_id").agg(F.count("*").alias("n")).groupBy(
        *SCOPE).agg(F.sum("n").alias("events"), F.count("anonymous_id").alias("visitors"))
    about = approximate_counts(sample, period).select(*SCOPE, F.col("visitors").alias("about"))
    close = F.abs(F.col("about") - F.col("visitors")) <= 0.05 * F.col("visitors")
    return exact.join(about, SCOPE).select(*SCOPE, "events", "visitors", close.alias("approximation_close"))

"""Traffic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.columns import round_half_up, ts_text
from trailmark.operators import traffic
from trailmark.params import SCOPE
from trailmark.plans.registry import CURRENT, WHOLE, Inputs, query
from trailmark.plans import sql
from trailmark.plans.sql import oracle, pct, rnd, tstext

COUNTS = """CAST(COUNT(*) AS BIGINT) AS events, CAST(COUNT(DISTINCT anonymous_id) AS BIGINT) AS visitors,
  CAST(COUNT(DISTINCT session_id) AS BIGINT) AS sessions,
  CAST(COUNT(DISTINCT CASE WHEN lead_id IS NOT NULL THEN anonymous_id END) AS BIGINT) AS conversions"""


@query("overview_counts", oracle("e", f"""
SELECT tenant_id, workspace_id, {COUNTS} FROM e WHERE "timestamp" {sql.WHOLE} GROUP BY 1, 2"""))
def overview_counts(i: Inputs):
    return traffic.overview_counts(i.events, WHOLE)


@query("overview_top_event", oracle("e", f"""
SELECT tenant_id, workspace_id, event_name, events FROM (
  SELECT tenant_id, workspace_id, event_name, COUNT(*) AS events,
         ROW_NUMBER() OVER (PARTITION BY tenant_id, workspace_id ORDER BY COUNT(*) DESC, event_name) AS rn
  FROM e WHERE "timestamp" {sql.WHOLE} GROUP BY 1, 2, 3) WHERE rn = 1"""))
def overview_top_event(i: Inputs):
    return traffic.overview_top_event(i.anonymous_events, WHOLE)


SESSION_STATS = """
sst AS (
  SELECT s.tenant_id, s.workspace_id, s.session_id, s.anonymous_id, COUNT(e.id) AS n,
         MIN(e."timestamp") AS first_at, MAX(e."timestamp") AS last_at
  FROM s LEFT JOIN e ON e.session_id = s.session_id AND e.tenant_id = s.tenant_id
       AND e.workspace_id = s.workspace_id AND e."timestamp" {period}
  WHERE s.started_at {period} GROUP BY 1, 2, 3, 4)"""
SESSION_QUALITY = f"""
q AS (
  SELECT tenant_id, workspace_id, COUNT(*) AS sessions,
         COALESCE({sql.avg_secs('last_at', 'first_at', 'n > 1')}, 0.0) AS avg_session_duration,
         {pct('COUNT(*) FILTER (WHERE n = 1)', 'COUNT(*)', None)} AS bounce_rate
  FROM sst GROUP BY 1, 2)"""


@query("session_metrics", oracle("s", f"""{SESSION_STATS.format(period=sql.WHOLE)}, {SESSION_QUALITY}
SELECT tenant_id, workspace_id, sessions, {rnd('avg_session_duration', 4)} AS avg_session_duration,
       {rnd('bounce_rate', 4)} AS bounce_rate FROM q"""))
def session_metrics(i: Inputs):
    return traffic.session_metrics(i.sessions, i.anonymous_events, WHOLE).select(
        *SCOPE, "sessions", round_half_up(F.col("avg_session_duration"), 4).alias("avg_session_duration"),
        round_half_up(F.col("bounce_rate"), 4).alias("bounce_rate"))


def _comparison(metric: str) -> str:
    change = f"(CASE WHEN p.{metric} > 0 THEN CAST(c.{metric} - p.{metric} AS DOUBLE) / p.{metric} * 100.0 ELSE 0.0 END)"
    return f"""p.{metric} AS previous_{metric}, {rnd(change, 1)} AS {metric}_change_pct,
      CASE WHEN abs({change}) < 1 THEN 'stable' WHEN {change} > 0 THEN 'up' ELSE 'down' END AS {metric}_direction"""


@query("overview", oracle("s", f"""{SESSION_STATS.format(period=sql.CURRENT)}, {SESSION_QUALITY},
c AS (SELECT tenant_id, workspace_id, {COUNTS} FROM e WHERE "timestamp" {sql.CURRENT} GROUP BY 1, 2),
p AS (SELECT tenant_id, workspace_id, {COUNTS} FROM e WHERE "timestamp" {sql.PREVIOUS} GROUP BY 1, 2),
t AS (SELECT tenant_id, workspace_id, event_name AS top_event FROM (
  SELECT tenant_id, workspace_id, event_name,
         ROW_NUMBER() OVER (PARTITION BY tenant_id, workspace_id ORDER BY COUNT(*) DESC, event_name) AS rn
  FROM e WHERE "timestamp" {sql.CURRENT} GROUP BY 1, 2, 3) WHERE rn = 1)
SELECT c.tenant_id, c.workspace_id, c.events, c.visitors, c.sessions,
       {pct('c.conversions', 'c.visitors')} AS conversion_rate,
       {rnd('q.bounce_rate')} AS bounce_rate, {rnd('q.avg_session_duration', 1)} AS avg_session_duration, top_event,
       {_comparison('events')}, {_comparison('visitors')}, {_comparison('sessions')}
FROM c JOIN p USING (tenant_id, workspace_id) JOIN q USING (tenant_id, workspace_id)
     JOIN t USING (tenant_id, workspace_id)"""))
def overview(i: Inputs):
    return traffic.overview(i.sessions, i.events, CURRENT)


TOP = """
  SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, workspace_id ORDER BY events DESC, event_name) AS rank,
         SUM(events) OVER (PARTITION BY tenant_id, workspace_id) AS total
  FROM (SELECT tenant_id, workspace_id, event_name, COUNT(*) AS events, COUNT(DISTINCT anonymous_id) AS visitors
        FROM e WHERE "timestamp" {period} GROUP BY 1, 2, 3)"""
TOP_COLUMNS = f"""rank, event_name, events, visitors,
  {rnd('CAST(events AS DOUBLE) / visitors')} AS avg_per_visitor, {pct('events', 'total')} AS percentage"""


@query("top_events", oracle("e", f"""t AS ({TOP.format(period=sql.WHOLE)})
SELECT tenant_id, workspace_id, {TOP_COLUMNS} FROM t WHERE rank <= 10"""))
def top_events(i: Inputs):
    return traffic.top_events(i.anonymous_events, WHOLE)


@query("top_events_trend", oracle("e", f"""
c AS ({TOP.format(period=sql.CURRENT)}), p AS ({TOP.format(period=sql.PREVIOUS)}),
j AS (SELECT c.*, p.events AS pe, CASE WHEN p.events > 0 THEN CAST(c.events - p.events AS DOUBLE) / p.events * 100.0
             ELSE 0.0 END AS change
      FROM c LEFT JOIN p ON p.tenant_id = c.tenant_id AND p.workspace_id = c.workspace_id
           AND p.event_name = c.event_name WHERE c.rank <= 10)
SELECT tenant_id, workspace_id, {TOP_COLUMNS}, COALESCE(pe, 0) AS previous_events, {rnd('change', 1)} AS change_pct,
  CASE WHEN abs(change) < 5 THEN 'stable' WHEN change > 0 THEN 'up' ELSE 'down' END AS direction FROM j"""))
def top_events_trend(i: Inputs):
    return traffic.top_events_trend(i.anonymous_events, CURRENT)


@query("activity_levels", oracle("s", f"""{SESSION_STATS.format(period=sql.WHOLE)},
c AS (SELECT *, CASE WHEN n >= 10 THEN 'high_activity' WHEN n >= 3 THEN 'medium_activity' ELSE 'low_activity' END AS lv
      FROM sst),
a AS (SELECT tenant_id, workspace_id, lv, COUNT(DISTINCT anonymous_id) AS v, AVG(n) AS avg_n FROM c GROUP BY 1, 2, 3),
t AS (SELECT tenant_id, workspace_id, COUNT(DISTINCT anonymous_id) AS total FROM c GROUP BY 1, 2),
l AS (SELECT * FROM (SELECT DISTINCT tenant_id, workspace_id FROM e),
      (VALUES ('high_activity'), ('medium_activity'), ('low_activity')) x(activity_level))
SELECT l.tenant_id, l.workspace_id, l.activity_level, CAST(COALESCE(v, 0) AS BIGINT) AS visitors,
       {pct('COALESCE(v, 0)', 'total')} AS percentage, COALESCE({rnd('avg_n')}, 0.0) AS avg_events_per_session
FROM l LEFT JOIN a ON a.tenant_id = l.tenant_id AND a.workspace_id = l.workspace_id AND a.lv = l.activity_level
     LEFT JOIN t ON t.tenant_id = l.tenant_id AND t.workspace_id = l.workspace_id"""))
def activity_levels(i: Inputs):
    return traffic.activity_levels(i.sessions, i.anonymous_events, WHOLE)


SUMMARY = f"""
pv AS (SELECT DISTINCT tenant_id, workspace_id, anonymous_id FROM e WHERE "timestamp" {sql.CURRENT}),
iv AS (SELECT DISTINCT tenant_id, workspace_id, anonymous_id FROM e
       WHERE "timestamp" {sql.CURRENT} AND lead_id IS NOT NULL),
h AS (SELECT pv.*, EXISTS (SELECT 1 FROM iv WHERE iv.anonymous_id = pv.anonymous_id
                           AND iv.workspace_id = pv.workspace_id) AS identified,
             EXISTS (SELECT 1 FROM e WHERE e.anonymous_id = pv.anonymous_id AND e.workspace_id = pv.workspace_id
                     AND e."timestamp" < TIMESTAMP '2024-01-16') AS returning_
      FROM pv),
us AS (SELECT tenant_id, workspace_id, COUNT(*) AS total_visitors,
              COUNT(*) FILTER (WHERE identified) AS identified_leads,
              COUNT(*) FILTER (WHERE returning_) AS returning_visitors,
              COUNT(*) FILTER (WHERE NOT returning_) AS new_visitors
       FROM h GROUP BY 1, 2)"""


@query("user_summary", oracle("e", f"{SUMMARY} SELECT * FROM us"))
def user_summary(i: Inputs):
    return traffic.user_summary(i.events, CURRENT)


@query("user_analytics", oracle("e", f"""{SUMMARY},
r AS (SELECT *, {pct('identified_leads', 'total_visitors')} AS identification_rate FROM us)
SELECT *, 'visitor' AS stage, total_visitors AS stage_count, 100.0::DOUBLE AS stage_pct FROM r
UNION ALL SELECT *, 'engaged', CAST(floor(total_visitors * 0.6) AS BIGINT), 60.0 FROM r
UNION ALL SELECT *, 'identified', identified_leads, identification_rate FROM r"""))
def user_analytics(i: Inputs):
    return traffic.user_analytics(i.events, CURRENT)


def _series_sql(unit: str) -> str:
    return oracle("e", f"""
d AS (SELECT tenant_id, workspace_id, date_trunc('{unit}', "timestamp") AS period, {COUNTS}
      FROM e WHERE "timestamp" {sql.WHOLE} GROUP BY 1, 2, 3),
sp AS (SELECT tenant_id, workspace_id, UNNEST(generate_series(date_trunc('{unit}', TIMESTAMP '2024-01-01'),
         date_trunc('{unit}', TIMESTAMP '2024-01-30 23:59:59.999'), INTERVAL 1 {unit})) AS period
       FROM (SELECT DISTINCT tenant_id, workspace_id FROM e))
SELECT tenant_id, workspace_id, {tstext('period')} AS period, COALESCE(events, 0) AS events,
       COALESCE(visitors, 0) AS visitors, COALESCE(sessions, 0) AS sessions, COALESCE(conversions, 0) AS conversions
FROM sp LEFT JOIN d USING (tenant_id, workspace_id, period)""")


def _series(unit: str):
    def plan(i: Inputs):
        return traffic.timeseries(i.events, WHOLE, unit).withColumn("period", ts_text(F.col("period")))

    return plan


query("timeseries", _series_sql("day"))(_series("day"))
query("timeseries_hourly", _series_sql("hour"))(_series("hour"))
query("timeseries_weekly", _series_sql("week"))(_series("week"))


@query("timeseries_timezone", oracle("e", f"""
z AS (SELECT *, timezone('America/Sao_Paulo', timezone('UTC', "timestamp")) AS local_ts FROM e),
d AS (SELECT tenant_id, workspace_id, date_trunc('day', local_ts) AS period, COUNT(*) AS events,
             COUNT(DISTINCT anonymous_id) AS visitors
      FROM z WHERE "timestamp" {sql.WHOLE} GROUP BY 1, 2, 3),
sp AS (SELECT tenant_id, workspace_id, UNNEST(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-01-30',
         INTERVAL 1 DAY)) AS period FROM (SELECT DISTINCT tenant_id, workspace_id FROM e))
SELECT tenant_id, workspace_id, {tstext('period')} AS period, COALESCE(events, 0) AS events,
       COALESCE(visitors, 0) AS visitors
FROM sp LEFT JOIN d USING (tenant_id, workspace_id, period)"""))
def timeseries_timezone(i: Inputs):
    return traffic.timeseries(i.anonymous_events, WHOLE, "day", ("events", "visitors"), "America/Sao_Paulo").withColumn(
        "period", ts_text(F.col("period")))


DETAIL_SQL = f"""id, CONCAT('evt_', CAST(id AS VARCHAR)) AS event_id, event_name, {tstext('"timestamp"')} AS "timestamp",
  anonymous_id, CAST(lead_id AS VARCHAR) AS lead_id, session_id, page_url, utm_source, device_type, geo_country, props"""


def _flat(details):
    return details.select(
        *SCOPE, "id", "event_id", "event_name", ts_text(F.col("timestamp")).alias("timestamp"), "anonymous_id",
        "lead_id", "session_id", F.col("page.url").alias("page_url"), F.col("utm.source").alias("utm_source"),
        F.col("device.type").alias("device_type"), F.col("geo.country").alias("geo_country"), "props")


@query("event_details", oracle("e", f"""
SELECT tenant_id, workspace_id, {DETAIL_SQL} FROM e
WHERE "timestamp" {sql.WHOLE} AND event_name = 'purchase' AND lead_id IS NOT NULL"""))
def event_details(i: Inputs):
    return _flat(traffic.event_details(i.events, WHOLE, event_name="purchase", has_lead=True))


@query("event_details_page", oracle("e", f"""
SELECT tenant_id, workspace_id, {DETAIL_SQL} FROM (
  SELECT * FROM e WHERE "timestamp" {sql.WHOLE} ORDER BY "timestamp" DESC, id LIMIT 50 OFFSET 50)"""))
def event_details_page(i: Inputs):
    return _flat(traffic.page_of(traffic.event_details(i.events, WHOLE), page=2, limit=50))


@query("segment_filters", oracle("e", f"""
SELECT tenant_id, workspace_id, event_name, COUNT(*) AS events FROM e
WHERE device_type IN ('desktop', 'mobile') AND utm_source IN ('google', 'email') AND geo_country IN ('BR', 'US', 'DE')
GROUP BY 1, 2, 3"""))
def segment_filters(i: Inputs):
    chosen = traffic.segment_filters(i.anonymous_events, device_types=["desktop", "mobile"],
                                     utm_sources=["google", "email"], countries=["BR", "US", "DE"])
    return chosen.groupBy(*SCOPE, "event_name").agg(F.count("*").alias("events"))


@query("join_exists", oracle("e", f"""
n AS (SELECT id, EXISTS (SELECT 1 FROM e x WHERE x.anonymous_id = e.anonymous_id AND x.workspace_id = e.workspace_id
              AND x."timestamp" < TIMESTAMP '2024-01-16') AS ret, tenant_id, workspace_id FROM e
      WHERE "timestamp" {sql.CURRENT})
SELECT tenant_id, workspace_id, CASE WHEN ret THEN 'returning' ELSE 'new' END AS user_type, COUNT(*) AS events
FROM n GROUP BY 1, 2, 3"""))
def join_exists(i: Inputs):
    kinds = [
        traffic.segment_filters(i.anonymous_events, user_type=kind, period=CURRENT).groupBy(*SCOPE)
        .agg(F.count("*").alias("events")).withColumn("user_type", F.lit(kind))
        for kind in ("new", "returning")
    ]
    return kinds[0].unionByName(kinds[1])


@query("sampling", oracle("e", f"""
SELECT tenant_id, workspace_id, COUNT(*) AS events, COUNT(DISTINCT anonymous_id) AS visitors, TRUE AS approximation_close
FROM e WHERE substr(md5(anonymous_id), 1, 8) < '80000000' AND "timestamp" {sql.WHOLE} GROUP BY 1, 2"""))
def sampling(i: Inputs):
    return traffic.sampled_overview(i.anonymous_events, WHOLE, 0.5)

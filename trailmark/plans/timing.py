"""Cohort and timing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.columns import round_half_up
from trailmark.operators import cohorts, timing
from trailmark.plans import sql
from trailmark.plans.conversion import G
from trailmark.plans.registry import WHOLE, Inputs, query
from trailmark.plans.sql import oracle, pct, rnd


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in columns})


WEEK = "CONCAT(year({0}), '-W', lpad(CAST((dayofyear({0}) - 1) // 7 + 1 AS VARCHAR), 2, '0'))"
CU = f"""
cu AS (SELECT *, {WEEK.format("date_trunc('week', entered_at)")} AS cohort_period,
              date_trunc('week', entered_at) AS cohort_start FROM st WHERE entered_at {sql.WHOLE})"""
CUD = f"""
cu AS (SELECT *, strftime(entered_at, '%Y-%m-%d') AS cohort_period, date_trunc('day', entered_at) AS cohort_start
       FROM st WHERE entered_at {sql.WHOLE})"""
JOINED = """
je AS (SELECT cu.*, e.id AS eid, device_type, utm_source, geo_country FROM cu LEFT JOIN e
       ON e.anonymous_id = cu.anonymous_id AND e.tenant_id = cu.tenant_id AND e.workspace_id = cu.workspace_id
       AND e."timestamp" >= entered_at AND e."timestamp" <= entered_at + INTERVAL 1 DAY)"""


@query("join_cohort_window", oracle("st", f"""{CU}, {JOINED}
SELECT {G}, cohort_period, COUNT(DISTINCT anonymous_id) AS users, COUNT(eid) AS events,
       COUNT(*) FILTER (WHERE eid IS NULL) AS without_events FROM je GROUP BY 1, 2, 3, 4"""))
def cohort_window(i: Inputs):
    return cohorts.cohort_window(i.state, i.anonymous_events, WHOLE)


@query("cohorts", oracle("st", f"""{CU}, {JOINED},
v AS (SELECT {G}, cohort_period, anonymous_id, 'device' AS dimension, COALESCE(device_type, 'unknown') AS value FROM je
      UNION ALL SELECT {G}, cohort_period, anonymous_id, 'source', COALESCE(utm_source, 'direct') FROM je
      UNION ALL SELECT {G}, cohort_period, anonymous_id, 'geo', COALESCE(geo_country, 'unknown') FROM je),
sz AS (SELECT {G}, cohort_period, COUNT(*) AS cohort_size FROM cu GROUP BY 1, 2, 3, 4)
SELECT {G}, cohort_period, dimension, value, COUNT(DISTINCT anonymous_id) AS users, cohort_size
FROM v JOIN sz USING ({G}, cohort_period) GROUP BY 1, 2, 3, 4, 5, 6, 8"""))
def cohort_makeup(i: Inputs):
    return cohorts.cohorts(i.state, i.anonymous_events, WHOLE)


TOTALS = f"""
ct AS (SELECT {G}, cohort_period, COUNT(*) AS cohort_size, COUNT(completed_at) AS conversions,
         COALESCE(AVG(CAST(epoch_us(completed_at) - epoch_us(entered_at) AS DOUBLE)) / 60e6, 0.0) AS average_minutes,
         {pct('COUNT(completed_at)', 'COUNT(*)')} AS final_conversion_rate FROM cu GROUP BY 1, 2, 3, 4)"""


@query("cohort_progression", oracle("st", f"""{CU}, {TOTALS},
x AS (SELECT ct.*, CAST(order_index AS BIGINT) AS step_order, (SELECT COUNT(*) FROM cu WHERE cu.funnel_id = ct.funnel_id
        AND cu.cohort_period = ct.cohort_period AND current_step_index >= order_index) AS users_reached
      FROM ct JOIN (SELECT funnel_id AS fid, order_index FROM steps) s ON s.fid = ct.funnel_id),
l AS (SELECT *, LAG(users_reached) OVER (PARTITION BY funnel_id, cohort_period ORDER BY step_order) AS pv FROM x)
SELECT {G}, cohort_period, step_order, users_reached, {pct('users_reached', 'cohort_size')} AS retention_rate,
  CASE WHEN pv IS NULL THEN 100.0 ELSE {pct('users_reached', 'pv')} END AS step_conversion_rate, cohort_size,
  final_conversion_rate, {rnd('average_minutes', 4)} AS average_minutes FROM l"""))
def progression(i: Inputs):
    return rounded(cohorts.cohort_progression(i.state, i.steps, WHOLE), 4, "average_minutes")


@query("retention_curve", oracle("st", f"""{CUD},
k AS (SELECT UNNEST([0, 1, 2, 3, 4]) AS k),
sz AS (SELECT {G}, cohort_period, cohort_start, COUNT(*) AS cohort_size FROM cu GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT sz.*, k, (SELECT COUNT(DISTINCT anonymous_id) FROM cu WHERE cu.funnel_id = sz.funnel_id
        AND cu.cohort_start = sz.cohort_start AND (k = 0 OR last_activity_at >= sz.cohort_start + k * INTERVAL 1 DAY))
        AS retained_users FROM sz, k)
SELECT {G}, cohort_period, cohort_size, CAST(k AS BIGINT) AS period_offset, retained_users,
  {pct('retained_users', 'cohort_size')} AS retention_percentage FROM r"""))
def retention(i: Inputs):
    return cohorts.retention_curve(i.state, WHOLE, "daily")


SERIES = f"""{CUD}, {TOTALS},
sr AS (SELECT {G}, cohort_period, 'conversion_rate' AS metric, final_conversion_rate AS v,
              ROW_NUMBER() OVER (PARTITION BY funnel_id ORDER BY cohort_period) AS i FROM ct
       UNION ALL SELECT {G}, cohort_period, 'time_to_convert', average_minutes,
              ROW_NUMBER() OVER (PARTITION BY funnel_id ORDER BY cohort_period DESC) FROM ct WHERE average_minutes > 0),
sn AS (SELECT *, COUNT(*) OVER (PARTITION BY funnel_id, metric) AS n,
              CASE WHEN metric = 'conversion_rate' THEN -v ELSE v END AS k FROM sr),
cc AS (SELECT {G}, metric, COUNT(*) AS n, AVG(v) AS mean, stddev_pop(v) AS sd, corr(i, v) AS co,
         AVG(v) FILTER (WHERE i <= n // 3) AS fm, AVG(v) FILTER (WHERE i > n - n // 3) AS lm,
         (ARRAY_AGG(cohort_period ORDER BY k, cohort_period))[1] AS best_cohort, (ARRAY_AGG(v ORDER BY k))[1] AS best_value,
         (ARRAY_AGG(cohort_period ORDER BY -k, cohort_period))[1] AS worst_cohort,
         (ARRAY_AGG(v ORDER BY -k))[1] AS worst_value,
         AVG(v) FILTER (WHERE i <= n // 2) AS eh, AVG(v) FILTER (WHERE i > n - n // 2) AS lh
       FROM sn GROUP BY 1, 2, 3, 4)"""


@query("cohort_comparison", oracle("st", f"""{SERIES}
SELECT {G}, metric, best_cohort, {rnd('best_value', 4)} AS best_value, worst_cohort, {rnd('worst_value', 4)} AS worst_value,
  CASE WHEN n < 3 THEN 'stable' WHEN sd / mean > 0.3 THEN 'volatile' WHEN abs((lm - fm) / fm) < 0.05 THEN 'stable'
       WHEN lm > fm THEN 'improving' ELSE 'declining' END AS trend_direction,
  {rnd('COALESCE(abs(co), 0.0)', 6)} AS trend_strength, n >= 3 AND sd / mean > 0.2 AS variance_significance,
  {rnd('CASE WHEN sd / mean > 0.5 OR n < 3 THEN 0.95 WHEN sd / mean < 0.1 THEN 0.01 ELSE least(0.95, greatest(0.01, 2 * sd / mean)) END', 6)}
    AS p_value
FROM cc WHERE n >= 2"""))
def comparison(i: Inputs):
    rows = cohorts.cohort_comparison(cohorts.cohort_totals(i.state, WHOLE, "daily"))
    return rounded(rounded(rows, 6, "trend_strength", "p_value"), 4, "best_value", "worst_value")


@query("cohort_insights", oracle("st", f"""{SERIES},
f AS (SELECT * FROM cc WHERE metric = 'conversion_rate'),
ch AS (SELECT *, (lh - eh) / eh * 100 AS c, -0.0 AS z FROM f WHERE n >= 3 AND eh > 0),
mm AS (SELECT {G}, MAX(v) - MIN(v) AS gap FROM sr WHERE metric = 'conversion_rate' GROUP BY 1, 2, 3),
o AS (SELECT {G}, 'overall' AS insight, 'level' AS detail, mean AS value, least(100.0, mean * 10) AS impact_score,
        mean < 5 AS actionable FROM f
  UNION ALL SELECT {G}, 'trend', CASE WHEN abs(c) < 5 THEN 'stable' WHEN c > 0 THEN 'improving' ELSE 'declining' END, c,
    abs(c) * 5, abs(c) >= 5 AND c < 0 FROM ch
  UNION ALL SELECT {G}, 'gap', 'best_to_worst', gap, least(100.0, gap * 5), TRUE FROM mm WHERE gap > 10)
SELECT {G}, insight, detail, {rnd('value', 4)} AS value, {rnd('impact_score', 4)} AS impact_score, actionable FROM o"""))
def insights(i: Inputs):
    rows = cohorts.cohort_insights(cohorts.cohort_totals(i.state, WHOLE, "daily"))
    return rounded(rows, 4, "value", "impact_score")


# --------------------------------------------------------------------- timing
USERS = f"""
du AS (SELECT {G}, anonymous_id, MIN("timestamp") AS first_at, MAX("timestamp") AS last_at,
              epoch_us(MAX("timestamp")) - epoch_us(MIN("timestamp")) AS us
       FROM m WHERE "timestamp" {sql.WHOLE} GROUP BY 1, 2, 3, 4
       HAVING COUNT(DISTINCT step) = (SELECT MAX(total_steps) FROM steps WHERE steps.funnel_id = m.funnel_id)
          AND COUNT(DISTINCT step) > 1),
dp AS (SELECT * FROM du WHERE us > 0)"""


@query("timing_distribution", oracle("st", f"""{USERS},
q AS (SELECT {G}, AVG(us) / 1e6 AS mean_seconds, stddev_samp(us / 1e6) AS stddev_seconds, MIN(us) / 1e6 AS min_seconds,
        MAX(us) / 1e6 AS max_seconds, COUNT(*) AS conversions,
        quantile_cont(CAST(us AS DOUBLE), [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS p FROM dp GROUP BY 1, 2, 3)
SELECT {G}, {rnd('mean_seconds', 3)} AS mean_seconds, {rnd('stddev_seconds', 3)} AS stddev_seconds, min_seconds,
  max_seconds, conversions, {', '.join(rnd(f'p[{n}] / 1e6', 3) + f' AS p{p}' for n, p in enumerate((10, 25, 50, 75, 90, 95, 99), 1))}
FROM q"""))
def distribution(i: Inputs):
    return rounded(timing.timing_distribution(i.matched, WHOLE), 3, "mean_seconds", "stddev_seconds", *timing.PERCENTILES)


@query("timing_buckets", oracle("st", f"""{USERS},
bk AS (SELECT {G}, CASE WHEN us <= 300e6 THEN 1 WHEN us <= 900e6 THEN 2 WHEN us <= 1800e6 THEN 3 WHEN us <= 3600e6 THEN 4
         WHEN us <= 86400e6 THEN 5 WHEN us <= 604800e6 THEN 6 ELSE 7 END AS n FROM dp),
c AS (SELECT {G}, n, COUNT(*) AS user_count FROM bk GROUP BY 1, 2, 3, 4)
SELECT {G}, ['0-5min', '5-15min', '15-30min', '30-60min', '1-24h', '1-7d', '7d+'][n] AS time_bucket,
  ['0-5 minutes', '5-15 minutes', '15-30 minutes', '30-60 minutes', '1-24 hours', '1-7 days', 'Over 7 days'][n] AS time_range,
  user_count, {rnd('user_count * 100.0 / SUM(user_count) OVER (PARTITION BY funnel_id)')} AS percentage FROM c"""))
def buckets(i: Inputs):
    return timing.timing_buckets(i.matched, WHOLE)


@query("join_in_having", oracle("st", f"""{USERS}
SELECT {G}, COUNT(*) AS users FROM du GROUP BY 1, 2, 3"""))
def in_having(i: Inputs):
    return timing.completed_users(i.matched, WHOLE).groupBy("tenant_id", "workspace_id", "funnel_id").agg(
        F.count("*").alias("users"))


@query("join_step_transition", oracle("st", f"""
p AS (SELECT a.tenant_id, a.workspace_id, a.funnel_id, a.id, a.step,
        (epoch_us(b."timestamp") - epoch_us(a."timestamp")) / 1e6 AS s
      FROM m a LEFT JOIN m b ON b.funnel_id = a.funnel_id AND b.anonymous_id = a.anonymous_id AND b.step = a.step + 1
        AND b."timestamp" > a."timestamp" AND b."timestamp" <= a."timestamp" + INTERVAL 7 DAY
      WHERE a."timestamp" {sql.WHOLE})
SELECT {G}, CAST(step AS BIGINT) AS step_order, COUNT(DISTINCT id) AS events,
  COUNT(*) FILTER (WHERE s IS NULL) AS without_next, COUNT(s) AS pairs,
  {rnd('COALESCE(AVG(s), 0.0)', 2)} AS avg_pair_seconds,
  {pct('COUNT(*) - COUNT(s)', 'COUNT(*)')} AS abandonment_rate FROM p GROUP BY 1, 2, 3, 4"""))
def transitions(i: Inputs):
    return rounded(timing.step_transition_pairs(i.matched, WHOLE), 2, "avg_pair_seconds")


STEP_TIMING = f"""
nx AS (SELECT a.tenant_id, a.workspace_id, a.funnel_id, a.step, (SELECT MIN(epoch_us(b."timestamp")) FROM m b
         WHERE b.funnel_id = a.funnel_id AND b.anonymous_id = a.anonymous_id AND b.step = a.step + 1
         AND b."timestamp" > a."timestamp" AND b."timestamp" <= a."timestamp" + INTERVAL 7 DAY)
         - epoch_us(a."timestamp") AS us FROM m a WHERE a."timestamp" {sql.WHOLE}),
tm AS (SELECT {G}, CAST(step AS BIGINT) AS step_order, step_label,
  COALESCE(AVG(us) / 1e6, 0.0) AS avg_seconds, COALESCE(quantile_cont(CAST(us AS DOUBLE), 0.5) / 1e6, 0.0) AS median_seconds,
  COALESCE(quantile_cont(CAST(us AS DOUBLE), 0.9) / 1e6, 0.0) AS p90_seconds, COUNT(*) AS user_count,
  {pct('COUNT(*) - COUNT(us)', 'COUNT(*)')} AS abandonment_rate
  FROM nx JOIN (SELECT funnel_id AS fid, order_index, step_label FROM steps) s ON s.fid = nx.funnel_id AND s.order_index = nx.step
  GROUP BY 1, 2, 3, 4, 5)"""


@query("step_timing", oracle("st", f"""{STEP_TIMING}
SELECT * REPLACE ({rnd('avg_seconds', 3)} AS avg_seconds, {rnd('median_seconds', 3)} AS median_seconds,
  {rnd('p90_seconds', 3)} AS p90_seconds) FROM tm"""))
def step_timing(i: Inputs):
    return rounded(timing.step_timing(i.matched, i.steps, WHOLE), 3, "avg_seconds", "median_seconds", "p90_seconds")


def _score(x: str) -> str:
    return (f"CAST(CASE WHEN {x} <= 300 THEN 100 WHEN {x} <= 1800 THEN 85 WHEN {x} <= 3600 THEN 70 "
            f"WHEN {x} <= 86400 THEN 50 ELSE 25 END AS BIGINT)")


def _trend(unit: str) -> str:
    return f"""
vt0 AS (SELECT {G}, date_trunc('{unit}', first_at) AS p, AVG(us) / 1e6 AS avg_seconds,
          quantile_cont(CAST(us AS DOUBLE), 0.5) / 1e6 AS median_seconds, COUNT(*) AS conversion_count
        FROM dp GROUP BY 1, 2, 3, 4),
vt1 AS (SELECT *, LAG(avg_seconds) OVER (PARTITION BY funnel_id ORDER BY p) AS pv FROM vt0),
vt AS (SELECT {G}, strftime(p, '%Y-%m-%d') AS period, avg_seconds, median_seconds, conversion_count,
         {_score('avg_seconds')} AS velocity_score,
         CASE WHEN (avg_seconds - pv) / pv * 100 < -10 THEN 'improving' WHEN (avg_seconds - pv) / pv * 100 > 10
              THEN 'declining' ELSE 'stable' END AS trend_indicator FROM vt1)"""


TREND_OUT = f"""SELECT * REPLACE ({rnd('avg_seconds', 3)} AS avg_seconds, {rnd('median_seconds', 3)} AS median_seconds)
FROM vt"""


@query("velocity_trends", oracle("st", f"{USERS}, {_trend('day')} {TREND_OUT}"))
def velocity_daily(i: Inputs):
    return rounded(timing.velocity_trends(i.matched, WHOLE), 3, "avg_seconds", "median_seconds")


@query("velocity_trends_weekly", oracle("st", f"{USERS}, {_trend('week')} {TREND_OUT}"))
def velocity_weekly(i: Inputs):
    return rounded(timing.velocity_trends(i.matched, WHOLE, "weekly"), 3, "avg_seconds", "median_seconds")


SEGMENTS = f"""
sg AS (SELECT m.tenant_id, m.workspace_id, m.funnel_id, m.anonymous_id, COALESCE(device_type, 'unknown') AS device_type,
         COALESCE(utm_source, 'direct') AS traffic_source,
         CASE WHEN page_url LIKE '%mobile%' OR device_type = 'mobile' THEN 'mobile' WHEN device_type = 'desktop' THEN 'desktop'
              ELSE 'unknown' END AS platform, epoch_us(MAX("timestamp")) - epoch_us(MIN("timestamp")) AS us
       FROM m SEMI JOIN du ON du.funnel_id = m.funnel_id AND du.anonymous_id = m.anonymous_id
       WHERE "timestamp" {sql.WHOLE} GROUP BY 1, 2, 3, 4, 5, 6, 7
       HAVING COUNT(DISTINCT step) > 1 AND MAX("timestamp") > MIN("timestamp")),
sl AS (SELECT {G}, 'device_type' AS segment_name, device_type AS segment_value, us FROM sg
       UNION ALL SELECT {G}, 'traffic_source', traffic_source, us FROM sg
       UNION ALL SELECT {G}, 'platform', platform, us FROM sg),
sa AS (SELECT {G}, segment_name, segment_value, AVG(us) / 1e6 AS avg_seconds,
         quantile_cont(CAST(us AS DOUBLE), 0.5) / 1e6 AS median_seconds,
         quantile_cont(CAST(us AS DOUBLE), 0.9) / 1e6 AS p90_seconds, COUNT(*) AS conversion_count
       FROM sl GROUP BY 1, 2, 3, 4, 5 HAVING COUNT(*) >= 10),
se AS (SELECT *, {_score('avg_seconds')} AS velocity_score,
         CASE WHEN avg_seconds < 0.8::DOUBLE * mn THEN 'fast' WHEN avg_seconds > 1.2::DOUBLE * mn THEN 'slow' ELSE 'average' END
           AS performance_indicator
       FROM (SELECT *, AVG(avg_seconds) OVER (PARTITION BY funnel_id) AS mn FROM sa))"""


@query("segment_timing", oracle("st", f"""{USERS}, {SEGMENTS}
SELECT * EXCLUDE (mn) REPLACE ({rnd('avg_seconds', 3)} AS avg_seconds, {rnd('median_seconds', 3)} AS median_seconds,
  {rnd('p90_seconds', 3)} AS p90_seconds) FROM se"""))
def segment_timing(i: Inputs):
    return rounded(timing.segment_timing(i.matched, WHOLE), 3, "avg_seconds", "median_seconds", "p90_seconds")


@query("timing_insights", oracle("st", f"""{USERS}, {STEP_TIMING}, {_trend('day')}, {SEGMENTS},
ov AS (SELECT {G}, AVG(us) / 1e6 AS mean_seconds FROM dp GROUP BY 1, 2, 3),
sm AS (SELECT *, AVG(avg_seconds) OVER (PARTITION BY funnel_id) AS mt,
              AVG(abandonment_rate) OVER (PARTITION BY funnel_id) AS ml FROM tm),
rc AS (SELECT {G}, COUNT(*) AS n, COUNT(*) FILTER (WHERE trend_indicator = 'declining') AS d FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY funnel_id ORDER BY period DESC) AS rn FROM vt) WHERE rn <= 3
       GROUP BY 1, 2, 3),
ss AS (SELECT {G}, segment_value, avg_seconds, ROW_NUMBER() OVER (PARTITION BY funnel_id
         ORDER BY avg_seconds DESC, segment_name, segment_value) AS rn FROM se WHERE performance_indicator = 'slow'),
al AS (
  SELECT {G}, 'slow_funnel' AS insight, 'high' AS severity, CONCAT(CAST(CAST(floor(mean_seconds / 86400 + 0.5) AS BIGINT) AS VARCHAR), 'd')
      AS subject, mean_seconds AS value FROM ov WHERE mean_seconds > 86400
  UNION ALL SELECT {G}, 'slow_progression', CASE WHEN avg_seconds > 3 * mt THEN 'high' ELSE 'medium' END, step_label,
      avg_seconds FROM sm WHERE avg_seconds > 2 * mt
  UNION ALL SELECT {G}, 'high_abandonment', CASE WHEN abandonment_rate > 50 THEN 'high' WHEN abandonment_rate > 30
      THEN 'medium' ELSE 'low' END, step_label, abandonment_rate FROM sm
      WHERE abandonment_rate > 1.5 * ml AND abandonment_rate > 20
  UNION ALL SELECT {G}, 'declining_velocity', 'medium', 'recent periods', CAST(d AS DOUBLE) FROM rc WHERE n >= 2 AND d >= 2
  UNION ALL SELECT {G}, 'slow_segment', 'medium', segment_value, avg_seconds FROM ss WHERE rn = 1)
SELECT * REPLACE ({rnd('value', 3)} AS value) FROM al"""))
def timing_insights(i: Inputs):
    rows = timing.timing_insights(
        timing.timing_distribution(i.matched, WHOLE), timing.step_timing(i.matched, i.steps, WHOLE),
        timing.velocity_trends(i.matched, WHOLE), timing.segment_timing(i.matched, WHOLE))
    return rounded(rows, 3, "value")

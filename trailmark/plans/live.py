"""Live, progression and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.columns import ts_text
from trailmark.operators import anomalies, conversion, live
from trailmark.plans import sql
from trailmark.plans.conversion import G
from trailmark.operators.state import abandon_users, state_as_of
from trailmark.plans.registry import AS_OF, CURRENT, REGISTRY, WHOLE, Inputs, query
from trailmark.plans.sql import AS_OF as NOW
from trailmark.plans.sql import avg_secs, oracle, pct, rnd, secs, tstext
from trailmark.plans.timing import rounded

HOUR = f"({NOW} - INTERVAL 1 HOUR)"
HALF = f"({NOW} - INTERVAL 30 MINUTE)"


@query("live_basic", oracle("st", f"""
x AS (SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id,
        COUNT(DISTINCT st.anonymous_id) FILTER (WHERE status = 'active' AND last_activity_at >= {HALF}) AS active_users,
        COUNT(DISTINCT st.anonymous_id) FILTER (WHERE entered_at >= {HOUR}) AS entries_last_hour,
        COUNT(DISTINCT st.anonymous_id) FILTER (WHERE status = 'completed' AND completed_at >= {HOUR}) AS conversions_last_hour
      FROM steps LEFT JOIN st ON st.funnel_id = steps.funnel_id GROUP BY 1, 2, 3)
SELECT *, {pct('conversions_last_hour', 'entries_last_hour')} AS current_conversion_rate FROM x"""))
def live_basic(i: Inputs):
    return live.live_basic(i.state, i.steps, AS_OF)


@query("live_steps", oracle("st", f"""
SELECT {G}, CAST(current_step_index AS BIGINT) AS step_order, COUNT(*) AS current_users,
  {rnd('COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY funnel_id)')} AS percentage
FROM st WHERE status = 'active' AND last_activity_at >= {HALF} GROUP BY 1, 2, 3, 4"""))
def live_steps(i: Inputs):
    return live.live_steps(i.state, AS_OF)


@query("live_trend", oracle("st", f"""
sp AS (SELECT {G}, UNNEST(generate_series(date_trunc('minute', {HALF}), {NOW}, INTERVAL 1 MINUTE)) AS mi
       FROM (SELECT DISTINCT {G} FROM steps)),
en AS (SELECT funnel_id, date_trunc('minute', entered_at) AS mi, COUNT(*) AS entries FROM st WHERE entered_at >= {HALF} GROUP BY 1, 2),
cv AS (SELECT funnel_id, date_trunc('minute', completed_at) AS mi, COUNT(*) AS conversions FROM st
       WHERE completed_at >= {HALF} AND status = 'completed' GROUP BY 1, 2)
SELECT {G}, {tstext('mi')} AS "minute", COALESCE(entries, 0) AS entries, COALESCE(conversions, 0) AS conversions,
  {pct('COALESCE(conversions, 0)', 'COALESCE(entries, 0)')} AS conversion_rate
FROM sp LEFT JOIN en USING (funnel_id, mi) LEFT JOIN cv USING (funnel_id, mi)"""))
def live_trend(i: Inputs):
    return live.live_trend(i.state, i.steps, AS_OF).withColumn("minute", ts_text(F.col("minute")))


ANOMALY = f"""
ra0 AS (SELECT {G}, COUNT(*) FILTER (WHERE entered_at >= {HOUR}) AS current_entries,
          COUNT(*) FILTER (WHERE entered_at < {HOUR}) AS historical_entries,
          COUNT(*) FILTER (WHERE entered_at >= {HOUR} AND status = 'completed') AS c,
          COUNT(*) FILTER (WHERE entered_at < {HOUR} AND status = 'completed') AS h
        FROM st WHERE entered_at >= {NOW} - INTERVAL 24 HOUR GROUP BY 1, 2, 3),
ra1 AS (SELECT {G}, {pct('c', 'current_entries')} AS current_rate, {pct('h', 'historical_entries')} AS historical_rate,
          current_entries, historical_entries FROM ra0),
ra AS (SELECT {G}, current_rate, historical_rate, CASE WHEN historical_rate > 0
         THEN {rnd('(current_rate - historical_rate) / historical_rate * 100')} ELSE 0.0 END AS rate_change_pct,
         current_entries, historical_entries FROM ra1)"""
STUCK = f"""
su AS (SELECT {G}, CAST(current_step_index AS BIGINT) AS step_order, COUNT(*) AS users_stuck,
         {avg_secs(NOW, 'last_activity_at')} AS avg_idle_seconds, MAX({secs(NOW, 'last_activity_at')}) AS max_idle_seconds
       FROM st WHERE status = 'active' AND last_activity_at < {NOW} - INTERVAL 10 MINUTE
       GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 5)"""


@query("rate_anomaly", oracle("st", f"{ANOMALY} SELECT * FROM ra"))
def rate_anomaly(i: Inputs):
    return live.rate_anomaly(i.state, AS_OF)


# ------------------------------------------------- an instant with events after it
PAST = "2024-01-16 12:00:00"


def _past_sql(name: str) -> str:
    """The query's SQL over the events up to the instant."""
    text = REGISTRY[name].sql.replace(NOW, f"TIMESTAMP '{PAST}'")
    return text.replace("m AS (SELECT * FROM m0 WHERE step IS NOT NULL)",
                        f"""m AS (SELECT * FROM m0 WHERE step IS NOT NULL AND "timestamp" <= TIMESTAMP '{PAST}')""")


def _past(i: Inputs):
    return state_as_of(i.matched, PAST)


query("live_basic_past", _past_sql("live_basic"))(lambda i: live.live_basic(_past(i), i.steps, PAST))
query("live_steps_past", _past_sql("live_steps"))(lambda i: live.live_steps(_past(i), PAST))
query("live_trend_past", _past_sql("live_trend"))(
    lambda i: live.live_trend(_past(i), i.steps, PAST).withColumn("minute", ts_text(F.col("minute"))))
query("rate_anomaly_past", _past_sql("rate_anomaly"))(lambda i: live.rate_anomaly(_past(i), PAST))


@query("stuck_users", oracle("st", f"""{STUCK}
SELECT * REPLACE ({rnd('avg_idle_seconds', 3)} AS avg_idle_seconds) FROM su"""))
def stuck_users(i: Inputs):
    return rounded(live.stuck_users(i.state, AS_OF), 3, "avg_idle_seconds")


@query("live_alerts", oracle("st", f"""{ANOMALY}, {STUCK}
SELECT {G}, 'conversion_drop' AS type, CAST(NULL AS BIGINT) AS step_order,
  CASE WHEN rate_change_pct < -50 THEN 'critical' ELSE 'high' END AS severity,
  {rnd('historical_rate * 0.8::DOUBLE', 4)} AS threshold, current_rate AS current_value, rate_change_pct AS change_pct
FROM ra WHERE rate_change_pct < -20
UNION ALL SELECT {G}, 'bottleneck', step_order, CASE WHEN users_stuck > 20 THEN 'high' ELSE 'medium' END, 5.0,
  CAST(users_stuck AS DOUBLE), NULL FROM su"""))
def live_alerts(i: Inputs):
    return rounded(live.live_alerts(live.rate_anomaly(i.state, AS_OF), live.stuck_users(i.state, AS_OF)), 4, "threshold")


@query("user_progression", oracle("st", f"""
x AS (SELECT *, CAST(floor({secs(NOW, 'entered_at')}) AS BIGINT) AS t, {secs(NOW, 'last_activity_at')} / 3600 AS idle FROM st),
mn AS (SELECT funnel_id, current_step_index AS step_order, {avg_secs('last_activity_at', 'entered_at')} AS av FROM st GROUP BY 1, 2),
tm AS (SELECT {G}, anonymous_id, step_order, av, CASE WHEN step_order <= current_step_index
         THEN CAST(floor({secs('last_activity_at', 'entered_at')}) AS BIGINT) END AS us FROM st JOIN mn USING (funnel_id)),
jh AS (SELECT st.tenant_id, st.workspace_id, st.funnel_id, st.anonymous_id, entered_at, e.event_name, e."timestamp" AS ts0,
         page_url, utm_source, device_type, ROW_NUMBER() OVER w AS step_order, LAG(e."timestamp") OVER w AS pv
       FROM st JOIN e ON e.workspace_id = st.workspace_id AND e.anonymous_id = st.anonymous_id AND e."timestamp" >= entered_at
         AND e."timestamp" <= {NOW}
       WINDOW w AS (PARTITION BY st.funnel_id, st.anonymous_id ORDER BY e."timestamp", e.id)),
pa AS (
  SELECT {G}, anonymous_id, 'progression' AS part, CAST(current_step_index AS BIGINT) AS step_order,
    CAST(current_step_index AS BIGINT) AS current_step, {tstext('entered_at')} AS entry_time, {tstext('last_activity_at')} AS last_activity,
    CASE WHEN status = 'completed' THEN 'converted'
         WHEN epoch_us({NOW}) - epoch_us(last_activity_at) > 604800000000 THEN 'abandoned' ELSE 'in_progress' END AS conversion_status,
    t AS time_in_funnel, {rnd('current_step_index / (t / 3600.0)')} AS steps_per_hour,
    CAST(floor({secs('completed_at', 'entered_at')}) AS BIGINT) AS time_to_conversion,
    CAST(least(100, (CASE WHEN t > 86400 THEN 30 WHEN t > 14400 THEN 15 ELSE 0 END)
      + (CASE WHEN idle > 6 THEN 40 WHEN idle > 1 THEN 20 ELSE 0 END)
      + (CASE WHEN current_step_index <= 1 THEN 20 WHEN current_step_index <= 2 THEN 10 ELSE 0 END)) AS BIGINT) AS abandonment_risk
  FROM x
  UNION ALL BY NAME
  SELECT {G}, anonymous_id, 'step_timing' AS part, CAST(step_order AS BIGINT) AS step_order, {rnd('av', 3)} AS avg_seconds, us AS user_seconds,
    CASE WHEN us > 0 AND us < av * 0.8::DOUBLE THEN 'faster' WHEN us > 0 AND us > av * 1.2::DOUBLE THEN 'slower' ELSE 'average' END AS performance,
    CAST(CASE WHEN us > 0 THEN CASE WHEN us / av <= 0.5 THEN 10 WHEN us / av <= 0.8::DOUBLE THEN 25 WHEN us / av <= 1.2::DOUBLE THEN 50
      WHEN us / av <= 1.8::DOUBLE THEN 75 ELSE 90 END END AS BIGINT) AS percentile FROM tm
  UNION ALL BY NAME
  SELECT {G}, anonymous_id, 'journey_history' AS part, step_order, event_name, {tstext('ts0')} AS "timestamp", page_url, utm_source,
    device_type, CAST(floor({secs('ts0', 'entered_at')}) AS BIGINT) AS time_from_start,
    COALESCE(CAST(floor({secs('ts0', 'pv')}) AS BIGINT), 0) AS time_from_previous FROM jh)
SELECT pa.*, COALESCE(steps.step_label, CONCAT('Step ', pa.step_order)) AS step_label
FROM pa LEFT JOIN steps ON steps.funnel_id = pa.funnel_id AND steps.order_index = pa.step_order"""))
def user_progression(i: Inputs):
    rows = live.whole_progression(abandon_users(i.state, AS_OF), i.steps, i.anonymous_events, AS_OF)
    times = {c: ts_text(F.col(c)) for c in ("entry_time", "last_activity", "timestamp")}
    return rounded(rows.withColumns(times), 3, "avg_seconds")


@query("user_progression_timing", oracle("st", f"""
mn AS (SELECT funnel_id, current_step_index AS step_order, {avg_secs('last_activity_at', 'entered_at')} AS av FROM st GROUP BY 1, 2),
x AS (SELECT {G}, anonymous_id, step_order, av, CAST(floor({secs('last_activity_at', 'entered_at')}) AS BIGINT) AS us
      FROM st JOIN mn USING (funnel_id) WHERE step_order <= current_step_index)
SELECT {G}, anonymous_id, CAST(step_order AS BIGINT) AS step_order, {rnd('av', 3)} AS avg_seconds, us AS user_seconds,
  CASE WHEN us > 0 AND us < av * 0.8::DOUBLE THEN 'faster' WHEN us > 0 AND us > av * 1.2::DOUBLE THEN 'slower' ELSE 'average' END AS performance,
  CAST(CASE WHEN us > 0 THEN CASE WHEN us / av <= 0.5 THEN 10 WHEN us / av <= 0.8::DOUBLE THEN 25 WHEN us / av <= 1.2::DOUBLE THEN 50
    WHEN us / av <= 1.8::DOUBLE THEN 75 ELSE 90 END END AS BIGINT) AS percentile FROM x"""))
def progression_timing(i: Inputs):
    return rounded(live.progression_timing(i.state), 3, "avg_seconds")


@query("user_progression_history", oracle("st", f"""
x AS (SELECT st.tenant_id, st.workspace_id, st.funnel_id, st.anonymous_id, entered_at, e.event_name, e."timestamp" AS ts0,
        page_url, utm_source, device_type, ROW_NUMBER() OVER w AS step_order, LAG(e."timestamp") OVER w AS pv
      FROM st JOIN e ON e.workspace_id = st.workspace_id AND e.anonymous_id = st.anonymous_id AND e."timestamp" >= entered_at
      WINDOW w AS (PARTITION BY st.funnel_id, st.anonymous_id ORDER BY e."timestamp", e.id))
SELECT {G}, anonymous_id, step_order, event_name, {tstext('ts0')} AS "timestamp", page_url, utm_source, device_type,
  CAST(floor({secs('ts0', 'entered_at')}) AS BIGINT) AS time_from_start,
  COALESCE(CAST(floor({secs('ts0', 'pv')}) AS BIGINT), 0) AS time_from_previous FROM x"""))
def progression_history(i: Inputs):
    return live.progression_history(i.state, i.anonymous_events).withColumn("timestamp", ts_text(F.col("timestamp")))


# ------------------------------------------------------------------ anomalies
def _window(name: str, period: str) -> str:
    return f"""
{name} AS (SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id, CAST(order_index AS BIGINT) AS step_order, step_label,
   COUNT(st.anonymous_id) AS n, {pct('COUNT(CASE WHEN st.current_step_index + 1 >= order_index THEN 1 END)', 'COUNT(st.anonymous_id)', None)} AS r,
   COALESCE({avg_secs('completed_at', 'entered_at')}, 0.0) AS s
 FROM steps LEFT JOIN st ON st.funnel_id = steps.funnel_id AND entered_at {period} GROUP BY 1, 2, 3, 4, 5)"""


COMPARED = f"""{_window('wc', sql.CURRENT)}, {_window('wh', sql.PREVIOUS)},
cw0 AS (SELECT wc.*, wh.n AS hn, wh.r AS hr, wh.s AS hs, (wc.r * wc.n + wh.r * wh.n) / 100 / (wc.n + wh.n) AS pool
        FROM wc JOIN wh ON wh.funnel_id = wc.funnel_id AND wh.step_order = wc.step_order),
cw1 AS (SELECT *, sqrt(greatest(0.0, pool * (1.0 - pool) * (1.0 / n + 1.0 / hn))) AS se FROM cw0),
cw AS (SELECT *, CASE WHEN hr > 0 THEN (hr - r) / hr * 100 ELSE 0.0 END AS drop_pct,
         CASE WHEN se = 0 THEN 1.0 ELSE greatest(0.001, least(0.999, exp(-2 * abs(r / 100 - hr / 100) / se))) END AS p_value,
         CASE WHEN s > 0 AND hs > 0 THEN (s - hs) / hs * 100 END AS time_increase_pct FROM cw1)"""


def _compared(i: Inputs):
    windows = (conversion.step_metrics_window(i.state, i.steps, p) for p in (CURRENT, CURRENT.previous()))
    return anomalies.compare_windows(*windows)


@query("step_significance", oracle("st", f"""{COMPARED}
SELECT {G}, step_order, step_label, n AS total_entries, hn AS old_entries, {rnd('drop_pct', 4)} + 0.0 AS drop_pct,
  {rnd('p_value', 6)} AS p_value, {rnd('time_increase_pct', 4)} + 0.0 AS time_increase_pct FROM cw"""))
def step_significance(i: Inputs):
    rows = rounded(rounded(_compared(i), 4, "drop_pct", "time_increase_pct"), 6, "p_value")
    return rows.select("tenant_id", "workspace_id", "funnel_id", "step_order", "step_label", "total_entries", "old_entries",
                       (F.col("drop_pct") + 0.0).alias("drop_pct"), "p_value",
                       (F.col("time_increase_pct") + 0.0).alias("time_increase_pct"))


BOTTLENECKS = f"""{COMPARED},
bn0 AS (SELECT *, 'conversion_drop' AS detection_type, drop_pct * log10(greatest(n, 10)) AS k,
          least(100.0, (1.0 - p_value) * 100) AS confidence, drop_pct / 100 * n AS lost FROM cw WHERE drop_pct >= 10 AND p_value <= 0.1
        UNION ALL SELECT *, 'time_stuck', time_increase_pct / 100 * log10(greatest(s, 10.0)) * 100, least(100.0, time_increase_pct / 20 * 100),
          time_increase_pct / 100 * n * 0.1::DOUBLE FROM cw WHERE time_increase_pct >= 20),
bn AS (SELECT *, CASE WHEN k > 150 THEN 'critical' WHEN k > CASE detection_type WHEN 'conversion_drop' THEN 75 ELSE 100 END THEN 'high'
         WHEN k > CASE detection_type WHEN 'conversion_drop' THEN 25 ELSE 50 END THEN 'medium' ELSE 'low' END AS severity FROM bn0)"""


@query("bottlenecks", oracle("st", f"""{BOTTLENECKS}
SELECT {G}, step_order, step_label, detection_type, severity, {rnd('confidence', 4)} AS confidence, {rnd('lost', 0)} AS lost_conversions,
  {rnd('r', 4)} AS conversion_rate, {rnd('hr', 4)} AS old_rate, {rnd('drop_pct', 4)} + 0.0 AS drop_pct,
  {rnd('time_increase_pct', 4)} + 0.0 AS time_increase_pct, n AS users_affected, {rnd('p_value', 6)} AS p_value,
  ROW_NUMBER() OVER (PARTITION BY funnel_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2
    ELSE 1 END DESC, confidence DESC, step_order, detection_type) AS rank FROM bn"""))
def bottlenecks(i: Inputs):
    rows = rounded(anomalies.bottlenecks(_compared(i), "high"), 4, "confidence", "conversion_rate", "old_rate", "drop_pct",
                   "time_increase_pct")
    return rounded(rows, 6, "p_value").withColumns({c: F.col(c) + 0.0 for c in ("drop_pct", "time_increase_pct")})


def _series(unit: str) -> str:
    from trailmark.plans.conversion import DONE

    return f"""
sp AS (SELECT {G}, UNNEST(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:59:59.999', INTERVAL 1 {unit})) AS pt
       FROM (SELECT DISTINCT {G} FROM steps)),
en AS (SELECT funnel_id, date_trunc('{unit}', entered_at) AS pt, COUNT(*) AS entries FROM st WHERE entered_at {sql.WHOLE} GROUP BY 1, 2),
cv AS (SELECT funnel_id, date_trunc('{unit}', completed_at) AS pt, COUNT(*) AS conversions FROM st
       WHERE completed_at {sql.WHOLE} AND {DONE} GROUP BY 1, 2),
se AS (SELECT {G}, pt, COALESCE(entries, 0) AS entries, {pct('COALESCE(conversions, 0)', 'COALESCE(entries, 0)')} AS y,
         ROW_NUMBER() OVER (PARTITION BY funnel_id ORDER BY pt) AS i, COUNT(*) OVER (PARTITION BY funnel_id) AS n
       FROM sp LEFT JOIN en USING (funnel_id, pt) LEFT JOIN cv USING (funnel_id, pt))"""


SPC = f"""
lm AS (SELECT *, AVG(y) OVER (PARTITION BY funnel_id) AS mu, stddev_pop(y) OVER (PARTITION BY funnel_id) AS sd FROM se),
ou AS (SELECT *, y > mu + 3 * sd OR y < mu - 3 * sd AS o FROM lm),
rn AS (SELECT *, SUM(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY funnel_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM ou),
sa AS (SELECT {G}, MIN(pt) AS a, MAX(pt) AS b, COUNT(*) AS pts, AVG(y) AS v, CAST(SUM(entries) AS BIGINT) AS users, MAX(mu) AS mu,
         MAX(sd) AS sd, (epoch_us(MAX(pt)) - epoch_us(MIN(pt))) / 3600e6 AS h
       FROM rn WHERE o GROUP BY 1, 2, 3, g HAVING COUNT(*) >= 2 AND MAX(i) < MAX(n)),
sx AS (SELECT {G}, a AS started_at, b AS ended_at, h AS duration_hours, abs(v - mu) / sd AS magnitude,
         CASE WHEN v < mu THEN 'sudden_drop' ELSE 'spike' END AS type, abs(v - mu) / sd * log10(h + 1) * log10(pts + 1) AS sc,
         least(100.0, abs(v - mu) / sd * 20) AS confidence, users AS affected_users, mu AS baseline_value, v AS anomalous_value FROM sa),
spc AS (SELECT * EXCLUDE (sc), CASE WHEN sc > 20 THEN 'critical' WHEN sc > 10 THEN 'high' WHEN sc > 5 THEN 'medium' ELSE 'low' END
          AS severity FROM sx)"""
OUT = f"""* REPLACE ({tstext('started_at')} AS started_at, {tstext('ended_at')} AS ended_at, {rnd('magnitude', 6)} AS magnitude,
  {rnd('confidence', 4)} AS confidence, {rnd('baseline_value', 4)} AS baseline_value, {rnd('anomalous_value', 4)} AS anomalous_value)"""


def _out(df):
    rows = rounded(rounded(df, 6, "magnitude"), 4, "confidence", "baseline_value", "anomalous_value")
    return rows.withColumns({c: ts_text(F.col(c)) for c in ("started_at", "ended_at")})


def _conversions(i: Inputs, granularity: str):
    return conversion.conversion_timeseries(i.state, i.steps, WHOLE, granularity)


@query("spc_anomalies", oracle("st", f"{_series('hour')}, {SPC} SELECT {OUT} FROM spc"))
def spc(i: Inputs):
    return _out(anomalies.spc_anomalies(_conversions(i, "hourly")))


TREND = f"""
sl AS (SELECT {G}, a.i, a.pt, a.y, b.pt AS ept, b.y AS ey, b.entries AS eu, (SELECT regr_slope(c.y, c.i) FROM se c
         WHERE c.funnel_id = a.funnel_id AND c.i BETWEEN a.i AND b.i) AS slope
       FROM se a JOIN (SELECT funnel_id, i, pt, y, entries FROM se) b USING (funnel_id) WHERE b.i = a.i + least(6, a.n // 4) - 1),
lg AS (SELECT *, LAG(slope) OVER w AS ps, LAG(pt) OVER w AS ppt, LAG(y) OVER w AS py FROM sl
       WINDOW w AS (PARTITION BY funnel_id ORDER BY i)),
tx AS (SELECT {G}, 'sudden_drop' AS type, pt AS a, ept AS b, abs(slope - ps) AS magnitude, y AS bv, ey, eu FROM lg
         WHERE abs(slope - ps) > 0.05 AND slope < -0.02
       UNION ALL SELECT {G}, 'gradual_decline', ppt, ept, abs(slope), py, ey, eu FROM lg WHERE slope < -0.01 AND ps < -0.01),
tr AS (SELECT {G}, a AS started_at, b AS ended_at, (epoch_us(b) - epoch_us(a)) / 3600e6 AS duration_hours, magnitude, type,
         CASE WHEN magnitude > 0.1 THEN 'high' WHEN magnitude > 0.05 THEN 'medium' ELSE 'low' END AS severity,
         least(100.0, magnitude * 200) AS confidence, eu AS affected_users, bv AS baseline_value, ey AS anomalous_value FROM tx)"""


@query("trend_anomalies", oracle("st", f"{_series('day')}, {TREND} SELECT {OUT} FROM tr"))
def trend(i: Inputs):
    return _out(anomalies.trend_anomalies(_conversions(i, "daily")))


@query("trend_analysis", oracle("st", f"""{_series('day')},
w AS (SELECT *, y * LAG(y, 7) OVER (PARTITION BY funnel_id ORDER BY i) AS l FROM se),
f AS (SELECT {G}, COUNT(*) AS n, regr_slope(y, i) AS sl, stddev_pop(y) / AVG(y) AS cv, AVG(l) AS l FROM w GROUP BY 1, 2, 3)
SELECT {G}, CASE WHEN cv > 0.3 THEN 'volatile' WHEN abs(sl) < 0.001 THEN 'stable' WHEN sl > 0 THEN 'improving' ELSE 'declining' END
    AS overall_direction, {rnd('least(100.0, abs(sl) * 1000)', 4)} AS trend_strength,
  n >= 14 AND l > 0.6 AS seasonality_detected, CAST(CASE WHEN n >= 14 AND l > 0.6 THEN 7 END AS BIGINT) AS cycle_length_days FROM f"""))
def trend_analysis(i: Inputs):
    return rounded(anomalies.trend_analysis(_conversions(i, "daily")), 4, "trend_strength")


@query("anomaly_context", oracle("st", f"""{_series('day')}, {TREND}
SELECT {OUT}, isodow(started_at) > 5 OR isodow(ended_at) > 5 AS on_weekend,
  hour(started_at) BETWEEN 9 AND 17 AND hour(ended_at) BETWEEN 9 AND 17 AS in_business_hours FROM tr"""))
def context(i: Inputs):
    return _out(anomalies.anomaly_context(anomalies.trend_anomalies(_conversions(i, "daily"))))


@query("bottleneck_recommendations", oracle("st", f"""{BOTTLENECKS}, {_series('day')}, {TREND},
al AS (SELECT {G}, detection_type AS source, 'ui_ux' AS category, step_label AS subject,
    CASE WHEN severity = 'critical' THEN 'critical' WHEN detection_type = 'time_stuck' OR severity = 'high' THEN 'high' ELSE 'medium' END AS priority,
    CASE detection_type WHEN 'time_stuck' THEN 15.0 ELSE least(drop_pct * 0.7::DOUBLE, 25.0) END AS lift_pct,
    CASE detection_type WHEN 'time_stuck' THEN confidence ELSE greatest(confidence - 10, 60.0) END AS confidence,
    CASE detection_type WHEN 'time_stuck' THEN 7 ELSE 14 END AS days_to_results,
    CASE WHEN detection_type = 'time_stuck' OR severity = 'critical' THEN 'medium' ELSE 'easy' END AS difficulty,
    CASE WHEN detection_type = 'time_stuck' THEN 25 WHEN severity = 'critical' THEN 40 ELSE 20 END AS hours FROM bn
  UNION ALL SELECT {G}, 'anomaly', 'technical', type, 'high', magnitude * 10, confidence, 3, 'medium', 16 FROM tr)
SELECT * REPLACE ({rnd('lift_pct', 4)} AS lift_pct, {rnd('confidence', 4)} AS confidence, CAST(days_to_results AS BIGINT) AS days_to_results,
  CAST(hours AS BIGINT) AS hours) FROM al"""))
def recommendations(i: Inputs):
    found = anomalies.bottlenecks(_compared(i), "high")
    rows = anomalies.bottleneck_recommendations(found, anomalies.trend_anomalies(_conversions(i, "daily")))
    return rounded(rows, 4, "lift_pct", "confidence")

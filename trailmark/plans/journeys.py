"""Journey and path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.columns import ts_text
from trailmark.operators import journeys
from trailmark.params import SCOPE
from trailmark.plans import sql
from trailmark.plans.registry import WHOLE, Inputs, query
from trailmark.plans.sql import oracle, pct, rnd, tstext
from trailmark.plans.timing import rounded

S = "tenant_id, workspace_id"
SPELLED = 50
STEPS = f"""
fe AS (SELECT *, COALESCE(CAST(lead_id AS VARCHAR), anonymous_id) AS user_id,
              CASE WHEN page_url IS NOT NULL OR page_referrer IS NOT NULL THEN 'page' ELSE 'event' END AS step_type
       FROM e WHERE "timestamp" {sql.WHOLE}),
fr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S}, user_id ORDER BY "timestamp", id) AS step_order FROM fe),
js AS (SELECT {S}, user_id, anonymous_id, step_order, ROW_NUMBER() OVER (PARTITION BY {S}, user_id, anonymous_id ORDER BY "timestamp", id) AS pos, step_type, event_name AS step_identifier, "timestamp",
         COALESCE((epoch_us(LEAD("timestamp") OVER (PARTITION BY {S}, user_id ORDER BY "timestamp", id))
                   - epoch_us("timestamp")) / 1e6, 60.0) AS time_spent_seconds
       FROM fr),
jj AS (SELECT {S}, user_id, anonymous_id, COUNT(*) AS total_events,
         epoch_us(MAX("timestamp")) - epoch_us(MIN("timestamp")) AS us,
         COUNT(*) >= 3 AND MAX(step_order) >= 3 AS converted,
         string_agg(CONCAT(step_type, ':', step_identifier), ' -> ' ORDER BY step_order) AS path,
         string_agg(CONCAT(step_type, ':', step_identifier), ' -> ' ORDER BY step_order) FILTER (WHERE pos <= {SPELLED})
           || CASE WHEN COUNT(*) > {SPELLED} THEN ' -> (' || COUNT(*) || ' steps)' ELSE '' END AS pattern
       FROM js GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 2),
pc AS (SELECT {S}, path, COUNT(*) AS users FROM jj GROUP BY 1, 2, 3 HAVING COUNT(*) >= 10)"""


def _journeys(i: Inputs):
    return journeys.user_journeys(journeys.journey_steps(i.events, WHOLE), SPELLED)


@query("user_journeys", oracle("e", f"""{STEPS}
SELECT {S}, user_id, anonymous_id, total_events, us / 1e6 AS completion_seconds, converted, pattern FROM jj"""))
def user_journeys(i: Inputs):
    return _journeys(i).select(
        *SCOPE, "user_id", "anonymous_id", "total_events", (F.col("completion_micros") / F.lit(1e6)).alias(
            "completion_seconds"), "converted", "pattern")


@query("journey_steps", oracle("e", f"""{STEPS}
SELECT {S}, user_id, anonymous_id, step_order, step_type, step_identifier, step_identifier AS step_label,
  {tstext('"timestamp"')} AS "timestamp", time_spent_seconds FROM js"""))
def journey_steps(i: Inputs):
    return journeys.journey_steps(i.events, WHOLE).drop("position", "from_step").withColumns({
        "timestamp": ts_text(F.col("timestamp")), "step_order": F.col("step_order").cast("bigint")})


PATHS = f"""{STEPS},
pg0 AS (SELECT {S}, pattern, COUNT(*) AS users, COUNT(*) FILTER (WHERE converted) AS conversions,
          AVG(us) FILTER (WHERE us > 0) / 1e6 AS mean, quantile_cont(CAST(us AS DOUBLE), 0.5) FILTER (WHERE us > 0) / 1e6 AS med,
          MAX(total_events) AS path_steps FROM jj GROUP BY 1, 2, 3, path HAVING COUNT(*) >= 10),
pg1 AS (SELECT *, {pct('conversions', 'users', None)} AS conversion_rate,
          ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY users DESC, pattern) AS popularity_rank FROM pg0),
pg AS (SELECT {S}, pattern, popularity_rank, users, conversions, conversion_rate, COALESCE(mean, 0.0) AS avg_seconds,
  COALESCE(med, 0.0) AS median_seconds, 100.0 - conversion_rate AS dropout_rate,
  COALESCE({rnd('least(100.0, (greatest(0.0, 100.0 - mean / 60) + conversion_rate) / 2)', 0)}, 0.0) AS velocity_score,
  {rnd('''(least(conversion_rate / 100, 1.0) * 0.4::DOUBLE
     + (CASE WHEN mean > 0 THEN greatest(0.0, 1.0 - mean / 3600) ELSE 1.0 END) * 0.3::DOUBLE
     + greatest(0.0, 1.0 - path_steps / 20) * 0.3::DOUBLE) * 100''', 0)} AS efficiency_score, path_steps,
  CASE WHEN popularity_rank = 1 THEN 'primary' ELSE 'alternative' END AS path_type FROM pg1)"""


@query("path_groups", oracle("e", f"""{PATHS}
SELECT * REPLACE ({rnd('conversion_rate', 4)} AS conversion_rate, {rnd('avg_seconds', 3)} AS avg_seconds,
  {rnd('median_seconds', 3)} AS median_seconds, {rnd('dropout_rate', 4)} AS dropout_rate) FROM pg"""))
def path_groups(i: Inputs):
    rows = journeys.path_groups(_journeys(i))
    return rounded(rounded(rows, 4, "conversion_rate", "dropout_rate"), 3, "avg_seconds", "median_seconds")


@query("path_efficiency", oracle("e", f"""{PATHS}
SELECT {S}, path_type, CAST(COUNT(*) AS BIGINT) AS paths, {rnd('AVG(efficiency_score)', 4)} AS mean_efficiency,
  MAX(efficiency_score) AS best_efficiency FROM pg GROUP BY 1, 2, 3"""))
def path_efficiency(i: Inputs):
    rows = journeys.path_groups(_journeys(i)).groupBy(*SCOPE, "path_type").agg(
        F.count("*").alias("paths"), F.avg("efficiency_score").alias("mean_efficiency"),
        F.max("efficiency_score").alias("best_efficiency"))
    return rounded(rows, 4, "mean_efficiency")


@query("path_steps", oracle("e", f"""{STEPS},
x AS (SELECT js.*, jj.pattern, total_events, users
      FROM js JOIN jj ON jj.workspace_id = js.workspace_id AND jj.user_id = js.user_id AND jj.anonymous_id = js.anonymous_id
      JOIN pc ON pc.workspace_id = jj.workspace_id AND pc.path = jj.path)
SELECT {S}, pattern, pos AS step_order, step_type, step_identifier, {pct('COUNT(*)', 'MAX(users)', 4)} AS completion_rate,
  {rnd('COALESCE(AVG(time_spent_seconds) FILTER (WHERE time_spent_seconds > 0), 0.0)', 3)} AS avg_time_spent,
  CASE WHEN step_type = 'page' THEN {pct('COUNT(*) FILTER (WHERE pos = total_events)', 'COUNT(*)', 4)} END AS bounce_rate,
  COUNT(*) FILTER (WHERE pos = total_events) AS alternative_exits
FROM (SELECT x.tenant_id, x.workspace_id, x.pattern, pos, step_type, step_identifier, users, time_spent_seconds, total_events
      FROM x) GROUP BY 1, 2, 3, 4, 5, 6"""))
def path_steps(i: Inputs):
    rows = journeys.path_steps(_journeys(i), journeys.journey_steps(i.events, WHOLE))
    return rounded(rounded(rows, 4, "completion_rate", "bounce_rate"), 3, "avg_time_spent")


@query("path_indicators", oracle("e", f"""{PATHS},
x AS (SELECT {S}, pattern, 'high_conversion' AS indicator, least(100.0, conversion_rate * 5) AS score FROM pg
        WHERE conversion_rate > 15
      UNION ALL SELECT {S}, pattern, 'fast_completion', greatest(0.0, 100.0 - avg_seconds / 6) FROM pg WHERE avg_seconds < 300
      UNION ALL SELECT {S}, pattern, 'low_dropout', greatest(0.0, 100.0 - dropout_rate * 5) FROM pg WHERE dropout_rate < 20)
SELECT {S}, pattern, indicator, {rnd('score', 3)} AS score FROM x"""))
def path_indicators(i: Inputs):
    return rounded(journeys.path_indicators(journeys.path_groups(_journeys(i))), 3, "score")


@query("abandonment_points", oracle("e", f"""{STEPS},
l AS (SELECT jj.tenant_id, jj.workspace_id, jj.pattern, users,
        (SELECT (MAX(step_order), ARG_MAX(step_identifier, step_order)) FROM js WHERE js.workspace_id = jj.workspace_id
           AND js.user_id = jj.user_id AND js.anonymous_id = jj.anonymous_id) AS k
      FROM jj JOIN pc ON pc.workspace_id = jj.workspace_id AND pc.path = jj.path WHERE NOT converted)
SELECT {S}, pattern, CAST(k[1] AS BIGINT) AS step_order, k[2] AS step_identifier, COUNT(*) AS abandonment_count,
  {pct('COUNT(*)', 'MAX(users)', 4)} AS abandonment_rate FROM l GROUP BY 1, 2, 3, 4, 5"""))
def abandonment(i: Inputs):
    return rounded(journeys.abandonment_points(_journeys(i)), 4, "abandonment_rate")


@query("path_transitions", oracle("e", f"""{STEPS},
mv AS (SELECT js.tenant_id, js.workspace_id, step_identifier AS from_step,
         LEAD(step_identifier) OVER (PARTITION BY js.workspace_id, js.user_id, js.anonymous_id ORDER BY step_order) AS to_step
       FROM js JOIN jj ON jj.workspace_id = js.workspace_id AND jj.user_id = js.user_id AND jj.anonymous_id = js.anonymous_id),
c AS (SELECT {S}, from_step, to_step, COUNT(*) AS moves FROM mv WHERE to_step IS NOT NULL GROUP BY 1, 2, 3, 4),
d AS (SELECT *, COUNT(*) OVER (PARTITION BY {S}, from_step) AS out_degree, COUNT(*) OVER (PARTITION BY {S}, to_step) AS in_degree,
        SUM(moves) OVER (PARTITION BY {S}, from_step) AS so, SUM(moves) OVER (PARTITION BY {S}, to_step) AS si FROM c)
SELECT {S}, from_step, to_step, moves, out_degree, in_degree, {pct('moves', 'so', 4)} AS outflow_pct,
  {pct('moves', 'si', 4)} AS inflow_pct, out_degree > 1 AS is_branch, in_degree > 1 AS is_merge FROM d"""))
def path_transitions(i: Inputs):
    return rounded(journeys.path_transitions(journeys.journey_steps(i.events, WHOLE)), 4, "outflow_pct", "inflow_pct")


@query("path_comparison", oracle("e", f"""{PATHS},
v AS (SELECT {S}, pattern, 'conversion_rate' AS metric, conversion_rate AS value, -conversion_rate AS k FROM pg
      UNION ALL SELECT {S}, pattern, 'avg_seconds', avg_seconds, avg_seconds FROM pg
      UNION ALL SELECT {S}, pattern, 'dropout_rate', dropout_rate, dropout_rate FROM pg
      UNION ALL SELECT {S}, pattern, 'efficiency_score', efficiency_score, -efficiency_score FROM pg
      UNION ALL SELECT {S}, pattern, 'users', CAST(users AS DOUBLE), -users FROM pg)
SELECT {S}, metric, (ARRAY_AGG(pattern ORDER BY k, pattern))[1] AS best_pattern,
  {rnd('(ARRAY_AGG(value ORDER BY k, pattern))[1]', 3)} AS best_value,
  (ARRAY_AGG(pattern ORDER BY -k, pattern))[1] AS worst_pattern,
  {rnd('(ARRAY_AGG(value ORDER BY -k, pattern))[1]', 3)} AS worst_value FROM v GROUP BY 1, 2, 3"""))
def path_comparison(i: Inputs):
    return rounded(journeys.path_comparison(journeys.path_groups(_journeys(i))), 3, "best_value", "worst_value")

"""Funnel conversion, drop-off and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.columns import round_half_up, ts_text
from trailmark.operators import conversion, dropoff, refresh, rollups
from trailmark.operators.matching import match_funnel_events
from trailmark.operators.state import abandon_users, progression_events, strict_funnel
from trailmark.params import FUNNEL, SCOPE
from trailmark.plans import sql
from trailmark.plans.registry import AS_OF, CURRENT, WHOLE, Inputs, query
from trailmark.plans.sql import avg_secs, oracle, pct, rnd, secs, tstext
from trailmark.session import shared_folder
from trailmark.sources.definitions import (
    MATCH_SCHEMA, PUBLICATION_SCHEMA, STEP_SCHEMA, Definitions, funnel_inventory, validate_funnel_defs,
)

G = "tenant_id, workspace_id, funnel_id"


def texts(df, *columns):
    return df.withColumns({c: ts_text(F.col(c)) for c in columns})


def longs(df, *columns):
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# ---------------------------------------------------------------- definitions
@query("load_funnel_defs", oracle("st", f"""
SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id, CAST(steps.order_index AS BIGINT) AS order_index,
       steps.step_type, steps.step_label, COUNT(m.id) AS matched_events
FROM steps LEFT JOIN m ON m.funnel_id = steps.funnel_id AND m.step = steps.order_index
GROUP BY 1, 2, 3, 4, 5, 6"""))
def load_funnel_defs(i: Inputs):
    """The loaded definitions with the events each step matched."""
    hits = i.matched.groupBy(*FUNNEL, F.col("step_order").alias("order_index")).agg(F.count("*").alias("n"))
    return longs(i.steps.join(hits, [*FUNNEL, "order_index"], "left").select(
        *FUNNEL, "order_index", "step_type", "step_label",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("matched_events")), "order_index")


@query("funnel_inventory", """
WITH f AS (SELECT p_partkey AS id, CAST(1 AS BIGINT) AS tenant_id, CAST(1 + p_partkey % 3 AS BIGINT) AS workspace_id, p_size > 45 AS archived FROM part),
v AS (SELECT l_partkey AS id, BOOL_OR(l_linestatus = 'O') AS draft, BOOL_OR(l_linestatus = 'F') AS published
      FROM lineitem WHERE l_quantity < 10 GROUP BY 1)
SELECT tenant_id, workspace_id, COUNT(*) FILTER (WHERE NOT archived) AS total_funnels,
  COUNT(*) FILTER (WHERE NOT archived AND draft) AS with_draft, COUNT(*) FILTER (WHERE NOT archived AND published) AS with_published,
  COUNT(*) FILTER (WHERE archived) AS archived_funnels FROM f LEFT JOIN v USING (id) GROUP BY 1, 2""")
def inventory(i: Inputs):
    """Funnels told from the tables: a part is a funnel, archived where it is large, and its small lines are versions."""
    created = F.lit("2024-01-01").cast("timestamp")
    funnels = i.table("part").select(
        F.col("p_partkey").alias("id"), F.lit(1).cast("bigint").alias("tenant_id"), (F.col("p_partkey") % 3 + 1).cast("bigint").alias("workspace_id"),
        F.col("p_name").alias("name"), created.alias("created_at"), F.when(F.col("p_size") > 45, created).alias("archived_at"))
    versions = i.table("lineitem").where("l_quantity < 10").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("funnel_id"), F.col("l_linenumber").cast("int").alias("version"),
        F.when(F.col("l_linestatus") == "F", "published").otherwise("DRAFT").alias("state"), created.alias("created_at"))
    return funnel_inventory(Definitions(funnels, versions, *[i.spark.createDataFrame([], s) for s in (PUBLICATION_SCHEMA, STEP_SCHEMA, MATCH_SCHEMA)]))


@query("validate_funnel_defs", oracle("e", """
v AS (SELECT workspace_id, COUNT(DISTINCT event_name) AS names, COUNT(*) AS events FROM e GROUP BY 1)
SELECT workspace_id AS funnel_version_id, violation, events FROM v,
  (VALUES ('no_conversion_step'), ('no_start_step')) x(violation)"""))
def validate_defs(i: Inputs):
    """Checks one version per workspace whose steps are the event names seen there, in name order."""
    from pyspark.sql import Window

    names = i.anonymous_events.groupBy("workspace_id", "event_name").agg(F.count("*").alias("events"))
    order = Window.partitionBy("workspace_id").orderBy("event_name")
    steps = names.select(F.col("workspace_id").alias("funnel_version_id"),
                         (F.row_number().over(order) - 1).alias("order_index"), F.lit("event").alias("type"))
    events = names.groupBy(F.col("workspace_id").alias("funnel_version_id")).agg(F.sum("events").alias("events"))
    return validate_funnel_defs(steps).join(events, "funnel_version_id")


# ---------------------------------------------------------- matching and state
MATCHED_SQL = oracle("m", f"""
SELECT {G}, id, anonymous_id, CAST(step AS BIGINT) AS step_order FROM m""")


def _matched(df):
    return df.select(*FUNNEL, "id", "anonymous_id", F.col("step_order").cast("bigint").alias("step_order"))


@query("match_funnel_events", MATCHED_SQL)
def matched(i: Inputs):
    return _matched(i.matched)


@query("join_funnel_match", MATCHED_SQL)
def join_funnel_match(i: Inputs):
    """The matches as a join of events with the rules of their workspace."""
    return _matched(match_funnel_events(i.anonymous_events, i.defs))


@query("funnel_user_state", oracle("st", f"""
SELECT {G}, anonymous_id, CAST(current_step_index AS BIGINT) AS current_step_index, status,
  {tstext('entered_at')} AS entered_at, {tstext('last_activity_at')} AS last_activity_at,
  {tstext('completed_at')} AS completed_at, {secs('completed_at', 'entered_at')} AS conversion_time_seconds, user_lead AS lead_id FROM st"""))
def user_state(i: Inputs):
    columns = [*FUNNEL, "anonymous_id", "lead_id", "current_step_index", "status", "entered_at", "last_activity_at",
               "completed_at", "conversion_time_seconds"]
    return texts(longs(i.led_state.select(*columns), "current_step_index"), "entered_at", "last_activity_at", "completed_at")


@query("scan_funnel_state", oracle("st", f"""
SELECT {G}, COUNT(*) AS users, CAST(SUM(current_step_index) AS BIGINT) AS steps
FROM st WHERE entered_at {sql.CURRENT} GROUP BY 1, 2, 3"""))
def scan_state(i: Inputs):
    from trailmark.sources.events import scan_funnel_state

    return scan_funnel_state(i.state, CURRENT).groupBy(*FUNNEL).agg(
        F.count("*").alias("users"), F.sum("current_step_index").alias("steps"))


@query("abandon_users", oracle("st", f"""
SELECT {G}, CASE WHEN status = 'active' AND epoch_us({sql.AS_OF}) - epoch_us(last_activity_at) > 604800000000
                 THEN 'abandoned' ELSE status END AS status,
       COUNT(*) AS users,
       COUNT(*) FILTER (WHERE status = 'active'
         AND epoch_us({sql.AS_OF}) - epoch_us(last_activity_at) > 604800000000) AS with_exit
FROM st GROUP BY 1, 2, 3, 4"""))
def abandoned(i: Inputs):
    return abandon_users(i.state, AS_OF).groupBy(*FUNNEL, "status").agg(
        F.count("*").alias("users"), F.count("exit_step_index").alias("with_exit"))


@query("progression_events", oracle("st", f"""
f AS (SELECT {G}, anonymous_id, step, MIN((epoch_us("timestamp"), id)) AS k, MIN("timestamp") AS pt
      FROM m GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT f.*, step_type, ROW_NUMBER() OVER w AS rn,
        MAX(step) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
        COUNT(*) FILTER (WHERE step_type = 'conversion')
          OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done
      FROM f JOIN (SELECT funnel_id AS fid, order_index, step_type FROM steps) x
           ON x.fid = f.funnel_id AND x.order_index = f.step
      WINDOW w AS (PARTITION BY f.funnel_id, anonymous_id ORDER BY k))
SELECT {G}, anonymous_id, CAST(step AS BIGINT) AS step_order, {tstext('pt')} AS "timestamp", rn = 1 AS is_entry,
  COALESCE(step > best, TRUE) AS is_advance, step_type = 'conversion' AND done = 0 AS is_conversion FROM g"""))
def progressions(i: Inputs):
    return texts(longs(progression_events(i.matched), "step_order"), "timestamp")


@query("strict_funnel", oracle("st", f"""
t0 AS (SELECT {G}, anonymous_id, MIN("timestamp") AS t0 FROM m WHERE step = 0 GROUP BY 1, 2, 3, 4),
t1 AS (SELECT t0.*, (SELECT MIN("timestamp") FROM m WHERE m.funnel_id = t0.funnel_id
        AND m.anonymous_id = t0.anonymous_id AND step = 1 AND "timestamp" > t0
        AND "timestamp" <= t0 + INTERVAL 7 DAY) AS t1 FROM t0),
t2 AS (SELECT t1.*, (SELECT MIN("timestamp") FROM m WHERE m.funnel_id = t1.funnel_id
        AND m.anonymous_id = t1.anonymous_id AND step = 2 AND "timestamp" > t1
        AND "timestamp" <= t0 + INTERVAL 7 DAY) AS t2 FROM t1),
t3 AS (SELECT t2.*, (SELECT MIN("timestamp") FROM m WHERE m.funnel_id = t2.funnel_id
        AND m.anonymous_id = t2.anonymous_id AND step = 3 AND "timestamp" > t2
        AND "timestamp" <= t0 + INTERVAL 7 DAY) AS t3 FROM t2)
SELECT {G}, anonymous_id, {tstext('t0')} AS entered_at, {tstext('COALESCE(t3, t2, t1, t0)')} AS reached_at,
  CAST(CASE WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 ELSE 0 END AS BIGINT)
    AS step_reached,
  CASE WHEN funnel_id < 20 THEN t3 WHEN funnel_id < 30 THEN t2 ELSE t1 END IS NOT NULL AS completed
FROM t3"""))
def strict(i: Inputs):
    rows = strict_funnel(i.matched, i.defs).select(
        *FUNNEL, "anonymous_id", "entered_at", "reached_at", "step_reached", "completed")
    return texts(longs(rows, "step_reached"), "entered_at", "reached_at")


# ----------------------------------------------------------------- conversion
REACH = f"""
r AS (SELECT steps.*, (SELECT COUNT(DISTINCT anonymous_id) FROM st WHERE st.funnel_id = steps.funnel_id
               AND st.current_step_index >= steps.order_index AND entered_at {{period}}) AS users
      FROM steps)"""


@query("step_completions", oracle("st", f"""{REACH.format(period=sql.WHOLE)}
SELECT {G}, CAST(order_index + 1 AS BIGINT) AS step_order, users FROM r"""))
def completions(i: Inputs):
    return conversion.step_completions(i.state, i.steps, WHOLE)


@query("join_step_theta", oracle("st", f"""
SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id, CAST(order_index AS BIGINT) AS order_index,
       COUNT(DISTINCT a.anonymous_id) AS users,
       COUNT(DISTINCT CASE WHEN a.current_step_index = order_index THEN a.anonymous_id END) AS stopped_here
FROM steps LEFT JOIN st a ON a.funnel_id = steps.funnel_id AND a.current_step_index >= order_index
GROUP BY 1, 2, 3, 4"""))
def step_theta(i: Inputs):
    return longs(conversion.step_reach(i.state, i.steps).select(*FUNNEL, "order_index", "users", "stopped_here"),
                 "order_index")


SPENT = "CAST(epoch_us(last_activity_at) - epoch_us(entered_at) AS DOUBLE)"
QUANTILES = ",\n".join(
    f"COALESCE({rnd(f'q[{n}] / 1e6 / 60')}, 0.0) AS p{p}_minutes" for n, p in enumerate((25, 50, 75, 90, 95), 1))


@query("conversion_steps", oracle("st", f"""
r AS (SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id, order_index, step_label, step_type,
             COUNT(st.anonymous_id) AS users, AVG({SPENT}) AS spent,
             quantile_cont({SPENT}, [0.25, 0.5, 0.75, 0.9, 0.95]) AS q
      FROM steps LEFT JOIN st ON st.funnel_id = steps.funnel_id AND st.current_step_index >= order_index
           AND entered_at {sql.CURRENT} GROUP BY 1, 2, 3, 4, 5, 6),
l AS (SELECT *, COALESCE(LAG(users) OVER w, users) AS prev, FIRST_VALUE(users) OVER w AS start FROM r
      WINDOW w AS (PARTITION BY funnel_id ORDER BY order_index)),
d AS (SELECT *, {pct('prev - users', 'prev', None)} AS dr FROM l)
SELECT {G}, CAST(order_index + 1 AS BIGINT) AS step_order, step_label, step_type, users,
  {pct('users', 'prev')} AS conversion_from_previous, {pct('users', 'start')} AS conversion_from_start,
  {rnd('dr')} AS drop_off_rate, prev - users AS drop_off_count, dr > 50 AS is_bottleneck,
  CASE WHEN dr > 75 THEN 'critical' WHEN dr > 60 THEN 'high' WHEN dr > 45 THEN 'medium' ELSE 'low' END
    AS bottleneck_severity,
  COALESCE({rnd('spent / 60e6')}, 0.0) AS average_minutes, {QUANTILES}
FROM d"""))
def conversion_steps(i: Inputs):
    return conversion.conversion_steps(i.state, i.steps, CURRENT)


DONE = """(current_step_index + 1 = (SELECT MAX(total_steps) FROM steps WHERE steps.funnel_id = st.funnel_id)
  AND completed_at IS NOT NULL)"""
LAST = "(current_step_index + 1 = (SELECT MAX(total_steps) FROM steps WHERE steps.funnel_id = st.funnel_id))"


@query("conversion_overall", oracle("st", f"""
o AS (SELECT {G}, COUNT(*) FILTER (WHERE entered_at {sql.CURRENT}) AS total_entries,
        COUNT(*) FILTER (WHERE entered_at {sql.CURRENT} AND {LAST}) AS total_conversions,
        {avg_secs('completed_at', 'entered_at', f'entered_at {sql.CURRENT} AND {DONE}')} AS s,
        COUNT(*) FILTER (WHERE completed_at {sql.CURRENT} AND {DONE}) AS inp
      FROM st WHERE entered_at {sql.CURRENT} OR completed_at {sql.CURRENT} GROUP BY 1, 2, 3)
SELECT {G}, total_entries, total_conversions, {pct('total_conversions', 'total_entries')} AS conversion_rate,
  total_entries - total_conversions AS total_drop_offs, COALESCE({rnd('s / 60')}, 0.0) AS average_minutes_to_convert,
  {rnd('inp / (1295999.999 / 3600)')} AS conversion_velocity,
  {rnd(f"greatest(0.0, least(100.0, {pct('total_conversions', 'total_entries', None)} * 10))")} AS engagement_score
FROM o"""))
def conversion_overall(i: Inputs):
    return conversion.conversion_overall(i.state, CURRENT)


ERF = """(CASE WHEN x < 0 THEN -1.0 ELSE 1.0 END * (1.0 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t
  - 0.284496736) * t + 0.254829592) * t * exp(-x * x)))"""


def p_value_sql(source: str, columns: str) -> str:
    """Adds `p`, the two-sided p-value of column z, by the same published approximation."""
    return f"""SELECT {columns}, 2.0 * (1.0 - (1.0 + {ERF}) / 2.0) AS p FROM (
      SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM (SELECT *, abs(z) / sqrt(2.0) AS x FROM {source}))"""


PREVIOUS_DAYS = "BETWEEN TIMESTAMP '2023-12-31 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'"


@query("conversion_significance", oracle("st", f"""
a AS (SELECT {G}, COUNT(*) FILTER (WHERE entered_at {sql.CURRENT}) AS n,
        COUNT(*) FILTER (WHERE entered_at {sql.CURRENT} AND {LAST}) AS c,
        COUNT(*) FILTER (WHERE entered_at {PREVIOUS_DAYS}) AS pn,
        COUNT(*) FILTER (WHERE entered_at {PREVIOUS_DAYS} AND {LAST}) AS pc
      FROM st WHERE entered_at {sql.CURRENT} OR entered_at {PREVIOUS_DAYS} GROUP BY 1, 2, 3),
rr AS (SELECT *, {pct('c', 'n')} / 100 AS current_rate, {pct('pc', 'pn')} / 100 AS previous_rate,
        CAST(c + pc AS DOUBLE) / (n + pn) AS pool FROM a),
z AS (SELECT *, (current_rate - previous_rate) / sqrt(pool * (1.0 - pool) * (1.0 / n + 1.0 / pn)) AS z FROM rr),
pv AS ({p_value_sql('z', '*')})
SELECT {G}, current_rate, previous_rate,
  CASE WHEN previous_rate > 0 THEN {rnd('(current_rate - previous_rate) / previous_rate * 100')} END AS improvement,
  {rnd('z', 3)} AS z_score, {rnd('p', 4)} AS p_value, p < 0.05 AS is_significant,
  CAST(CASE WHEN p < 0.01 THEN 99 WHEN p < 0.05 THEN 95 ELSE 90 END AS BIGINT) AS confidence_level FROM pv"""))
def significance(i: Inputs):
    return conversion.conversion_significance(i.state, CURRENT)


@query("segment_conversion", oracle("st", f"""
seg AS (SELECT DISTINCT workspace_id, anonymous_id, 'device' AS segment_type,
               COALESCE(device_type, 'unknown') AS segment_value FROM e
        UNION ALL SELECT DISTINCT workspace_id, anonymous_id, 'traffic_source', COALESCE(utm_source, 'direct') FROM e),
x AS (SELECT *, {DONE} AS done FROM st WHERE entered_at {sql.CURRENT}),
av AS (SELECT funnel_id, {pct('COUNT(*) FILTER (WHERE done)', 'COUNT(*)')} AS average_rate FROM x GROUP BY 1),
ent AS (SELECT {G}, segment_type, segment_value, COUNT(DISTINCT x.anonymous_id) AS entries
        FROM x JOIN seg USING (workspace_id, anonymous_id) GROUP BY 1, 2, 3, 4, 5),
cnv AS (SELECT {G}, segment_type, segment_value, COUNT(DISTINCT x.anonymous_id) AS convs
        FROM x JOIN seg USING (workspace_id, anonymous_id) WHERE done GROUP BY 1, 2, 3, 4, 5),
j AS (SELECT {G}, segment_type, segment_value, COALESCE(entries, 0) AS total_entries,
             COALESCE(convs, 0) AS total_conversions
      FROM ent FULL OUTER JOIN cnv USING ({G}, segment_type, segment_value)),
k AS (SELECT *, {pct('total_conversions', 'total_entries')} AS conversion_rate,
             {pct('total_conversions', 'total_entries', None)} AS raw FROM j JOIN av USING (funnel_id))
SELECT {G}, segment_type, segment_value, total_entries, total_conversions, conversion_rate,
  CASE WHEN average_rate > 0 THEN {rnd('(raw - average_rate) / average_rate * 100')} END AS performance_vs_average,
  total_entries > 100 AS is_significant, greatest(0.0, conversion_rate - 5) AS lower_bound,
  least(100.0, conversion_rate + 5) AS upper_bound,
  CASE WHEN conversion_rate > 5 THEN 'outperforming' WHEN conversion_rate < 2 THEN 'underperforming'
       ELSE 'stable' END AS insight, least(100.0, CAST(total_entries AS DOUBLE) / 10) AS impact_score FROM k"""))
def segments(i: Inputs):
    return conversion.segment_conversion(i.state, i.anonymous_events, CURRENT)


def _timeseries_sql(unit: str, fmt: str) -> str:
    label = (f"strftime({{0}}, '{fmt}')" if unit != "week" else
             "CONCAT(year({0}), '-W', lpad(CAST((dayofyear({0}) - 1) // 7 + 1 AS VARCHAR), 2, '0'))")
    return oracle("st", f"""
fn AS (SELECT DISTINCT {G} FROM steps),
sp AS (SELECT *, {label.format('pt')} AS "date" FROM (SELECT {G}, UNNEST(generate_series(TIMESTAMP '2024-01-01',
        TIMESTAMP '2024-01-30 23:59:59.999', INTERVAL 1 {unit})) AS pt FROM fn)),
en AS (SELECT {G}, {label.format('entered_at')} AS "date", COUNT(DISTINCT anonymous_id) AS entries
       FROM st WHERE entered_at {sql.WHOLE} GROUP BY 1, 2, 3, 4),
cv AS (SELECT {G}, {label.format('completed_at')} AS "date", COUNT(DISTINCT anonymous_id) AS conversions
       FROM st WHERE completed_at {sql.WHOLE} AND {DONE} GROUP BY 1, 2, 3, 4),
j AS (SELECT {G}, pt, "date", COALESCE(entries, 0) AS entries, COALESCE(conversions, 0) AS conversions,
             {pct('COALESCE(conversions, 0)', 'COALESCE(entries, 0)')} AS conversion_rate
      FROM sp LEFT JOIN en USING ({G}, "date") LEFT JOIN cv USING ({G}, "date")),
ma AS (SELECT *, {rnd('AVG(conversion_rate) OVER (PARTITION BY funnel_id ORDER BY pt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')}
         AS moving_average FROM j),
lg AS (SELECT *, LAG(moving_average) OVER (PARTITION BY funnel_id ORDER BY pt) AS pm FROM ma)
SELECT {G}, "date", entries, conversions, conversion_rate, moving_average,
  CASE WHEN conversion_rate > pm + 0.1 THEN 'up' WHEN conversion_rate < pm - 0.1 THEN 'down' ELSE 'stable' END
    AS trend_direction FROM lg""")


def _timeseries(granularity: str):
    return lambda i: conversion.conversion_timeseries(i.state, i.steps, WHOLE, granularity).drop("period_start")


query("conversion_timeseries", _timeseries_sql("day", "%Y-%m-%d"))(_timeseries("daily"))
query("conversion_timeseries_hourly", _timeseries_sql("hour", "%Y-%m-%d %H:00:00"))(_timeseries("hourly"))
query("conversion_timeseries_weekly", _timeseries_sql("week", ""))(_timeseries("weekly"))


@query("peer_comparison", oracle("st", f"""
x AS (SELECT *, {DONE} AS done, {LAST} AS lst FROM st),
pe AS (SELECT {G}, {pct('COUNT(*) FILTER (WHERE done)', 'COUNT(*)', None)} AS rate FROM x
       WHERE entered_at >= TIMESTAMP '2024-01-01' GROUP BY 1, 2, 3 HAVING COUNT(*) >= 100),
ow AS (SELECT {G}, {pct('COUNT(*) FILTER (WHERE lst)', 'COUNT(*)')} AS rate FROM x WHERE entered_at {sql.CURRENT}
       GROUP BY 1, 2, 3)
SELECT ow.tenant_id, ow.workspace_id, ow.funnel_id, ow.rate AS conversion_rate,
  COALESCE({rnd('100.0 * (COUNT(*) FILTER (WHERE pe.rate <= ow.rate)) / NULLIF(COUNT(pe.rate), 0)', 0)}, 50.0) AS percentile,
  COALESCE({rnd('AVG(pe.rate)')}, 0.0) AS peer_average
FROM ow LEFT JOIN pe ON pe.workspace_id = ow.workspace_id GROUP BY 1, 2, 3, 4"""))
def peers(i: Inputs):
    return conversion.peer_comparison(i.state, CURRENT, AS_OF)


@query("step_metrics_window", oracle("st", f"""
x AS (SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id, CAST(order_index AS BIGINT) AS step_order, step_label,
        COUNT(st.anonymous_id) AS total_entries,
        COUNT(CASE WHEN st.current_step_index + 1 >= order_index THEN 1 END) AS conv,
        {avg_secs('completed_at', 'entered_at')} AS s
      FROM steps LEFT JOIN st ON st.funnel_id = steps.funnel_id AND entered_at {sql.CURRENT} GROUP BY 1, 2, 3, 4, 5)
SELECT {G}, step_order, step_label, total_entries, {pct('conv', 'total_entries', 4)} AS conversion_rate,
       {rnd('COALESCE(s, 0.0)', 3)} AS avg_completion_seconds FROM x"""))
def step_window(i: Inputs):
    rows = conversion.step_metrics_window(i.state, i.steps, CURRENT)
    return rows.withColumns({"conversion_rate": round_half_up(F.col("conversion_rate"), 4),
                             "avg_completion_seconds": round_half_up(F.col("avg_completion_seconds"), 3)})


# ------------------------------------------------------------------- drop-off
EXITS = f"""
x AS (SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id, CAST(order_index AS BIGINT) AS step_order, step_label,
        step_type, COUNT(st.anonymous_id) AS entries,
        COUNT(*) FILTER (WHERE current_step_index = order_index AND completed_at IS NULL) AS exits,
        COUNT(*) FILTER (WHERE current_step_index = order_index AND completed_at IS NULL
                         AND last_activity_at = entered_at) AS imm,
        {avg_secs('last_activity_at', 'entered_at', 'current_step_index = order_index AND completed_at IS NULL')} AS s
      FROM steps LEFT JOIN st ON st.funnel_id = steps.funnel_id AND current_step_index >= order_index
           AND entered_at {sql.WHOLE} GROUP BY 1, 2, 3, 4, 5, 6),
dr AS (SELECT {G}, step_order, step_label, entries, exits, {pct('exits', 'entries')} AS drop_off_rate,
         {rnd('COALESCE(s, 0.0)', 3)} AS avg_seconds_before_exit,
         CASE WHEN s < 30 THEN 'immediate' WHEN s < 300 THEN 'quick' WHEN s < 1800 THEN 'delayed' ELSE 'hesitant' END
           AS exit_velocity,
         CASE WHEN {pct('exits', 'entries')} >= 75 THEN 'critical' WHEN {pct('exits', 'entries')} >= 50 THEN 'high'
              WHEN {pct('exits', 'entries')} >= 25 THEN 'medium' ELSE 'low' END AS drop_off_severity FROM x)"""


@query("dropoff_steps", oracle("st", f"{EXITS} SELECT * FROM dr"))
def dropoff_steps(i: Inputs):
    return dropoff.dropoff_steps(i.state, i.steps, WHOLE).withColumn(
        "avg_seconds_before_exit", round_half_up(F.col("avg_seconds_before_exit"), 3))


@query("exit_triggers", oracle("st", f"""{EXITS}
SELECT {G}, step_order, 'error' AS trigger_type, {rnd('drop_off_rate * 0.6::DOUBLE', 0)} AS frequency FROM dr
  WHERE exit_velocity = 'immediate' AND drop_off_rate > 30
UNION ALL SELECT {G}, step_order, 'confusion', {rnd('drop_off_rate * 0.5::DOUBLE', 0)} FROM dr
  WHERE exit_velocity = 'hesitant' AND avg_seconds_before_exit > 600
UNION ALL SELECT {G}, step_order, 'friction', {rnd('drop_off_rate * 0.4::DOUBLE', 0)} FROM dr
  WHERE exit_velocity = 'quick' AND drop_off_rate > 40
UNION ALL SELECT {G}, step_order, 'distraction', {rnd('drop_off_rate * 0.3::DOUBLE', 0)} FROM dr
  WHERE drop_off_rate > 20 AND drop_off_rate < 40"""))
def exit_triggers(i: Inputs):
    return dropoff.exit_triggers(dropoff.dropoff_steps(i.state, i.steps, WHOLE))


@query("exit_paths", oracle("st", f"""{EXITS}
SELECT {G}, step_order, step_label, exits AS total_exits, imm AS immediate_exits, exits - imm AS delayed_exits,
  {pct('imm', 'exits', 1)} AS immediate_pct, {pct('exits - imm', 'exits', 1)} AS delayed_pct FROM x WHERE exits > 0"""))
def exit_paths(i: Inputs):
    return dropoff.exit_paths(i.state, i.steps, WHOLE)


SEVERITY = f"""{EXITS},
tot AS (SELECT funnel_id, COUNT(*) AS total_entries, COUNT(completed_at) AS total_conversions,
          {avg_secs('last_activity_at', 'entered_at')} AS avg_seconds FROM st WHERE entered_at {sql.WHOLE} GROUP BY 1),
sv AS (SELECT {G}, step_order, step_label, step_type, entries, exits, total_entries, total_conversions, avg_seconds,
         {pct('exits', 'entries')} AS drop_off_rate,
         least(100.0, {pct('exits', 'entries', None)} * (CAST(entries AS DOUBLE) / total_entries) * 2) AS severity_score,
         {pct('exits', 'total_entries')} AS impact_on_conversion
       FROM x JOIN tot USING (funnel_id) WHERE exits > 0)"""


@query("bottleneck_severity", oracle("st", f"""{SEVERITY}
SELECT * REPLACE ({rnd('severity_score', 4)} AS severity_score, {rnd('avg_seconds', 3)} AS avg_seconds),
  {rnd('drop_off_rate * 0.2::DOUBLE', 0)} AS conservative_estimate, {rnd('drop_off_rate * 0.5::DOUBLE', 0)} AS optimistic_estimate,
  CASE WHEN severity_score > 70 THEN 'high' WHEN severity_score > 40 THEN 'medium' ELSE 'low' END AS effort FROM sv"""))
def severity(i: Inputs):
    return dropoff.bottleneck_severity(i.state, i.steps, WHOLE).withColumns({
        "severity_score": round_half_up(F.col("severity_score"), 4),
        "avg_seconds": round_half_up(F.col("avg_seconds"), 3)})


@query("likely_causes", oracle("st", f"""{SEVERITY},
c AS (SELECT {G}, step_order, 'ux' AS cause_type, 'leaves_at_once' AS reason, least(95.0, severity_score + 20) AS cf
        FROM sv WHERE avg_seconds < 30
      UNION ALL SELECT {G}, step_order, 'content', 'long_before_exit', least(90.0, severity_score + 15)
        FROM sv WHERE avg_seconds > 300 AND drop_off_rate > 50
      UNION ALL SELECT {G}, step_order, 'technical', 'page_drop_off', least(85.0, severity_score + 10)
        FROM sv WHERE step_type = 'page' AND drop_off_rate > 60
      UNION ALL SELECT {G}, step_order, 'ux', 'interaction_drop_off', least(80.0, severity_score + 5)
        FROM sv WHERE step_type = 'event' AND drop_off_rate > 40),
a AS (SELECT * FROM c UNION ALL
      SELECT {G}, step_order, 'external', 'unclear', greatest(40.0, severity_score - 20) FROM sv
      WHERE (funnel_id, step_order) NOT IN (SELECT (funnel_id, step_order) FROM c))
SELECT {G}, step_order, cause_type, reason, {rnd('cf', 4)} AS confidence FROM a"""))
def causes(i: Inputs):
    return dropoff.likely_causes(dropoff.bottleneck_severity(i.state, i.steps, WHOLE)).withColumn(
        "confidence", round_half_up(F.col("confidence"), 4))


@query("dropoff_recommendations", oracle("st", f"""{SEVERITY},
t AS (SELECT *, {rnd('drop_off_rate * 0.2::DOUBLE', 0)} AS ce, {rnd('impact_on_conversion * 1000', 0)} AS au,
        ROW_NUMBER() OVER (PARTITION BY funnel_id ORDER BY severity_score DESC, step_order) AS rn FROM sv),
rc AS (
  SELECT {G}, step_order, 'ux' AS type, 'critical' AS priority, ce AS rate_lift, au AS affected_users, 85 AS confidence,
    'high' AS effort, 8 AS dev_days, 14 AS test_days, greatest(1000.0, au * 2) AS test_sample
    FROM t WHERE rn <= 5 AND severity_score > 70
  UNION ALL SELECT {G}, step_order, 'content', 'high', {rnd('ce * 0.8::DOUBLE', 0)}, {rnd('au * 0.8::DOUBLE', 0)}, 70,
    'medium', 4, 10, greatest(500.0, au) FROM t WHERE rn <= 5 AND severity_score > 50 AND severity_score <= 70
  UNION ALL SELECT {G}, step_order, 'flow', 'medium', {rnd('ce * 0.6::DOUBLE', 0)}, {rnd('au * 0.6::DOUBLE', 0)}, 60,
    'low', 2, NULL, NULL FROM t WHERE rn <= 5 AND severity_score > 30 AND severity_score <= 50),
al AS (SELECT * FROM rc UNION ALL
  SELECT DISTINCT {G}, NULL::BIGINT, 'timing', 'low', 5.0, 100.0, 40, 'low', 1, NULL::INT, NULL::DOUBLE FROM steps
  WHERE funnel_id NOT IN (SELECT funnel_id FROM rc))
SELECT * REPLACE (CAST(confidence AS BIGINT) AS confidence, CAST(dev_days AS BIGINT) AS dev_days,
  CAST(test_days AS BIGINT) AS test_days, CAST(rate_lift AS DOUBLE) AS rate_lift,
  CAST(affected_users AS DOUBLE) AS affected_users) FROM al"""))
def recommendations(i: Inputs):
    return dropoff.dropoff_recommendations(i.state, i.steps, WHOLE)


@query("dropoff_summary", oracle("st", f"""{SEVERITY}
SELECT {G}, CAST(SUM(exits) AS BIGINT) AS total_drop_offs,
  (ARRAY_AGG(step_order ORDER BY severity_score DESC, step_order))[1] AS biggest_bottleneck_step,
  {rnd('least(100.0, AVG(severity_score))', 0)} AS optimization_potential FROM sv GROUP BY 1, 2, 3"""))
def summary(i: Inputs):
    return dropoff.dropoff_summary(i.state, i.steps, WHOLE)


# -------------------------------------------------------------------- rollups
CONV_SECONDS = "CAST(epoch_us(completed_at) - epoch_us(entered_at) AS DOUBLE) / 1e6"


LEFT = f"completed_at IS NULL AND epoch_us({sql.AS_OF}) - epoch_us(last_activity_at) > 604800000000"
DAILY_SQL = oracle("st", f"""
SELECT {G}, CAST(current_step_index AS BIGINT) AS current_step_index,
  strftime(last_activity_at, '%Y-%m-%d') AS activity_date, COUNT(*) AS users_at_step,
  COUNT(completed_at) AS completions, COUNT(*) FILTER (WHERE {LEFT}) AS exits,
  {rnd(f'AVG({CONV_SECONDS})', 3)} AS avg_conversion_time
FROM st WHERE last_activity_at >= TIMESTAMP '2023-11-02' GROUP BY 1, 2, 3, 4, 5""")


def _daily_rows(rows):
    return longs(rows, "current_step_index").withColumns({
        "activity_date": F.col("activity_date").cast("string"), "avg_conversion_time": round_half_up(F.col("avg_conversion_time"), 3)})


@query("mv_daily_step_completions", DAILY_SQL)
def daily(i: Inputs):
    return _daily_rows(rollups.daily_step_completions(abandon_users(i.state, AS_OF), AS_OF))


def _refreshed(i: Inputs):
    """The rollups after two loads, the second one twice: events that arrived by the middle of the month, then the rest.
    Every fifth event arrives late, so days of the first load change with the second."""
    second = (F.col("timestamp") >= F.lit("2024-01-16").cast("timestamp")) | (F.col("id") % 5 == 0)
    store = refresh.rollup_store(i.spark, shared_folder(i.spark, "rollups"), buckets=8)
    for number, rows in enumerate([i.matched.where(~second), i.matched.where(second), i.matched.where(second)]):
        refresh.refresh(store, rows, min(number, 1))
    return store


@query("mv_daily_refreshed", DAILY_SQL)
def daily_refreshed(i: Inputs):
    return _daily_rows(refresh.daily_step_completions(_refreshed(i), AS_OF))


SUMMARY_SQL = oracle("st", f"""
f AS (SELECT CAST(1 AS BIGINT) AS tenant_id, CAST(w AS BIGINT) AS workspace_id, CAST(10 * n + w AS BIGINT) AS funnel_id, nm AS funnel_name
      FROM (VALUES (1, 'Signup to purchase'), (2, 'Pages to purchase'), (3, 'Click to purchase'), (4, 'Draft')) a(n, nm),
           (VALUES (1), (2), (3)) b(w))
SELECT f.tenant_id, f.workspace_id, f.funnel_id, funnel_name, COUNT(anonymous_id) AS total_users,
  COUNT(completed_at) AS conversions, COUNT(*) FILTER (WHERE anonymous_id IS NOT NULL AND {LEFT}) AS exits,
  COUNT(*) FILTER (WHERE anonymous_id IS NOT NULL AND {LEFT}) AS abandoned,
  CASE WHEN COUNT(anonymous_id) > 0 THEN {pct('COUNT(completed_at)', 'COUNT(anonymous_id)')} END AS conversion_rate,
  {rnd(f'AVG({CONV_SECONDS})', 3)} AS avg_conversion_time, {tstext('MIN(entered_at)')} AS first_entry,
  {tstext('MAX(last_activity_at)')} AS last_activity
FROM f LEFT JOIN st ON st.funnel_id = f.funnel_id GROUP BY 1, 2, 3, 4""")


@query("mv_conversion_summary", SUMMARY_SQL)
def conversion_summary(i: Inputs):
    return _summary_rows(rollups.conversion_summary(i.defs.funnels, abandon_users(i.state, AS_OF)))


@query("mv_summary_refreshed", SUMMARY_SQL)
def summary_refreshed(i: Inputs):
    return _summary_rows(refresh.conversion_summary(_refreshed(i), i.defs.funnels, AS_OF))


def _summary_rows(rows):
    return texts(rows, "first_entry", "last_activity").withColumn(
        "avg_conversion_time", round_half_up(F.col("avg_conversion_time"), 3))


@query("mv_progression_paths", oracle("st", f"""
SELECT {G}, anonymous_id, user_lead AS lead_id, CAST(current_step_index AS BIGINT) AS current_step_index,
  CAST(CASE WHEN {LEFT} THEN current_step_index END AS BIGINT) AS exit_step_index, CASE WHEN {LEFT} THEN 'abandoned' ELSE status END AS status,
  {tstext('entered_at')} AS entered_at, {tstext('completed_at')} AS completed_at,
  {CONV_SECONDS} AS conversion_time_seconds, CAST(greatest(current_step_index, 0) AS BIGINT) AS steps_completed
FROM st WHERE entered_at >= TIMESTAMP '2024-01-01'"""))
def paths(i: Inputs):
    rows = rollups.progression_paths(abandon_users(i.led_state, AS_OF), AS_OF)
    return texts(longs(rows, "current_step_index", "exit_step_index"), "entered_at", "completed_at")


# --------------------------------------------------------------------- exports
@query("export_csv", oracle("st", f"""
r AS (SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id, order_index, step_label, COUNT(st.anonymous_id) AS users,
        COALESCE({rnd(f'AVG({SPENT}) / 60e6')}, 0.0) AS mins
      FROM steps LEFT JOIN st ON st.funnel_id = steps.funnel_id AND st.current_step_index >= order_index
           AND entered_at {sql.WHOLE} GROUP BY 1, 2, 3, 4, 5),
l AS (SELECT *, COALESCE(LAG(users) OVER (PARTITION BY funnel_id ORDER BY order_index), users) AS prev FROM r)
SELECT CASE funnel_id // 10 WHEN 1 THEN 'Signup to purchase' WHEN 2 THEN 'Pages to purchase' ELSE 'Click to purchase' END AS "Funnel Name",
  CAST(order_index + 1 AS BIGINT) AS "Step Order", step_label AS "Step Name", users AS "Unique Users", {pct('users', 'prev')} AS "Conversion Rate",
  {pct('prev - users', 'prev')} AS "Drop-off Rate", mins AS "Avg Time to Complete (minutes)", '2024-01-01 to 2024-01-30' AS "Date Range" FROM l"""))
def export_csv(i: Inputs):
    from trailmark.sources.exports import csv_rows

    return csv_rows(conversion.conversion_steps(i.state, i.steps, WHOLE), i.defs.funnels, WHOLE)


@query("export_json", oracle("st", f"""
SELECT {G}, CAST(COUNT(*) AS BIGINT) AS entries, CAST((SELECT COUNT(*) FROM steps WHERE steps.funnel_id = st.funnel_id) AS BIGINT) AS total_records
FROM st WHERE entered_at {sql.WHOLE} GROUP BY 1, 2, 3"""))
def export_json(i: Inputs):
    """The JSON reports, with two of their fields read back."""
    from trailmark.sources.exports import json_report

    reports = json_report(conversion.conversion_overall(i.state, WHOLE), conversion.step_completions(i.state, i.steps, WHOLE),
                          i.defs.funnels, WHOLE)
    return reports.select(
        *FUNNEL, F.get_json_object("report", "$.summary.total_entries").cast("bigint").alias("entries"),
        F.get_json_object("report", "$.export_metadata.total_records").cast("bigint").alias("total_records"))

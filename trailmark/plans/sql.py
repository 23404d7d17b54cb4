"""DuckDB building blocks of the oracles. Written from the data model, not from the Spark code."""

from __future__ import annotations

ADAPTER = """
b AS (
  SELECT event_id AS id, ts AS "timestamp", event_type AS event_name, user_id, value,
         CAST(json_extract(props, '$.k') AS INT) AS k, props,
         CONCAT('a_', CAST(user_id AS STRING), '_', strftime(ts, '%Y%m%d')) AS anonymous_id,
         hour(ts) AS hr, strftime(ts, '%Y%m%d') AS d
  FROM events),
e AS (
  SELECT id, CAST(1 AS BIGINT) AS tenant_id, CAST(1 + user_id % 3 AS BIGINT) AS workspace_id,
    event_name, "timestamp", anonymous_id,
    CASE WHEN MAX(CASE WHEN event_name = 'signup' THEN 1 ELSE 0 END)
         OVER (PARTITION BY anonymous_id ORDER BY "timestamp", id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN user_id END AS lead_id,
    CONCAT('s_', CAST(user_id AS STRING), '_', d, '_', CAST(CAST(FLOOR(hr / 6) AS INT) AS STRING)) AS session_id,
    CASE WHEN event_name IN ('view','click','signup')
         THEN CONCAT('https://example.com/', event_name) END AS page_url,
    CASE k % 4 WHEN 0 THEN 'https://www.google.com/search' WHEN 2 THEN 'https://social.example/x'
               WHEN 3 THEN 'https://blog.example/y' END AS page_referrer,
    CASE WHEN k < 20 THEN 'google' WHEN k < 40 THEN 'facebook' WHEN k < 55 THEN 'email' END AS utm_source,
    CASE WHEN k < 20 THEN 'cpc' WHEN k < 40 THEN 'social' WHEN k < 55 THEN 'newsletter' END AS utm_medium,
    CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_type,
    CASE k % 5 WHEN 0 THEN 'BR' WHEN 1 THEN 'US' WHEN 2 THEN 'GB' WHEN 3 THEN 'DE' END AS geo_country,
    k, value, props
  FROM b)"""

SESSIONS = """
s AS (
  SELECT tenant_id, workspace_id, session_id, anonymous_id, MIN("timestamp") AS started_at
  FROM e GROUP BY 1, 2, 3, 4)"""

STEPS = """
steps AS (
  SELECT CAST(1 AS BIGINT) AS tenant_id, CAST(w AS BIGINT) AS workspace_id,
         CAST(10 * n + w AS BIGINT) AS funnel_id, order_index, step_type, step_label,
         COUNT(*) OVER (PARTITION BY n, w) AS total_steps
  FROM (VALUES
    (1, 0, 'start', 'View'), (1, 1, 'event', 'Click'), (1, 2, 'event', 'Signup'), (1, 3, 'conversion', 'Purchase'),
    (2, 0, 'start', 'View page'), (2, 1, 'page', 'Signup page'), (2, 2, 'conversion', 'Purchase'),
    (3, 0, 'start', 'Click page'), (3, 1, 'conversion', 'Purchase')) t(n, order_index, step_type, step_label),
    (VALUES (1), (2), (3)) ws(w))"""

MATCHED = """
m0 AS (
  SELECT e.*, CAST(10 + workspace_id AS BIGINT) AS funnel_id,
         CASE event_name WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS step
  FROM e
  UNION ALL
  SELECT e.*, CAST(20 + workspace_id AS BIGINT),
         CASE WHEN page_url LIKE '%/view%' THEN 0 WHEN page_url = 'https://example.com/signup' THEN 1
              WHEN event_name = 'purchase' THEN 2 END
  FROM e
  UNION ALL
  SELECT e.*, CAST(30 + workspace_id AS BIGINT),
         CASE WHEN page_url ILIKE '%example.com/c%' THEN 0 WHEN event_name = 'purchase' THEN 1 END
  FROM e),
m AS (SELECT * FROM m0 WHERE step IS NOT NULL)"""

STATE = """
st AS (
  SELECT m.tenant_id, m.workspace_id, m.funnel_id, m.anonymous_id,
         MIN("timestamp") AS entered_at, MAX("timestamp") AS last_activity_at, MAX(step) AS current_step_index,
         CASE WHEN BOOL_OR(step_type = 'conversion') THEN MAX("timestamp") END AS completed_at,
         CASE WHEN BOOL_OR(step_type = 'conversion') THEN 'completed' ELSE 'active' END AS status,
         ARG_MAX(lead_id, ("timestamp", id)) FILTER (WHERE lead_id IS NOT NULL) AS user_lead
  FROM m JOIN steps ON steps.funnel_id = m.funnel_id AND steps.order_index = m.step
  GROUP BY 1, 2, 3, 4)"""

PARTS = {"e": [ADAPTER], "s": [ADAPTER, SESSIONS], "m": [ADAPTER, STEPS, MATCHED],
         "st": [ADAPTER, STEPS, MATCHED, STATE], "s+st": [ADAPTER, SESSIONS, STEPS, MATCHED, STATE]}


def oracle(base: str, body: str) -> str:
    """Prefix the shared CTEs. `body` may start with further CTEs (`x AS (...), ... SELECT`)."""
    body = body.strip()
    joiner = "\n" if body.upper().startswith(("SELECT", "(SELECT", "FROM")) else ",\n"
    return "WITH" + ",".join(PARTS[base]) + joiner + body


def rnd(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def pct(part: str, whole: str, digits: int | None = 2) -> str:
    raw = f"(CASE WHEN ({whole}) > 0 THEN CAST(({part}) AS DOUBLE) / ({whole}) * 100.0 ELSE 0.0 END)"
    return raw if digits is None else rnd(raw, digits)


def secs(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1e6)"


def avg_secs(later: str, earlier: str, condition: str | None = None) -> str:
    keep = f" FILTER (WHERE {condition})" if condition else ""
    return f"(AVG(CAST(epoch_us({later}) - epoch_us({earlier}) AS DOUBLE)){keep} / 1e6)"


def tstext(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


CURRENT = "BETWEEN TIMESTAMP '2024-01-16 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59.999'"
PREVIOUS = "BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-15 23:59:59.999'"
WHOLE = "BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59.999'"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

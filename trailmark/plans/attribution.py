"""Attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.columns import ts_text
from trailmark.operators import attribution as attr
from trailmark.params import SCOPE
from trailmark.plans import sql
from trailmark.plans.journeys import S
from trailmark.plans.registry import WHOLE, Inputs, query
from trailmark.plans.sql import oracle, pct, rnd, tstext
from trailmark.plans.timing import rounded

KIND = """CASE WHEN utm_source IS NOT NULL THEN 'paid_search' WHEN page_referrer LIKE '%google%' THEN 'organic_search'
  WHEN page_referrer IS NULL THEN 'direct' WHEN page_referrer LIKE '%social%' THEN 'social' ELSE 'referral' END"""
TOUCHES = f"""
t0 AS (SELECT {S}, id, anonymous_id, COALESCE(CAST(lead_id AS VARCHAR), anonymous_id) AS user_id, "timestamp",
         {KIND} AS touchpoint_type, utm_source, utm_medium, CAST(NULL AS VARCHAR) AS utm_campaign, device_type,
         regexp_replace(page_referrer, 'https?://([^/]+).*', '\\1') AS referrer_domain
       FROM e WHERE "timestamp" >= TIMESTAMP '2024-01-30 23:59:59.999' - INTERVAL 30 DAY
         AND "timestamp" <= TIMESTAMP '2024-01-30 23:59:59.999'),
tp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S}, user_id ORDER BY "timestamp", id) AS touchpoint_order FROM t0),
tj AS (SELECT {S}, user_id, anonymous_id, COUNT(*) AS touches, MIN("timestamp") AS first_at, MAX("timestamp") AS last_at,
         COUNT(DISTINCT touchpoint_type) AS channels, COUNT(*) >= 3 AS converted FROM tp GROUP BY 1, 2, 3, 4
       HAVING MIN("timestamp") {sql.WHOLE})"""
STATS = f"""
au AS (SELECT {S}, COALESCE(CAST(lead_id AS VARCHAR), anonymous_id) AS user_id, lead_id, {KIND} AS k, "timestamp" AS ts0 FROM e),
fc AS (SELECT workspace_id AS w, user_id AS u FROM au GROUP BY 1, 2 HAVING COUNT(*) >= 3),
stt AS (SELECT {S}, COUNT(DISTINCT user_id) AS total_users, COUNT(*) AS total_touchpoints,
          COUNT(DISTINCT CASE WHEN u IS NOT NULL THEN lead_id END) AS total_conversions,
          string_agg(DISTINCT k, ',' ORDER BY k) AS touchpoint_types
        FROM au LEFT JOIN fc ON w = workspace_id AND u = user_id WHERE ts0 {sql.WHOLE} GROUP BY 1, 2)"""
CREDITS = f"""{TOUCHES}, {STATS},
ct AS (SELECT tp.*, touches AS n, last_at, ROW_NUMBER() OVER w AS i
       FROM tp JOIN tj USING (tenant_id, workspace_id, user_id, anonymous_id) WHERE converted
       WINDOW w AS (PARTITION BY tenant_id, workspace_id, user_id, anonymous_id ORDER BY "timestamp", id)),
dw AS (SELECT *, pow(0.5, (epoch_us(last_at) - epoch_us("timestamp")) / 86400e6 / 7) AS wt FROM ct),
dn AS (SELECT *, wt / SUM(wt) OVER (PARTITION BY tenant_id, workspace_id, user_id, anonymous_id) AS decay,
         CONCAT(touchpoint_type, '_', COALESCE(utm_source, 'direct'), '_', COALESCE(utm_medium, 'none')) AS touchpoint_id FROM dw),
cr AS (SELECT *, 'first_touch' AS model, 1.0::DOUBLE AS credit FROM dn WHERE i = 1
  UNION ALL SELECT *, 'last_touch', 1.0 FROM dn WHERE i = n
  UNION ALL SELECT *, 'linear', CAST(1 AS DOUBLE) / n FROM dn
  UNION ALL SELECT *, 'time_decay', decay FROM dn
  UNION ALL SELECT *, 'position_based', CASE WHEN n = 1 THEN 1.0 WHEN i = 1 OR i = n THEN 0.4 ELSE CAST(0.2 AS DOUBLE) / (n - 2) END FROM dn
  UNION ALL SELECT *, 'custom', CASE WHEN n = 1 THEN 1.0 WHEN i = 1 THEN 0.5 WHEN i = n THEN 0.3
     ELSE CAST(0.2 AS DOUBLE) / (n - 2) END FROM dn)"""
FLAGS = """ab AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, workspace_id, model
    ORDER BY round(credit, 6) DESC, touchpoint_id) AS rank FROM aa)"""
AGG = f"""
aa0 AS (SELECT {S}, model, touchpoint_id, touchpoint_type, SUM(credit) AS credit,
          SUM(CASE WHEN i = 1 THEN credit ELSE 0.0 END) AS fc0, SUM(CASE WHEN i > 1 AND i = n THEN credit ELSE 0.0 END) AS lc0
        FROM cr GROUP BY 1, 2, 3, 4, 5),
aa AS (SELECT aa0.*, credit / total_conversions * 100 AS attribution_pct,
         CASE WHEN model = 'custom' THEN 0.0 ELSE fc0 * 100 END AS first_touch_pct,
         CASE WHEN model = 'custom' THEN 0.0 ELSE (credit - fc0 - lc0) * 100 END AS middle_touch_pct,
         CASE WHEN model = 'custom' THEN 0.0 ELSE lc0 * 100 END AS last_touch_pct
       FROM aa0 JOIN stt USING (tenant_id, workspace_id)), {FLAGS}"""
VALUES = ("credit", "attribution_pct", "first_touch_pct", "middle_touch_pct", "last_touch_pct")
ROUNDED = ", ".join(f"{rnd(v, 4)} + 0.0 AS {v}" for v in VALUES)


def _touches(i: Inputs):
    return attr.touchpoints(i.events, WHOLE)


def _table(i: Inputs):
    return attr.credit_table(attr.credits(attr.journey_touches(_touches(i), WHOLE)))


def _attributed(i: Inputs):
    return attr.attribution(_table(i), attr.journey_stats(i.events, WHOLE))


@query("touchpoints", oracle("e", f"""{TOUCHES}
SELECT {S}, user_id, anonymous_id, id, {tstext('"timestamp"')} AS "timestamp", touchpoint_type, utm_source, utm_medium,
  device_type, referrer_domain, touchpoint_order FROM tp"""))
def touchpoints(i: Inputs):
    return attr.numbered_touches(_touches(i)).drop("utm_campaign").withColumns({
        "timestamp": ts_text(F.col("timestamp")), "touchpoint_order": F.col("touchpoint_order").cast("bigint")})


@query("touchpoint_journeys", oracle("e", f"""{TOUCHES}
SELECT {S}, user_id, anonymous_id, touches, {tstext('first_at')} AS first_at, {tstext('last_at')} AS last_at, channels,
  converted, (epoch_us(last_at) - epoch_us(first_at)) / 1e6 AS duration_seconds FROM tj"""))
def touchpoint_journeys(i: Inputs):
    return attr.touchpoint_journeys(_touches(i), WHOLE).withColumns({
        "first_at": ts_text(F.col("first_at")), "last_at": ts_text(F.col("last_at"))})


@query("journey_stats", oracle("e", f"{STATS} SELECT * FROM stt"))
def journey_stats(i: Inputs):
    return attr.journey_stats(i.events, WHOLE).withColumn("touchpoint_types", F.array_join("touchpoint_types", ","))


def _model_sql(model: str) -> str:
    return oracle("e", f"""{CREDITS}
SELECT {S}, touchpoint_id, {rnd('SUM(credit)', 4)} AS credit FROM cr WHERE model = '{model}' GROUP BY 1, 2, 3""")


def _model(model: str):
    def plan(i: Inputs):
        touches = attr.journey_touches(_touches(i), WHOLE)
        table = attr.credit_table(attr.credits(touches, (model,)), (model,))
        stats = attr.journey_stats(i.events, WHOLE)
        return rounded(attr.attribution(table, stats, (model,)).select(*SCOPE, "touchpoint_id", "credit"), 4, "credit")

    return plan


for _name, _key in (("first_touch", "attr_first_touch"), ("last_touch", "attr_last_touch"), ("linear", "attr_linear"),
                    ("time_decay", "attr_time_decay"), ("position_based", "attr_position"), ("custom", "attr_custom")):
    query(_key, _model_sql(_name))(_model(_name))


@query("attribution", oracle("e", f"""{CREDITS}, {AGG}
SELECT {S}, model, touchpoint_id, touchpoint_type, {ROUNDED}, rank,
  rank <= 10 AND attribution_pct > 10 AS high_converting, rank <= 10 AND attribution_pct > 15 AS increase_investment,
  rank <= 10 AND attribution_pct < 5 AS optimize_targeting FROM ab"""))
def attribution(i: Inputs):
    return _plus_zero(rounded(_attributed(i), 4, *VALUES), *VALUES)


def _plus_zero(df, *columns):
    return df.withColumns({c: F.col(c) + 0.0 for c in columns})


@query("attr_by_dimension", oracle("e", f"""{CREDITS},
d AS (SELECT {S}, model, credit, 'utm_source' AS dimension, COALESCE(utm_source, 'none') AS value FROM cr
  UNION ALL SELECT {S}, model, credit, 'utm_medium', COALESCE(utm_medium, 'none') FROM cr
  UNION ALL SELECT {S}, model, credit, 'utm_campaign', COALESCE(utm_campaign, 'none') FROM cr
  UNION ALL SELECT {S}, model, credit, 'device_type', COALESCE(device_type, 'none') FROM cr
  UNION ALL SELECT {S}, model, credit, 'referrer_domain', COALESCE(referrer_domain, 'none') FROM cr),
g AS (SELECT {S}, dimension, value, model, SUM(credit) AS credit FROM d GROUP BY 1, 2, 3, 4, 5)
SELECT {S}, dimension, value, model, {rnd('credit', 4)} AS credit,
  {rnd('credit / SUM(credit) OVER (PARTITION BY tenant_id, workspace_id, dimension, model) * 100', 4)} AS credit_pct FROM g"""))
def by_dimension(i: Inputs):
    return rounded(attr.attr_by_dimension(_table(i)), 4, "credit", "credit_pct")


@query("attr_model_comparison", oracle("e", f"""{CREDITS},
w AS (SELECT {S}, touchpoint_id, {', '.join(f"COALESCE(SUM(credit) FILTER (WHERE model = '{m}'), 0.0) AS {m}" for m in attr.MODELS)}
      FROM cr GROUP BY 1, 2, 3)
SELECT {S}, touchpoint_id, {', '.join(f"{rnd(m, 4)} AS {m}" for m in attr.MODELS)},
  {rnd(f"greatest({', '.join(attr.MODELS)}) - least({', '.join(attr.MODELS)})", 4)} AS spread FROM w"""))
def model_comparison(i: Inputs):
    return rounded(attr.attr_model_comparison(_attributed(i)), 4, *attr.MODELS, "spread")


@query("journey_complexity", oracle("e", f"""{TOUCHES}
SELECT {S}, COUNT(*) AS journeys, {rnd('AVG(touches)', 4)} AS avg_touches,
  {rnd('AVG(epoch_us(last_at) - epoch_us(first_at)) / 86400e6', 6)} AS avg_days,
  {pct('COUNT(*) FILTER (WHERE channels > 1)', 'COUNT(*)', 4)} AS multi_channel_pct FROM tj GROUP BY 1, 2"""))
def complexity(i: Inputs):
    rows = attr.journey_complexity(attr.touchpoint_journeys(_touches(i), WHOLE))
    return rounded(rounded(rows, 4, "avg_touches", "multi_channel_pct"), 6, "avg_days")


@query("credit_distribution", oracle("e", f"""{CREDITS},
k AS (SELECT DISTINCT {S}, model, touchpoint_type FROM cr),
p AS (SELECT {S}, model, touchpoint_type, CASE WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS position,
        SUM(credit) AS c FROM cr GROUP BY 1, 2, 3, 4, 5)
SELECT {S}, model, touchpoint_type, position, {rnd('COALESCE(c, 0.0)', 4)} + 0.0 AS credit
FROM (SELECT * FROM k, (VALUES ('first'), ('last'), ('middle')) v(position))
  LEFT JOIN p USING ({S}, model, touchpoint_type, position)"""))
def distribution(i: Inputs):
    return _plus_zero(rounded(attr.credit_distribution(_table(i)), 4, "credit"), "credit")


@query("credit_concentration", oracle("e", f"""{CREDITS},
a AS (SELECT {S}, model, touchpoint_id, SUM(credit) AS credit FROM cr GROUP BY 1, 2, 3, 4),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S}, model ORDER BY round(credit, 6), touchpoint_id DESC) AS i,
        COUNT(*) OVER (PARTITION BY {S}, model) AS n FROM a)
SELECT {S}, model, MAX(n) AS touchpoints,
  {rnd('2 * SUM(i * credit) / (MAX(n) * SUM(credit)) - (MAX(n) + 1) / MAX(n)', 6)} AS gini,
  {rnd('100.0 * SUM(CASE WHEN i > n - ceil(n * 0.1) THEN credit ELSE 0.0 END) / SUM(credit)', 4)} AS top_tenth_pct
FROM r GROUP BY 1, 2, 3"""))
def concentration(i: Inputs):
    return rounded(rounded(attr.credit_concentration(_attributed(i)), 6, "gini"), 4, "top_tenth_pct")

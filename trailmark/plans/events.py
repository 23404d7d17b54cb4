"""Scan, join, validation, enrichment and report queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.columns import period_label, rate, ts_text
from trailmark.operators import conversion, ingest, traffic, workspaces
from trailmark.operators.identity import anonymize_columns
from trailmark.operators.matching import property_predicate
from trailmark.operators.state import reached_all_steps
from trailmark.params import FUNNEL, SCOPE
from trailmark.plans import payloads, sql
from trailmark.plans.conversion import DONE, G
from trailmark.plans.registry import CURRENT, WHOLE, Inputs, query
from trailmark.plans.sql import oracle, pct, tstext
from trailmark.sources.events import scan_events, scan_sessions, tenant_scope

S = "tenant_id, workspace_id"

# Raw payloads in SQL, from the same description.
RAW = """
rw AS (SELECT event_id AS id, CAST(1 AS BIGINT) AS tenant_id, CAST(user_id % 3 + 1 AS BIGINT) AS workspace_id, user_id,
         event_type AS name, ts AS pt, CAST(json_extract(props, '$.k') AS INT) AS k, props,
         CONCAT('a_', user_id, '_', strftime(ts, '%Y%m%d')) AS visitor FROM events)"""
PAYLOADS = f"""{RAW},
pl AS (SELECT id, tenant_id, workspace_id, id // 60 AS batch_id, k, pt,
  CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN repeat('x', 101) ELSE name END AS event_name,
  CASE WHEN k % 13 = 0 THEN CONCAT('bad-', user_id) ELSE visitor END AS anonymous_id,
  CASE WHEN k % 23 = 0 THEN 'x_1' WHEN k % 2 = 0 THEN CONCAT('s_', user_id) END AS session_id,
  CASE WHEN k % 29 <> 0 THEN CONCAT('e_', id // 3) END AS event_id,
  length(CASE WHEN k = 97 AND id % 10 = 0 THEN repeat(props, 30000) ELSE props END) AS bytes,
  pt + (k % 12 - 6) * INTERVAL 1 MINUTE AS ingested_at FROM rw)"""
ERRORS = f"""{PAYLOADS},
er AS (SELECT id, 'event_name' AS error FROM pl WHERE length(event_name) < 1 OR length(event_name) > 100
  UNION ALL SELECT id, 'anonymous_id' FROM pl WHERE NOT regexp_full_match(anonymous_id, 'a_[A-Za-z0-9_]+')
  UNION ALL SELECT id, 'session_id' FROM pl WHERE NOT regexp_full_match(session_id, 's_[A-Za-z0-9_]+')
  UNION ALL SELECT id, 'event_id' FROM pl WHERE length(event_id) > 100
  UNION ALL SELECT id, 'timestamp' FROM pl WHERE k % 31 = 0
  UNION ALL SELECT id, 'payload_size' FROM pl WHERE bytes > 262144
  UNION ALL SELECT id, 'device' FROM pl WHERE k % 37 = 0
  UNION ALL SELECT id, 'geo' FROM pl WHERE k % 41 = 0)"""


def _payloads(i: Inputs):
    return payloads.payloads(i.spark, i.sf_dir)


# ---------------------------------------------------------------------- scans
@query("scan_events", oracle("e", f"""
SELECT {S}, id, event_name, anonymous_id FROM e WHERE "timestamp" {sql.WHOLE}"""))
def scan(i: Inputs):
    return scan_events(i.anonymous_events, WHOLE).select(*SCOPE, "id", "event_name", "anonymous_id")


@query("scan_sessions", oracle("s", f"""
SELECT {S}, session_id, anonymous_id, {tstext('started_at')} AS started_at FROM s WHERE started_at {sql.CURRENT}"""))
def sessions(i: Inputs):
    return scan_sessions(i.sessions, CURRENT).select(
        *SCOPE, "session_id", "anonymous_id", ts_text(F.col("started_at")).alias("started_at"))


@query("tenant_scope", oracle("e", f"""
SELECT {S}, COUNT(*) AS events, COUNT(DISTINCT anonymous_id) AS visitors FROM e WHERE tenant_id = 1 GROUP BY 1, 2"""))
def scope(i: Inputs):
    return tenant_scope(i.anonymous_events, 1).groupBy(*SCOPE).agg(
        F.count("*").alias("events"), F.count_distinct("anonymous_id").alias("visitors"))


# ---------------------------------------------------------------------- joins
@query("join_session_event", oracle("s", f"""
SELECT s.tenant_id, s.workspace_id, s.session_id, COUNT(e.id) AS events, {tstext('MAX(e."timestamp")')} AS last_at
FROM s LEFT JOIN e ON e.session_id = s.session_id AND e.tenant_id = s.tenant_id AND e.workspace_id = s.workspace_id
  AND e."timestamp" {sql.WHOLE} WHERE s.started_at {sql.WHOLE} GROUP BY 1, 2, 3"""))
def session_event(i: Inputs):
    rows = traffic.session_events(i.sessions, i.anonymous_events, WHOLE)
    return rows.select(*SCOPE, "session_id", "events", ts_text(F.col("last_at")).alias("last_at"))


@query("join_cross_scalar", oracle("e", f"""
SELECT {S}, COUNT(*) AS events, {pct('COUNT(*)', '(SELECT COUNT(*) FROM e)', 4)} AS share_pct FROM e GROUP BY 1, 2"""))
def cross_scalar(i: Inputs):
    """Share of a tenant's events per workspace: the total is a window over the small result, not a cross join."""
    from pyspark.sql import Window

    counts = i.anonymous_events.groupBy(*SCOPE).agg(F.count("*").alias("events"))
    total = F.sum("events").over(Window.partitionBy("tenant_id"))
    return counts.withColumn("share_pct", rate(F.col("events"), total, 4))


@query("join_spine", oracle("e", f"""
d AS (SELECT {S}, date_trunc('hour', "timestamp") AS pt, COUNT(*) AS events FROM e WHERE "timestamp" {sql.WHOLE} GROUP BY 1, 2, 3),
sp AS (SELECT {S}, UNNEST(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS pt
       FROM (SELECT DISTINCT {S} FROM e))
SELECT {S}, COUNT(*) AS hours, COUNT(*) FILTER (WHERE events IS NULL) AS empty_hours FROM sp LEFT JOIN d USING ({S}, pt) GROUP BY 1, 2"""))
def spine(i: Inputs):
    series = traffic.timeseries(i.anonymous_events, WHOLE, "hour", ("events",))
    return series.groupBy(*SCOPE).agg(F.count("*").alias("hours"), F.count_if(F.col("events") == 0).alias("empty_hours"))


@query("join_full_outer", oracle("st", f"""
seg AS (SELECT DISTINCT workspace_id, anonymous_id, COALESCE(device_type, 'unknown') AS v FROM e),
ent AS (SELECT {G}, v, COUNT(DISTINCT st.anonymous_id) AS entries FROM st JOIN seg USING (workspace_id, anonymous_id)
        WHERE entered_at {sql.WHOLE} GROUP BY 1, 2, 3, 4),
cnv AS (SELECT {G}, v, COUNT(DISTINCT st.anonymous_id) AS conversions FROM st JOIN seg USING (workspace_id, anonymous_id)
        WHERE completed_at {sql.WHOLE} AND {DONE} GROUP BY 1, 2, 3, 4)
SELECT {G}, v AS segment_value, COALESCE(entries, 0) AS entries, COALESCE(conversions, 0) AS conversions
FROM ent FULL OUTER JOIN cnv USING ({G}, v)"""))
def full_outer(i: Inputs):
    """Entries by entry time and conversions by completion time, per device: two small sides, joined in full."""
    users = i.state.join(conversion.user_segments(i.anonymous_events).where("segment_type = 'device'"),
                         [*SCOPE, "anonymous_id"])
    keys = [*FUNNEL, "segment_value"]
    entries = users.where(WHOLE.contains("entered_at")).groupBy(*keys).agg(F.count("*").alias("entries"))
    done = users.where(reached_all_steps() & WHOLE.contains("completed_at")).groupBy(*keys).agg(
        F.count("*").alias("conversions"))
    zero = F.lit(0).cast("bigint")
    return entries.join(done, keys, "full_outer").select(
        *keys, F.coalesce("entries", zero).alias("entries"), F.coalesce("conversions", zero).alias("conversions"))


@query("join_cohort_steps", oracle("st", f"""
x AS (SELECT st.tenant_id, st.workspace_id, st.funnel_id, strftime(entered_at, '%Y-%m') AS cohort_period, order_index,
        current_step_index FROM st JOIN (SELECT funnel_id AS fid, order_index FROM steps) s ON s.fid = st.funnel_id)
SELECT {G}, cohort_period, CAST(order_index AS BIGINT) AS step_order, COUNT(*) AS cohort_size,
  COUNT(*) FILTER (WHERE current_step_index >= order_index) AS users_reached FROM x GROUP BY 1, 2, 3, 4, 5"""))
def cohort_steps(i: Inputs):
    """User x step without a cross join: users collapse to (cohort, furthest step) before the steps multiply them."""
    users = i.state.groupBy(*FUNNEL, "total_steps", period_label(F.col("entered_at"), "month").alias("cohort_period"),
                            "current_step_index").agg(F.count("*").alias("n"))
    rows = users.withColumn("step_order", F.explode(F.sequence(F.lit(0), F.col("total_steps") - 1)))
    return rows.groupBy(*FUNNEL, "cohort_period", F.col("step_order").cast("bigint").alias("step_order")).agg(
        F.sum("n").alias("cohort_size"),
        F.sum(F.when(F.col("current_step_index") >= F.col("step_order"), F.col("n")).otherwise(0)).alias("users_reached"))


# --------------------------------------------------------- filters, validation
FILTERS = [("equals", 42), ("in", [1, 2, 3]), ("contains", "9"), ("starts_with", "7"), ("greater_than", 50), ("less_than", 10)]


@query("property_filters", oracle("e", f"""
SELECT {S}, COUNT(*) FILTER (WHERE k = 42) AS equals, COUNT(*) FILTER (WHERE k IN (1, 2, 3)) AS "in",
  COUNT(*) FILTER (WHERE CAST(k AS VARCHAR) LIKE '%9%') AS contains, COUNT(*) FILTER (WHERE CAST(k AS VARCHAR) LIKE '7%') AS starts_with,
  COUNT(*) FILTER (WHERE k > 50) AS greater_than, COUNT(*) FILTER (WHERE k < 10) AS less_than FROM e GROUP BY 1, 2"""))
def property_filters(i: Inputs):
    return i.anonymous_events.groupBy(*SCOPE).agg(*[
        F.count_if(property_predicate("k", operator, value)).alias(operator) for operator, value in FILTERS])


@query("validate_events", oracle("e", f"""{ERRORS}
SELECT pl.id, string_agg(error, ',' ORDER BY error) AS errors FROM pl JOIN er ON er.id = pl.id GROUP BY 1"""))
def validate(i: Inputs):
    quarantined = ingest.split_valid(ingest.validate_events(_payloads(i)))[1]
    return quarantined.select("id", F.array_join(F.array_sort("errors"), ",").alias("errors"))


@query("validate_timestamp", oracle("e", f"""{PAYLOADS}
SELECT id, CASE WHEN pt < ingested_at - INTERVAL 5 MINUTE THEN 'too_old' WHEN pt > ingested_at + INTERVAL 5 MINUTE
  THEN 'in_future' END AS timestamp_error FROM pl"""))
def validate_time(i: Inputs):
    return ingest.validate_timestamp(_payloads(i), "at").select("id", "timestamp_error")


@query("validate_identify", oracle("e", f"""{RAW},
iy AS (SELECT id, k, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 43 = 1 THEN 'not an e-mail' ELSE 'ok@x.y' END AS email,
         CASE WHEN k % 3 = 0 THEN 1 END AS phone, CASE WHEN k % 10 <> 0 THEN 1 END AS user_id FROM rw WHERE name = 'signup'),
x AS (SELECT id, 'user_id_or_traits' AS error FROM iy WHERE user_id IS NULL AND email IS NULL AND phone IS NULL
      UNION ALL SELECT id, 'email' FROM iy WHERE email = 'not an e-mail')
SELECT id, string_agg(error, ',' ORDER BY error) AS errors FROM x GROUP BY 1"""))
def validate_identify(i: Inputs):
    rows = payloads.identifies(i.spark, i.sf_dir).withColumn(
        "email", F.when((F.col("k") % 43 == 1) & F.col("email").isNotNull(), "not an e-mail").otherwise(F.col("email")))
    return ingest.split_valid(ingest.validate_identify(rows))[1].select(
        "id", F.array_join(F.array_sort("errors"), ",").alias("errors"))


@query("schema_version", oracle("e", f"""{RAW}
SELECT CASE k % 4 WHEN 0 THEN '1.' || k || '.0' WHEN 1 THEN '2.0.0-beta.1' ELSE '1.0' END AS schema_version, COUNT(*) AS events
FROM rw GROUP BY 1"""))
def versions(i: Inputs):
    k = F.col("k")
    header = F.when(k % 4 == 0, F.concat(F.lit("1."), k.cast("string"), F.lit(".0"))).when(k % 4 == 1, "2.0.0-beta.1").when(
        k % 4 == 2, "v2")
    return payloads.raw(i.spark, i.sf_dir).groupBy(ingest.schema_version(header).alias("schema_version")).agg(
        F.count("*").alias("events"))


@query("dedup_events", oracle("e", f"""{PAYLOADS}
SELECT id, event_id, event_name, anonymous_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, event_id ORDER BY ingested_at, id) AS rn
  FROM pl) WHERE rn = 1 OR event_id IS NULL"""))
def dedup(i: Inputs):
    return ingest.dedup_events(_payloads(i).drop("payload")).select("id", "event_id", "event_name", "anonymous_id")


@query("ingest_summary", oracle("e", f"""{ERRORS},
du AS (SELECT pl.*, event_id IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY tenant_id, event_id ORDER BY ingested_at, id) > 1 AS dup,
         id IN (SELECT id FROM er) AS bad FROM pl)
SELECT batch_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT bad) AS accepted, COUNT(*) FILTER (WHERE bad) AS rejected,
  COUNT(*) FILTER (WHERE NOT bad AND dup) AS duplicates FROM du GROUP BY 1"""))
def summary(i: Inputs):
    return ingest.ingest_summary(ingest.mark_duplicates(ingest.validate_events(_payloads(i)).drop("payload")))


# ---------------------------------------------------------------- enrichment
AGENTS = [("desktop", "Windows", "10.0", "Chrome", "120.0.6099.109"), ("desktop", "macOS", "10.15.7", "Safari", "17.2"),
          ("mobile", "macOS", None, "Safari", "17.2"), ("desktop", "Windows", "10.0", "Edge", "120.0.2210.91"),
          ("desktop", "Linux", None, "Firefox", "121.0"), ("mobile", "Linux", None, "Chrome", "120.0.6099.144"),
          ("mobile", "Android", None, "Opera", "9.80"), ("unknown", "unknown", None, "unknown", None)]
AGENT_VALUES = ", ".join("(" + ", ".join([str(n)] + ["NULL" if v is None else f"'{v}'" for v in row]) + ")"
                         for n, row in enumerate(AGENTS))


BATCH = "CASE WHEN id // 600 % 2 = 0 THEN id // 60 ELSE -(id // 40) END"


@query("ingest_pipeline", oracle("e", f"""{ERRORS},
bt AS (SELECT pl.*, {BATCH} AS own_batch, COUNT(*) OVER (PARTITION BY {BATCH}) AS together FROM pl),
eb AS (SELECT id, error FROM er UNION ALL SELECT id, 'batch_size' FROM bt WHERE together > 50),
el AS (SELECT id, string_agg(error, ',' ORDER BY error) AS errors FROM eb GROUP BY 1),
oc AS (SELECT bt.*, COALESCE(errors, '') AS errs, errors IS NOT NULL AS bad FROM bt LEFT JOIN el USING (id)),
od AS (SELECT *, NOT bad AND event_id IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY bad, tenant_id, event_id ORDER BY ingested_at, id) > 1 AS dup FROM oc),
ag(n, t, os, osv, br, brv) AS (VALUES {AGENT_VALUES})
SELECT od.id, CASE WHEN bad THEN 'rejected' WHEN dup THEN 'duplicate' ELSE 'accepted' END AS outcome, errs AS errors, t AS device_type,
  os AS os_name, br AS browser, '/' || rw.name AS path, CASE WHEN rw.k % 3 = 0 THEN '8.8.8.' || (rw.k % 200) END AS client_address
FROM od JOIN rw ON rw.id = od.id JOIN ag ON n = rw.k % 8"""))
def ingest_pipeline(i: Inputs):
    """Checks, batch limit, duplicates and enrichment of one feed of payloads, some of whose batches are too large."""
    k, agents = F.col("k"), F.array(*[F.lit(a) for a in payloads.USER_AGENTS])
    named = payloads.raw(i.spark, i.sf_dir).select("id", F.concat(F.lit("https://example.com/"), "name", F.lit("?q=1")).alias("page_url"))
    rows = _payloads(i).join(named, "id").withColumns({
        "batch_id": F.when(F.floor(F.col("id") / 600) % 2 == 0, F.floor(F.col("id") / 60)).otherwise(-F.floor(F.col("id") / 40)),
        "user_agent": F.get(agents, k % (len(payloads.USER_AGENTS) + 1)),
        "forwarded": F.when(k % 3 == 0, F.concat(F.lit("8.8.8."), (k % 200).cast("string"), F.lit(", 10.0.0.1"))).otherwise("192.168.0.1")})
    done = ingest.processed(rows, addresses={"x_forwarded_for": "forwarded"})
    return done.select(
        "id", "outcome", F.array_join(F.array_sort("errors"), ",").alias("errors"), F.col("parsed_device.type").alias("device_type"),
        F.col("parsed_device.os.name").alias("os_name"), F.col("parsed_device.browser.name").alias("browser"), "path", "client_address")


@query("enrich_device", oracle("e", f"""{RAW},
ag(n, t, os, osv, br, brv) AS (VALUES {AGENT_VALUES})
SELECT t AS device_type, os AS os_name, osv AS os_version, br AS browser, brv AS browser_version, COUNT(*) AS events
FROM rw JOIN ag ON n = k % 8 GROUP BY 1, 2, 3, 4, 5"""))
def device(i: Inputs):
    agents = F.array(*[F.lit(a) for a in payloads.USER_AGENTS])
    rows = payloads.raw(i.spark, i.sf_dir).select(
        ingest.parse_device(F.get(agents, F.col("k") % (len(payloads.USER_AGENTS) + 1))).alias("d"))
    return rows.groupBy(
        F.col("d.type").alias("device_type"), F.col("d.os.name").alias("os_name"), F.col("d.os.version").alias("os_version"),
        F.col("d.browser.name").alias("browser"), F.col("d.browser.version").alias("browser_version"),
    ).agg(F.count("*").alias("events"))


@query("client_ip", oracle("e", f"""{RAW}
SELECT id, CASE WHEN k % 4 = 1 THEN '203.0.113.' || k WHEN k % 3 = 0 THEN '198.51.100.' || k ELSE '127.0.0.1' END AS ip FROM rw"""))
def ip(i: Inputs):
    k = F.col("k")
    number = k.cast("string")
    headers = {
        "x_forwarded_for": F.when(k % 4 == 0, "10.0.0.1, 8.8.8.8").when(
            k % 4 == 1, F.concat(F.lit("203.0.113."), number, F.lit(" , 10.0.0.1"))).when(k % 4 == 3, "192.168.1.1"),
        "x_real_ip": F.when(k % 3 == 0, F.concat(F.lit("198.51.100."), number)).when(k % 3 == 1, "999.1.1.1"),
    }
    return payloads.raw(i.spark, i.sf_dir).select("id", ingest.client_ip(headers, F.lit("127.0.0.1")).alias("ip"))


@query("enrich_page", oracle("e", """
u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages)
SELECT page_id, p AS path FROM u"""))
def page(i: Inputs):
    return i.table("pages").select("page_id", ingest.page_path(F.lit(None).cast("string"), F.col("url")).alias("path"))


# -------------------------------------------------------------------- reports
def _live_funnels(i: Inputs):
    return i.defs.funnels.where(F.col("archived_at").isNull())


def _people(i: Inputs, table: str, key: str):
    return i.table(table).select(F.lit(1).cast("bigint").alias("tenant_id"), (F.col(key) % 3 + 1).cast("bigint").alias("workspace_id"))


PEOPLE = """(SELECT COUNT(*) FROM customer WHERE c_custkey % 3 + 1 = workspace_id) AS active_users,
  (SELECT COUNT(*) FROM supplier WHERE s_suppkey % 3 + 1 = workspace_id) AS active_keys"""


@query("workspace_impact", oracle("e", f"""
x AS (SELECT {S}, COUNT(*) AS events, CAST(4 AS BIGINT) AS live_funnels FROM e GROUP BY 1, 2)
SELECT {S}, events, live_funnels, {PEOPLE} FROM x"""))
def impact(i: Inputs):
    return workspaces.workspace_impact(
        i.anonymous_events, live_funnels=_live_funnels(i), active_users=_people(i, "customer", "c_custkey"),
        active_keys=_people(i, "supplier", "s_suppkey"))


@query("workspace_stats", oracle("e", f"""
x AS (SELECT {S}, COUNT(*) AS events, COUNT(DISTINCT anonymous_id) AS visitors, {tstext('MAX("timestamp")')} AS last_activity,
        CAST(4 AS BIGINT) AS live_funnels FROM e GROUP BY 1, 2)
SELECT {S}, events, visitors, last_activity, live_funnels, {PEOPLE} FROM x"""))
def stats(i: Inputs):
    return workspaces.workspace_stats(
        i.anonymous_events, live_funnels=_live_funnels(i), active_users=_people(i, "customer", "c_custkey"),
        active_keys=_people(i, "supplier", "s_suppkey")).withColumn("last_activity", ts_text(F.col("last_activity")))


@query("tenant_stats", oracle("e", f"""
SELECT tenant_id, COUNT(DISTINCT workspace_id) AS workspaces, COUNT(*) AS events, {tstext('MAX("timestamp")')} AS last_activity,
  (SELECT COUNT(*) FROM customer) AS active_users FROM e GROUP BY 1"""))
def tenants(i: Inputs):
    return workspaces.tenant_stats(i.anonymous_events, active_users=_people(i, "customer", "c_custkey")).withColumn(
        "last_activity", ts_text(F.col("last_activity")))


@query("anonymize", oracle("e", """
SELECT id, sha256(CONCAT('pepper', anonymous_id)) AS anonymous_id,
  CONCAT('hash_', length(session_id), '_', substr(session_id, 1, 2), '***') AS session_id FROM e"""))
def anonymize(i: Inputs):
    rows = i.anonymous_events.select("id", "anonymous_id", "session_id")
    return anonymize_columns(anonymize_columns(rows, ["anonymous_id"], "pepper"), ["session_id"], legacy=True)

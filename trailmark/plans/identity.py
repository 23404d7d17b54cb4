"""Identity and session queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from trailmark.functions.columns import ts_text
from trailmark.operators import identity, leads, sessions, traffic
from trailmark.params import SCOPE
from trailmark.plans import payloads, sql
from trailmark.plans.events import RAW, S
from trailmark.plans.registry import CURRENT, Inputs, query
from trailmark.plans.sql import oracle, tstext
from trailmark.session import shared_folder
from trailmark.sources.keyed import Keyed, KeyedStore


def texts(df, *columns):
    return df.withColumns({c: ts_text(F.col(c)) for c in columns})


def _hmac_sql(message: str, key: bytes) -> str:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = ["".join(f"\\x{b ^ x:02X}" for b in block) for x in (0x36, 0x5C)]
    inner = f"unhex(sha256('{pads[0]}'::BLOB || encode({message})))"
    return f"sha256('{pads[1]}'::BLOB || {inner})"


IDENTIFIES = f"""{RAW},
iy AS (SELECT id, tenant_id, workspace_id, visitor AS anonymous_id, pt,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN CONCAT(' User', user_id // 3, '@Example.COM ')
       ELSE CONCAT('user', user_id // 3, '@example.com') END AS email,
  CASE WHEN k % 3 = 0 THEN CONCAT('+55 (11) 9000-', user_id // 4) END AS phone FROM rw WHERE name = 'signup'),
fp AS (SELECT *, lower(trim(email)) AS ne, regexp_replace(phone, '[^0-9]', '', 'g') AS np FROM iy)"""
RESOLVED = f"""{IDENTIFIES},
hd AS (SELECT workspace_id, ne, MIN(pt) AS c, ARG_MAX(np, (pt, id)) FILTER (WHERE np IS NOT NULL) AS p FROM fp
       WHERE ne IS NOT NULL GROUP BY 1, 2),
ow AS (SELECT workspace_id AS w, p, ARG_MIN(ne, c) AS owner FROM hd WHERE p IS NOT NULL GROUP BY 1, 2),
rs AS (SELECT fp.*, COALESCE(CASE WHEN ne IS NULL THEN 'e:' || owner END, 'e:' || ne, 'p:' || np, 'n:' || id) AS lead
       FROM fp LEFT JOIN ow ON w = workspace_id AND p = np)"""


def _resolved(i: Inputs):
    """Identifies resolved on normalised values, so that the independent SQL can state the same keys."""
    rows = payloads.identifies(i.spark, i.sf_dir).withColumns({
        "email_fingerprint": identity.normal_email(F.col("email")),
        "phone_fingerprint": identity.normal_phone(F.col("phone"))})
    return identity.resolve_identifies(rows)


@query("visitors", oracle("e", f"""
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S}, anonymous_id ORDER BY "timestamp", id) AS rn FROM e)
SELECT {S}, anonymous_id, {tstext('MIN("timestamp")')} AS first_seen_at, {tstext('MAX("timestamp")')} AS last_seen_at,
  MAX(utm_source) FILTER (WHERE rn = 1) AS first_source, ARG_MAX(utm_source, rn) FILTER (WHERE utm_source IS NOT NULL) AS last_source,
  ARG_MAX(device_type, rn) AS last_device, ARG_MAX(geo_country, rn) FILTER (WHERE geo_country IS NOT NULL) AS last_country
FROM o GROUP BY 1, 2, 3"""))
def visitors(i: Inputs):
    return texts(identity.visitors(i.anonymous_events).select(
        *SCOPE, "anonymous_id", "first_seen_at", "last_seen_at", F.col("first_utm.source").alias("first_source"),
        F.col("last_utm.source").alias("last_source"), F.col("last_device.type").alias("last_device"),
        F.col("last_geo.country").alias("last_country")), "first_seen_at", "last_seen_at")


@query("fingerprints", oracle("e", f"""{IDENTIFIES}
SELECT id, {_hmac_sql('ne', payloads.DEMO_EMAIL_KEY)} AS email_fingerprint,
  {_hmac_sql('np', payloads.DEMO_PHONE_KEY)} AS phone_fingerprint FROM fp"""))
def fingerprints(i: Inputs):
    return identity.with_fingerprints(
        payloads.identifies(i.spark, i.sf_dir), payloads.DEMO_EMAIL_KEY, payloads.DEMO_PHONE_KEY).select(
        "id", "email_fingerprint", "phone_fingerprint")


@query("encrypt_pii", oracle("e", f"{IDENTIFIES} SELECT id, ne AS email, np AS phone, TRUE AS hidden FROM fp"))
def encrypt_pii(i: Inputs):
    """Encrypts, then decrypts again: what comes back is the normalised value."""
    key = F.encode(F.lit(payloads.DEMO_AES_KEY), "UTF-8")
    protected = identity.encrypt_pii(payloads.identifies(i.spark, i.sf_dir), key, 1)
    return protected.select(
        "id", identity.decrypt(F.col("email_enc"), key, "email", 1).alias("email"),
        identity.decrypt(F.col("phone_enc"), key, "phone", 1).alias("phone"),
        F.coalesce(~F.col("email_enc").contains("@"), F.lit(True)).alias("hidden"))


@query("reencrypt_pii", oracle("e", f"{IDENTIFIES} SELECT id, ne AS email, np AS phone, CAST(2 AS BIGINT) AS key_version FROM fp"))
def reencrypt_pii(i: Inputs):
    old, new = (F.encode(F.lit(k), "UTF-8") for k in (payloads.DEMO_AES_KEY, payloads.DEMO_AES_KEY_2))
    rows = identity.encrypt_pii(payloads.identifies(i.spark, i.sf_dir), old, 1)
    rotated = identity.reencrypt_pii(rows, old, 1, new, 2)
    return rotated.select(
        "id", identity.decrypt(F.col("email_enc"), new, "email", 2).alias("email"),
        identity.decrypt(F.col("phone_enc"), new, "phone", 2).alias("phone"), F.col("key_version").cast("bigint").alias("key_version"))


@query("resolve_identifies", oracle("e", f"{RESOLVED} SELECT id, {S}, anonymous_id, lead AS lead_key FROM rs"))
def resolve_identifies(i: Inputs):
    return _resolved(i).select("id", *SCOPE, "anonymous_id", "lead_key")


@query("resolve_leads", oracle("e", f"""{RESOLVED}
SELECT {S}, lead AS lead_key, ARG_MAX(ne, (pt, id)) FILTER (WHERE ne IS NOT NULL) AS email_fingerprint,
  ARG_MAX(np, (pt, id)) FILTER (WHERE np IS NOT NULL) AS phone_fingerprint, {tstext('MIN(pt)')} AS created_at,
  {tstext('MAX(pt)')} AS updated_at, COUNT(*) AS identifies FROM rs GROUP BY 1, 2, 3"""))
def resolve_leads(i: Inputs):
    return texts(identity.resolve_leads(_resolved(i)), "created_at", "updated_at")


@query("identity_links", oracle("e", f"""{RESOLVED}
SELECT {S}, anonymous_id, lead AS lead_key, {tstext('MIN(pt)')} AS first_at, {tstext('MAX(pt)')} AS last_at
FROM rs GROUP BY 1, 2, 3, 4"""))
def links(i: Inputs):
    return texts(identity.identity_links(_resolved(i)), "first_at", "last_at")


@query("join_latest_link", oracle("e", f"""{RESOLVED},
lk AS (SELECT {S}, anonymous_id, lead, MAX(pt) AS l FROM rs GROUP BY 1, 2, 3, 4)
SELECT {S}, anonymous_id, ARG_MAX(lead, (l, lead)) AS lead_key FROM lk GROUP BY 1, 2, 3"""))
def latest_link(i: Inputs):
    return identity.latest_link(identity.identity_links(_resolved(i)))


@query("link_leads", oracle("e", f"""{RESOLVED}
SELECT {S}, id, anonymous_id, (SELECT ARG_MAX(lead, (pt, lead)) FROM rs WHERE rs.workspace_id = e.workspace_id
  AND rs.anonymous_id = e.anonymous_id AND rs.pt <= e."timestamp") AS lead_key FROM e"""))
def link_leads(i: Inputs):
    return identity.link_leads(i.anonymous_events, _resolved(i)).select(*SCOPE, "id", "anonymous_id", "lead_key")


# ------------------------------------------------------------- upserts over batches
SECOND_BATCH = "2024-01-16"
LEADS_SQL = f"""{IDENTIFIES},
bt AS (SELECT *, CASE WHEN pt < TIMESTAMP '{SECOND_BATCH}' THEN 1 ELSE 2 END AS bn FROM fp),
hd AS (SELECT v.bn, workspace_id, ne, MIN(pt) AS c, ARG_MAX(np, (pt, id)) FILTER (WHERE np IS NOT NULL) AS p
       FROM bt JOIN (VALUES (1), (2)) v(bn) ON bt.bn <= v.bn WHERE ne IS NOT NULL GROUP BY 1, 2, 3),
ow AS (SELECT bn, workspace_id AS w, p, ARG_MIN(ne, (c, ne)) AS owner FROM hd WHERE p IS NOT NULL GROUP BY 1, 2, 3),
rs AS (SELECT bt.*, COALESCE(CASE WHEN ne IS NULL THEN 'e:' || owner END, 'e:' || ne, 'p:' || np, 'n:' || id) AS lead
       FROM bt LEFT JOIN ow ON ow.bn = bt.bn AND w = workspace_id AND p = np)"""


def _by_batch(rows, at="timestamp"):
    second = F.col(at) >= F.lit(SECOND_BATCH).cast("timestamp")
    return [rows.where(~second), rows.where(second)]


def _lead_store(i: Inputs) -> KeyedStore:
    """The identifies in two batches, the second one twice."""
    rows = payloads.identifies(i.spark, i.sf_dir).withColumns({
        "email_fingerprint": identity.normal_email(F.col("email")), "phone_fingerprint": identity.normal_phone(F.col("phone"))})
    store = leads.lead_store(i.spark, shared_folder(i.spark, "leads"), buckets=8)
    for number, batch in enumerate([*_by_batch(rows), _by_batch(rows)[1]]):
        leads.upsert_leads(store, batch, min(number, 1))
    return store


@query("lead_upsert", oracle("e", f"""{LEADS_SQL}
SELECT {S}, lead AS lead_key, MAX(ne) AS email_fingerprint,
  ARG_MAX(np, (pt, id)) FILTER (WHERE np IS NOT NULL AND (ne IS NOT NULL OR lead LIKE 'p:%')) AS phone_fingerprint,
  {tstext('MIN(pt)')} AS created_at, {tstext('MAX(pt)')} AS updated_at, COUNT(*) AS identifies FROM rs GROUP BY 1, 2, 3"""))
def lead_upsert(i: Inputs):
    return texts(_lead_store(i).read("leads").select(
        *SCOPE, "lead_key", "email_fingerprint", "phone_fingerprint", "created_at", "updated_at", "identifies"), "created_at", "updated_at")


@query("lead_links", oracle("e", f"""{LEADS_SQL}
SELECT {S}, anonymous_id, lead AS lead_key, {tstext('MIN(pt)')} AS first_at, {tstext('MAX(pt)')} AS last_at FROM rs GROUP BY 1, 2, 3, 4"""))
def lead_links(i: Inputs):
    return texts(_lead_store(i).read("links"), "first_at", "last_at")


@query("upsert_sink", oracle("e", f"""
o AS (SELECT *, CONCAT('u_', split_part(anonymous_id, '_', 2)) AS who,
        ROW_NUMBER() OVER (PARTITION BY {S}, split_part(anonymous_id, '_', 2) ORDER BY "timestamp", id) AS rn FROM e)
SELECT {S}, who AS anonymous_id, {tstext('MIN("timestamp")')} AS first_seen_at, {tstext('MAX("timestamp")')} AS last_seen_at,
  MAX(utm_source) FILTER (WHERE rn = 1) AS first_source, ARG_MAX(utm_source, rn) FILTER (WHERE utm_source IS NOT NULL) AS last_source
FROM o GROUP BY 1, 2, 3"""))
def upsert_sink(i: Inputs):
    return texts(_visitor_table(i).select(
        *SCOPE, "anonymous_id", "first_seen_at", "last_seen_at", F.col("first_utm.source").alias("first_source"),
        F.col("last_utm.source").alias("last_source")), "first_seen_at", "last_seen_at")


def _by_user(events):
    """Events whose visitor is a user over the whole month."""
    return events.withColumn("anonymous_id", F.regexp_replace("anonymous_id", r"^a_(\d+)_.*$", "u_$1"))


def _visitor_table(i: Inputs):
    """Visitors upserted batch by batch into a keyed table; the last batch comes twice."""
    rows = _by_user(i.anonymous_events)
    store = KeyedStore(i.spark, shared_folder(i.spark, "visitors"), {"visitors": Keyed(identity.VISITORS, identity.VISITOR, 8)})
    for number, batch in enumerate([*_by_batch(rows), _by_batch(rows)[1]]):
        store.upsert({"visitors": (identity.visitor_changes(batch), identity.fold_visitors)}, "events", min(number, 1))
    return store.read("visitors")


@query("user_summary_maintained", oracle("e", f"""
u AS (SELECT {S}, split_part(anonymous_id, '_', 2) AS who, "timestamp", lead_id FROM e),
f AS (SELECT {S}, who, MIN("timestamp") AS first_at FROM u GROUP BY 1, 2, 3),
p AS (SELECT {S}, who, BOOL_OR(lead_id IS NOT NULL) AS known FROM u WHERE "timestamp" {sql.CURRENT} GROUP BY 1, 2, 3)
SELECT {S}, COUNT(*) AS total_visitors, COUNT(*) FILTER (WHERE known) AS identified_leads,
  COUNT(*) FILTER (WHERE first_at < TIMESTAMP '2024-01-16') AS returning_visitors,
  COUNT(*) FILTER (WHERE first_at >= TIMESTAMP '2024-01-16') AS new_visitors FROM p JOIN f USING ({S}, who) GROUP BY 1, 2"""))
def user_summary_maintained(i: Inputs):
    """Returning visitors by the maintained table of visitors: events before the period are not read again."""
    return traffic.user_summary(_by_user(i.events), CURRENT, _visitor_table(i))


@query("overview_linked", oracle("e", f"""{RESOLVED},
lk AS (SELECT e.*, (SELECT ARG_MAX(lead, (pt, lead)) FROM rs WHERE rs.workspace_id = e.workspace_id
  AND rs.anonymous_id = e.anonymous_id AND rs.pt <= e."timestamp") AS lk FROM e WHERE "timestamp" {sql.CURRENT})
SELECT {S}, COUNT(*) AS events, COUNT(DISTINCT anonymous_id) AS visitors, COUNT(DISTINCT session_id) AS sessions,
  COUNT(DISTINCT anonymous_id) FILTER (WHERE lk IS NOT NULL) AS conversions FROM lk GROUP BY 1, 2"""))
def overview_linked(i: Inputs):
    """The overview of events that carry the lead their visitor was linked to."""
    linked = identity.link_leads(i.anonymous_events, _resolved(i)).withColumn("lead_id", leads.lead_id())
    return traffic.overview_counts(linked, CURRENT)


SESSION_BASE = """
o AS (SELECT id, tenant_id, workspace_id, CONCAT('u_', CAST(b.user_id AS VARCHAR)) AS anonymous_id, e."timestamp" AS pt,
        ROW_NUMBER() OVER (PARTITION BY b.user_id ORDER BY e."timestamp", id) AS rn FROM e JOIN (SELECT id, user_id FROM b) b USING (id))"""


def _open_events(i: Inputs):
    """Events without the client's session, a visitor being one user over the whole month."""
    return i.anonymous_events.select(
        "id", *SCOPE, F.regexp_replace("anonymous_id", r"^a_(\d+)_.*$", "u_$1").alias("anonymous_id"), "timestamp",
        F.lit(None).cast("string").alias("session_id"))


def _session_rows(df):
    return texts(df.select(*SCOPE, "id", "anonymous_id", "session_start"), "session_start")


@query("sessionize", f"""WITH RECURSIVE {oracle('e', SESSION_BASE + " SELECT 1")[5:].rsplit("SELECT 1", 1)[0]},
f AS (SELECT id, tenant_id, workspace_id, anonymous_id, pt, rn, pt AS st0 FROM o WHERE rn = 1
  UNION ALL SELECT o.id, o.tenant_id, o.workspace_id, o.anonymous_id, o.pt, o.rn,
    CASE WHEN o.pt <= f.st0 + INTERVAL 30 MINUTE THEN f.st0 ELSE o.pt END FROM f JOIN o ON o.anonymous_id = f.anonymous_id AND o.rn = f.rn + 1)
SELECT {S}, id, anonymous_id, {tstext('st0')} AS session_start FROM f""")
def sessionize(i: Inputs):
    return _session_rows(sessions.sessionize(_open_events(i)))


@query("sessionize_gap", oracle("e", f"""{SESSION_BASE},
g AS (SELECT *, LAG(pt) OVER (PARTITION BY anonymous_id ORDER BY rn) AS pv FROM o),
h AS (SELECT *, CASE WHEN pv IS NULL OR pt - pv >= INTERVAL 30 MINUTE THEN pt END AS op FROM g)
SELECT {S}, id, anonymous_id, strftime(MAX(op) OVER (PARTITION BY anonymous_id ORDER BY rn ROWS UNBOUNDED PRECEDING), '%Y-%m-%d %H:%M:%S.%f')
  AS session_start FROM h"""))
def sessionize_gap(i: Inputs):
    return _session_rows(sessions.sessionize(_open_events(i), "gap"))

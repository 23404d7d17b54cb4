"""Visitors, leads, identity links and protected personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import hmac_sha256
from trailmark.operators.blocks import as_of
from trailmark.params import SCOPE

VISITOR = [*SCOPE, "anonymous_id"]
LINK = [*VISITOR, "lead_key"]


def visitors(events: DataFrame) -> DataFrame:
    """First and last seen, campaign of the first event (even none), last known campaign, device and place."""
    order = F.struct("timestamp", "id")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    return events.groupBy(*VISITOR).agg(
        F.min("timestamp").alias("first_seen_at"), F.max("timestamp").alias("last_seen_at"),
        F.min_by("utm", order).alias("first_utm"), latest("utm").alias("last_utm"),
        latest("device").alias("last_device"), latest("geo").alias("last_geo"))


ORDER = "struct<timestamp: timestamp, id: bigint>"
VISITORS = f"""tenant_id bigint, workspace_id bigint, anonymous_id string, first_seen_at timestamp, last_seen_at timestamp,
  first_utm struct<source:string,medium:string,campaign:string,term:string,content:string>, first_order {ORDER},
  last_utm struct<source:string,medium:string,campaign:string,term:string,content:string>, utm_order {ORDER},
  last_device struct<type:string>, device_order {ORDER}, last_geo struct<country:string>, geo_order {ORDER}"""


def visitor_changes(events: DataFrame) -> DataFrame:
    """Visitors of some events as rows that `fold_visitors` merges with those stored."""
    order = F.struct("timestamp", "id")
    known = {c: F.when(F.col(c).isNotNull(), order) for c in ("utm", "device", "geo")}
    return events.groupBy(*VISITOR).agg(
        F.min("timestamp").alias("first_seen_at"), F.max("timestamp").alias("last_seen_at"), F.min_by("utm", order).alias("first_utm"),
        F.min(order).alias("first_order"),
        *(x for c, at in known.items() for x in (F.max_by(c, at).alias(f"last_{c}"), F.max(at).alias(f"{c}_order"))))


def fold_visitors(rows: DataFrame) -> DataFrame:
    """One row per visitor; the order of batches does not matter, nor that rows are folded again."""
    return rows.groupBy(*VISITOR).agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.min_by("first_utm", "first_order").alias("first_utm"), F.min("first_order").alias("first_order"),
        *(x for c in ("utm", "device", "geo") for x in (
            F.max_by(f"last_{c}", f"{c}_order").alias(f"last_{c}"), F.max(f"{c}_order").alias(f"{c}_order"))))


# --------------------------------------------------------------- fingerprints
def normal_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def normal_phone(phone: Column) -> Column:
    return F.regexp_replace(phone, r"\D", "")


def with_fingerprints(identifies: DataFrame, email_key: bytes, phone_key: bytes) -> DataFrame:
    """Adds keyed fingerprints of the normalised e-mail and phone; keys come from the caller's secrets."""
    present = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return identifies.withColumns({
        "email_fingerprint": F.when(present("email"), hmac_sha256(normal_email(F.col("email")), email_key)),
        "phone_fingerprint": F.when(present("phone"), hmac_sha256(normal_phone(F.col("phone")), phone_key))})


# ---------------------------------------------------------------------- leads
def lead_key(email_fp: Column, phone_fp: Column, row_id: Column) -> Column:
    """An identify's own lead: by e-mail, else by phone, else a lead of its own."""
    return F.coalesce(F.concat(F.lit("e:"), email_fp), F.concat(F.lit("p:"), phone_fp),
                      F.concat(F.lit("n:"), row_id.cast("string")))


def email_leads(identifies: DataFrame) -> DataFrame:
    """One row per lead known by e-mail with its latest phone."""
    order = F.struct("timestamp", "id")
    return identifies.where(F.col("email_fingerprint").isNotNull()).groupBy(*SCOPE, "email_fingerprint").agg(
        F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"),
        F.max_by("phone_fingerprint", F.when(F.col("phone_fingerprint").isNotNull(), order)).alias("phone_fingerprint"))


def resolve_identifies(identifies: DataFrame) -> DataFrame:
    """Each identify with the lead it belongs to.

    An e-mail decides; a phone counts only without an e-mail, and then finds the e-mail lead that holds the
    phone after the batch (the oldest, if several do). The lookup has one row per phone, so a phone that a
    third of the identifies share is a skewed but splittable join; only identifies that need it take part.
    """
    holders = email_leads(identifies).where(F.col("phone_fingerprint").isNotNull()).groupBy(
        *SCOPE, "phone_fingerprint").agg(F.min(F.struct("created_at", "email_fingerprint")).alias("_holder"))
    own = lead_key(F.col("email_fingerprint"), F.col("phone_fingerprint"), F.col("id"))
    by_phone = F.coalesce(F.concat(F.lit("e:"), F.col("_holder.email_fingerprint")), own)
    needs = F.col("email_fingerprint").isNull() & F.col("phone_fingerprint").isNotNull()
    asked = identifies.where(needs).join(holders, [*SCOPE, "phone_fingerprint"], "left").select(
        *identifies.columns, by_phone.alias("lead_key"))
    return asked.unionByName(identifies.where(~needs).withColumn("lead_key", own))


def resolve_leads(resolved: DataFrame) -> DataFrame:
    """One row per lead: fingerprints, first and last identify. Later phones replace earlier ones."""
    order = F.struct("timestamp", "id")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return resolved.groupBy(*SCOPE, "lead_key").agg(
        latest("email_fingerprint"), latest("phone_fingerprint"), F.min("timestamp").alias("created_at"),
        F.max("timestamp").alias("updated_at"), F.count("*").alias("identifies"))


def identity_links(resolved: DataFrame) -> DataFrame:
    """Visitor and lead pairs with the first and last time they were linked."""
    return resolved.groupBy(*LINK).agg(F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def latest_link(links: DataFrame) -> DataFrame:
    """The lead each visitor was linked to last."""
    return links.groupBy(*VISITOR).agg(F.max_by("lead_key", F.struct("last_at", "lead_key")).alias("lead_key"))


def link_leads(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Events with the lead their visitor was linked to at that time."""
    updates = resolved.select(*VISITOR, "timestamp", "lead_key")
    return as_of(events, updates, VISITOR, "lead_key")


# ------------------------------------------------------------------ protection
def encrypt(value: Column, key: Column, kind: str, key_version: int, iv: Column | None = None) -> Column:
    """AES-256-GCM as base64, bound to `<kind>:<key version>`. Layout: iv, ciphertext, tag."""
    aad = F.lit(f"{kind}:{key_version}")
    fresh = F.lit("").cast("binary")  # an empty iv makes Spark draw a random one per value
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), fresh if iv is None else iv, aad))


def decrypt(value: Column, key: Column, kind: str, key_version: int) -> Column:
    aad = F.lit(f"{kind}:{key_version}")
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


def encrypt_pii(identifies: DataFrame, key: Column, key_version: int) -> DataFrame:
    """Replaces e-mail and phone by their encrypted forms and the key version."""
    return identifies.withColumns({
        "email_enc": encrypt(normal_email(F.col("email")), key, "email", key_version),
        "phone_enc": encrypt(normal_phone(F.col("phone")), key, "phone", key_version),
        "key_version": F.lit(key_version)}).drop("email", "phone")


def reencrypt_pii(leads: DataFrame, old_key: Column, old_version: int, new_key: Column, new_version: int) -> DataFrame:
    """Key rotation in one pass: decrypt with the old key, encrypt with the new one."""
    rotate = lambda c, kind: encrypt(decrypt(F.col(c), old_key, kind, old_version), new_key, kind, new_version)
    return leads.withColumns({"email_enc": rotate("email_enc", "email"), "phone_enc": rotate("phone_enc", "phone"),
                              "key_version": F.lit(new_version)})


def anonymize_columns(df: DataFrame, columns: list[str], salt: str = "", legacy: bool = False) -> DataFrame:
    """Salted SHA-256 of the columns; `legacy` gives the short `hash_<length>_<first two>***` form."""
    def hidden(name: str) -> Column:
        value = F.col(name).cast("string")
        if legacy:
            return F.concat(F.lit("hash_"), F.length(value).cast("string"), F.lit("_"), F.substring(value, 1, 2), F.lit("***"))
        return F.sha2(F.concat(F.lit(salt), value), 256)

    return df.withColumns({c: hidden(c) for c in columns})

"""Leads that outlive a batch: identifies are upserted into stored leads.

An e-mail decides which lead an identify belongs to. A phone without an e-mail finds the lead that holds the phone by
then, whichever batch made it: the e-mail lead that held it first, else the lead of the phone itself. Three keyed tables
change together: leads, links of visitors to leads, and holders, which lead to an e-mail lead from its present phone, so
that a batch looks only into the buckets of its own phones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.identity import LINK, lead_key
from trailmark.params import SCOPE
from trailmark.sources.keyed import BUCKETS, Keyed, KeyedStore

ORDER = "struct<timestamp: timestamp, id: bigint>"
LEAD = "tenant_id bigint, workspace_id bigint, lead_key string"
LEADS = f"""{LEAD}, email_fingerprint string, email_order {ORDER}, email_enc string, email_key_version int,
  phone_fingerprint string, phone_order {ORDER}, phone_enc string, phone_key_version int,
  created_at timestamp, updated_at timestamp, identifies bigint"""
LINKS = "tenant_id bigint, workspace_id bigint, anonymous_id string, lead_key string, first_at timestamp, last_at timestamp"
HOLDERS = """tenant_id bigint, workspace_id bigint, phone_fingerprint string, email_fingerprint string, since timestamp,
  as_of bigint, held boolean"""
PHONE = [*SCOPE, "phone_fingerprint"]


def lead_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, path, {
        "leads": Keyed(LEADS, [*SCOPE, "lead_key"], buckets), "links": Keyed(LINKS, [*SCOPE, "anonymous_id"], buckets),
        "holders": Keyed(HOLDERS, PHONE, buckets)})


def fold_leads(rows: DataFrame) -> DataFrame:
    """One row per lead: its first e-mail, its latest phone, first and last identify."""
    first = lambda c: F.min_by(c, "email_order").alias(c)
    latest = lambda c: F.max_by(c, "phone_order").alias(c)
    return rows.groupBy(*SCOPE, "lead_key").agg(
        F.max("email_fingerprint").alias("email_fingerprint"), first("email_enc"), first("email_key_version"),
        F.min("email_order").alias("email_order"), latest("phone_fingerprint"), latest("phone_enc"),
        latest("phone_key_version"), F.max("phone_order").alias("phone_order"), F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"), F.sum("identifies").alias("identifies"))


def fold_links(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*LINK).agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def fold_holders(rows: DataFrame) -> DataFrame:
    """Who holds each phone; what was given up last is gone."""
    latest = F.max(F.struct("as_of", "held", "since")).alias("_l")
    return rows.groupBy(*PHONE, "email_fingerprint").agg(latest).where("_l.held").select(
        *PHONE, "email_fingerprint", "_l.since", "_l.as_of", "_l.held")


def _change(rows: DataFrame, key: Column, with_phone: Column) -> DataFrame:
    """Each identify as a change of its lead. `with_phone`: whether its phone becomes the lead's."""
    order = F.struct("timestamp", "id")
    mail, phone = F.col("email_fingerprint").isNotNull(), F.col("phone_fingerprint").isNotNull() & with_phone
    given = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    return rows.select(
        *SCOPE, key.alias("lead_key"), "email_fingerprint", F.when(mail, order).alias("email_order"),
        F.when(mail, given("email_enc", "string")).alias("email_enc"),
        F.when(mail, given("key_version", "int")).cast("int").alias("email_key_version"),
        F.when(phone, F.col("phone_fingerprint")).alias("phone_fingerprint"), F.when(phone, order).alias("phone_order"),
        F.when(phone, given("phone_enc", "string")).alias("phone_enc"),
        F.when(phone, given("key_version", "int")).cast("int").alias("phone_key_version"),
        F.col("timestamp").alias("created_at"), F.col("timestamp").alias("updated_at"), F.lit(1).cast("bigint").alias("identifies"))


def holder_changes(store: KeyedStore, identifies: DataFrame, batch: int) -> DataFrame:
    """Phones that the batch's e-mail leads take or give up, against their stored rows.

    The stored row is aggregated with the batch's rows of the lead, so no join and no second look at it is needed.
    """
    mails = identifies.where(F.col("email_fingerprint").isNotNull())
    own = lead_key(F.col("email_fingerprint"), F.col("phone_fingerprint"), F.col("id"))
    changes = _change(mails, own, F.lit(True))
    stored = store.read("leads", store.buckets_of("leads", changes))
    both = stored.withColumn("_stored", F.lit(True)).unionByName(changes.withColumn("_stored", F.lit(False)))
    leads = both.groupBy(*SCOPE, "lead_key").agg(
        F.max("email_fingerprint").alias("email_fingerprint"), F.min("email_order.timestamp").alias("since"),
        F.max(F.when(F.col("_stored"), F.col("phone_fingerprint"))).alias("old"),
        F.min(F.when(F.col("_stored"), F.col("email_order.timestamp"))).alias("_old_since"),
        F.max_by("phone_fingerprint", "phone_order").alias("new"), F.bool_or(~F.col("_stored")).alias("touched"))
    moved = leads.where("touched and (not (old <=> new) or not (_old_since <=> since))")
    entries = F.array(F.struct(F.col("old").alias("phone_fingerprint"), F.lit(False).alias("held")),
                      F.struct(F.col("new").alias("phone_fingerprint"), F.lit(True).alias("held")))
    return moved.select(*SCOPE, "email_fingerprint", "since", F.explode(entries).alias("_e")).select(
        *SCOPE, "_e.phone_fingerprint", "email_fingerprint", "since", F.lit(batch).cast("bigint").alias("as_of"), "_e.held").where(
        "phone_fingerprint is not null")


def upsert_leads(store: KeyedStore, identifies: DataFrame, batch_id: int, writer: str = "identifies") -> bool:
    """Applies a batch of identifies with fingerprints (see `identity.with_fingerprints`); False if it was applied before.

    Columns email_enc, phone_enc and key_version are kept if they are there. The result depends on the batches only by
    what a phone-only identify finds: who holds its phone after its batch.
    """
    version = store.version()
    if version.batches.get(writer, -1) >= batch_id:
        return False
    alone = F.col("email_fingerprint").isNull() & F.col("phone_fingerprint").isNotNull()
    own = lead_key(F.col("email_fingerprint"), F.col("phone_fingerprint"), F.col("id"))
    with store.staged(identifies) as [batch]:
        asked = batch.where(alone)
        with store.staged(holder_changes(store, batch, version.number)) as [taken]:
            known = store.read("holders", store.buckets_of("holders", asked), version)
            owner = fold_holders(known.unionByName(taken)).groupBy(*PHONE).agg(
                F.min(F.struct("since", "email_fingerprint"))["email_fingerprint"].alias("_owner"))
            found = asked.join(owner, PHONE, "left").withColumn("lead_key", F.coalesce(F.concat(F.lit("e:"), "_owner"), own)).drop("_owner")
            with store.staged(found.unionByName(batch.where(~alone).withColumn("lead_key", own))) as [resolved]:
                by_phone = F.col("email_fingerprint").isNotNull() | F.col("lead_key").startswith("p:")
                links = resolved.select(*LINK, F.col("timestamp").alias("first_at"), F.col("timestamp").alias("last_at"))
                return store.upsert({
                    "leads": (fold_leads(_change(resolved, F.col("lead_key"), by_phone)), fold_leads),
                    "links": (fold_links(links), fold_links), "holders": (taken, fold_holders)}, writer, batch_id)


def lead_writer(store: KeyedStore):
    """foreachBatch function for a stream of identifies with fingerprints."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_leads(store, batch, batch_id, "stream:identifies")

    return write


def lead_id(lead: Column | str = "lead_key") -> Column:
    """The number of a lead, as reports know it: a hash of tenant, workspace and key."""
    return F.when(F.col(lead).isNotNull() if isinstance(lead, str) else lead.isNotNull(), F.xxhash64(*SCOPE, lead))

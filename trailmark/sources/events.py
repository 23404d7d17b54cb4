"""Canonical event rows and the adapter from the raw `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.params import Period, SCOPE

RAW_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EVENT_SCHEMA = """
  id bigint, event_id string, schema_version string, event_name string, timestamp timestamp,
  tenant_id bigint, workspace_id bigint, anonymous_id string, lead_id bigint, session_id string,
  page struct<url:string,title:string,referrer:string,path:string>,
  utm struct<source:string,medium:string,campaign:string,term:string,content:string>,
  device struct<type:string>, geo struct<country:string>, props string, ingested_at timestamp
"""


def _pick(key: Column, *choices: tuple[Column, str]) -> Column:
    result = None
    for condition, value in choices:
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result


def canonical_events(spark: SparkSession, sf_dir: str, leads: bool = True) -> DataFrame:
    """Raw rows as canonical events. A visitor is one user on one day.

    `leads=False` leaves out the lead (a join on first sign-up) where a query has no use for it.
    """
    at = F.col("ts").cast("timestamp")
    raw = spark.read.schema(RAW_SCHEMA).parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "event_type", "value", "props", at.alias("_at"),
        F.get_json_object("props", "$.k").cast("int").alias("_k"), F.date_format(at, "yyyyMMdd").alias("_day"),
    )
    at, k, day = F.col("_at"), F.col("_k"), F.col("_day")
    user = F.col("user_id").cast("string")
    text = F.lit(None).cast("string")

    events = raw.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("e_"), F.col("event_id").cast("string")).alias("event_id"),
        F.lit("1.0.0").alias("schema_version"),
        F.col("event_type").alias("event_name"),
        at.alias("timestamp"),
        F.lit(1).cast("bigint").alias("tenant_id"),
        (F.col("user_id") % 3 + 1).cast("bigint").alias("workspace_id"),
        F.concat(F.lit("a_"), user, F.lit("_"), day).alias("anonymous_id"),
        F.concat(F.lit("s_"), user, F.lit("_"), day, F.lit("_"), F.floor(F.hour(at) / 6).cast("string"))
        .alias("session_id"),
        F.when(
            F.col("event_type").isin("view", "click", "signup"),
            F.concat(F.lit("https://example.com/"), F.col("event_type")),
        ).alias("_url"),
        _pick(k, (k % 4 == 0, "https://www.google.com/search"), (k % 4 == 2, "https://social.example/x"),
              (k % 4 == 3, "https://blog.example/y")).alias("_referrer"),
        _pick(k, (k < 20, "google"), (k < 40, "facebook"), (k < 55, "email")).alias("_source"),
        _pick(k, (k < 20, "cpc"), (k < 40, "social"), (k < 55, "newsletter")).alias("_medium"),
        _pick(k, (k % 3 == 0, "desktop"), (k % 3 == 1, "mobile")).alias("_device"),
        _pick(k, (k % 5 == 0, "BR"), (k % 5 == 1, "US"), (k % 5 == 2, "GB"), (k % 5 == 3, "DE")).alias("_country"),
        "props",
        "value",
        "user_id",
    )
    events = events.select(
        "id", "event_id", "schema_version", "event_name", "timestamp", *SCOPE, "anonymous_id", "session_id",
        F.when(
            F.col("_url").isNotNull() | F.col("_referrer").isNotNull(),
            F.struct(F.col("_url").alias("url"), text.alias("title"), F.col("_referrer").alias("referrer"),
                     F.regexp_extract("_url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path")),
        ).alias("page"),
        F.when(
            F.col("_source").isNotNull(),
            F.struct(F.col("_source").alias("source"), F.col("_medium").alias("medium"), text.alias("campaign"),
                     text.alias("term"), text.alias("content")),
        ).alias("utm"),
        F.struct(F.coalesce("_device", F.lit("tablet")).alias("type")).alias("device"),
        F.when(F.col("_country").isNotNull(), F.struct(F.col("_country").alias("country"))).alias("geo"),
        "props", F.col("timestamp").alias("ingested_at"), "value", "user_id",
    )
    return _with_leads(events) if leads else events.drop("user_id")


def _with_leads(events: DataFrame) -> DataFrame:
    """From the first sign-up on, an event belongs to the lead.

    The first sign-up is one row per visitor after map-side combination, so a visitor with very many
    events costs a skewed but splittable join and no per-visitor window.
    """
    signup = (
        events.where(F.col("event_name") == "signup")
        .groupBy("anonymous_id")
        .agg(F.min(F.struct("timestamp", "id")).alias("_signup"))
    )
    identified = F.struct("timestamp", "id") >= F.col("_signup")
    return (
        events.join(signup, "anonymous_id", "left")
        .withColumn("lead_id", F.when(identified, F.col("user_id")))
        .drop("_signup", "user_id")
    )


def derive_sessions(events: DataFrame) -> DataFrame:
    """One row per client session."""
    return events.groupBy(*SCOPE, "session_id", "anonymous_id").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at")
    )


# ------------------------------------------------------------------- scoping
def tenant_scope(df: DataFrame, tenant_id: int, workspace_id: int | None = None) -> DataFrame:
    """Every read of one tenant goes through here; the predicate reaches the scan."""
    df = df.where(F.col("tenant_id") == F.lit(tenant_id).cast("bigint"))
    return df if workspace_id is None else df.where(F.col("workspace_id") == F.lit(workspace_id).cast("bigint"))


def scan_events(events: DataFrame, period: Period) -> DataFrame:
    return events.where(period.contains("timestamp"))


def scan_sessions(sessions: DataFrame, period: Period) -> DataFrame:
    return sessions.where(period.contains("started_at"))


def scan_funnel_state(state: DataFrame, period: Period, funnel_id: int | None = None) -> DataFrame:
    state = state.where(period.contains("entered_at"))
    return state if funnel_id is None else state.where(F.col("funnel_id") == funnel_id)


# -------------------------------------------------------------- event storage
def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Event store layout: tenant and day folders, sorted inside files by visitor and time.

    The rebalance hint lets adaptive execution split a large tenant's day over many tasks and files and join
    small ones, at the session's advisory partition size.
    """
    (
        events.withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", "tenant_id", "event_date")
        .sortWithinPartitions("tenant_id", "event_date", "workspace_id", "anonymous_id", "timestamp")
        .write.mode(mode).partitionBy("tenant_id", "event_date").parquet(path)
    )


def read_events(spark: SparkSession, path: str, period: Period | None = None) -> DataFrame:
    events = spark.read.parquet(path)
    if period is None:
        return events
    days = F.col("event_date").between(F.lit(period.start.date()), F.lit(period.end.date()))
    return events.where(days & period.contains("timestamp"))

"""Streaming ingest: the batch checks and enrichment over a payload stream, plus bounded deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import ingest
from trailmark.operators.identity import VISITOR, latest_link

LATENESS = "5 minutes"


def checked(payloads: DataFrame) -> DataFrame:
    """Payloads with `errors`, a time off arrival by more than five minutes among them."""
    body = payloads.withColumn("payload", F.to_json(F.struct(*payloads.columns)))
    rows = ingest.validate_events(body).drop("payload")
    off = ingest.timestamp_error(F.col("event_time"), F.col("ingested_at"))
    late = F.when(F.col("event_time").isNotNull(), off)
    return rows.withColumn("errors", F.concat("errors", F.when(late.isNotNull(), F.array(late)).otherwise(
        F.array().cast("array<string>"))))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): two streams of one source, so a bad payload never stops a good one."""
    return ingest.split_valid(rows)


def events_of(valid: DataFrame) -> DataFrame:
    """Canonical events of valid payloads."""
    return valid.select(
        "id", "event_id", ingest.schema_version(F.col("schema_version")).alias("schema_version"), "event_name",
        F.col("event_time").alias("timestamp"), "tenant_id", "workspace_id", "anonymous_id",
        F.lit(None).cast("bigint").alias("lead_id"), "session_id",
        F.when(F.col("page").isNotNull(), F.struct(
            F.col("page.url").alias("url"), F.col("page.title").alias("title"), F.col("page.referrer").alias("referrer"),
            ingest.page_path(F.col("page.path"), F.col("page.url")).alias("path"))).alias("page"),
        "utm", F.when(F.col("device").isNotNull(), F.struct(F.get_json_object("device", "$.type").alias("type"))).alias("device"),
        F.when(F.col("geo").isNotNull(), F.struct(F.get_json_object("geo", "$.country").alias("country"))).alias("geo"),
        F.col("properties").alias("props"), "ingested_at")


def with_latest_lead(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events with the lead their visitor is linked to: a stream-static join, read anew in every micro-batch."""
    return events.join(latest_link(links), VISITOR, "left")


def deduplicated(events: DataFrame, at: str = "timestamp") -> DataFrame:
    """First arrival of each (tenant, event_id); keys are forgotten once the watermark has passed them.

    Rows without an event_id get a key of their own, so they are never dropped.
    """
    keyed = events.withColumn("_key", F.coalesce("event_id", F.expr("concat('~', uuid())")))
    return keyed.withWatermark(at, LATENESS).dropDuplicatesWithinWatermark(["tenant_id", "_key"]).drop("_key")

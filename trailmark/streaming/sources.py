"""Streaming sources of track and identify payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Payload fields; device, geo and properties stay JSON text until they are validated.
TRACK_SCHEMA = """
  id bigint, tenant_id bigint, workspace_id bigint, batch_id bigint, event_id string, event_name string,
  timestamp string, anonymous_id string, session_id string, properties string, device string, geo string,
  page struct<url:string,title:string,referrer:string,path:string>,
  utm struct<source:string,medium:string,campaign:string,term:string,content:string>,
  schema_version string, ingested_at timestamp
"""
IDENTIFY_SCHEMA = """
  id bigint, tenant_id bigint, workspace_id bigint, anonymous_id string, user_id string, email string, phone string,
  timestamp timestamp
"""


def payload_stream(spark: SparkSession, path: str, schema: str = TRACK_SCHEMA, fmt: str = "json",
                   max_files: int | None = None) -> DataFrame:
    """Payload files of a directory, as they arrive."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def from_messages(messages: DataFrame, schema: str = TRACK_SCHEMA) -> DataFrame:
    """Payloads out of a message log's `value` column (Kafka-shaped sources)."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("_p")).select("_p.*")

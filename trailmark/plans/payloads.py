"""Raw payloads as clients would send them, derived row by row from the given events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.params import SCOPE

# Keys of the demonstration queries only; real keys come from the caller.
DEMO_EMAIL_KEY, DEMO_PHONE_KEY = b"demonstration e-mail key", b"demonstration phone key"
DEMO_AES_KEY = "0123456789abcdef0123456789abcdef"
DEMO_AES_KEY_2 = "fedcba9876543210fedcba9876543210"

USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.6099.109 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Safari/605.1.15",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.6099.144 Mobile Safari/537.36",
    "Opera/9.80 (Android; Opera Mini/36.2) Presto/2.12.423 Version/12.16",
]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    day = F.date_format(at, "yyyyMMdd")
    user = F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k").cast("int")
    # explode keeps filters from pulling the JSON parse up once per use of k
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.explode(F.array(k))).select(
        F.col("event_id").alias("id"), F.lit(1).cast("bigint").alias("tenant_id"),
        (F.col("user_id") % 3 + 1).cast("bigint").alias("workspace_id"), "user_id", F.col("event_type").alias("name"),
        at.alias("at"), "k", "props",
        F.concat(F.lit("a_"), user, F.lit("_"), day).alias("visitor"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track payloads with every kind of defect, duplicates, late and early arrivals."""
    k = F.col("k")
    text = lambda value: F.lit(value)
    return raw(spark, sf_dir).select(
        "id", *SCOPE, F.floor(F.col("id") / 60).alias("batch_id"),
        F.when(k % 17 == 0, "").when(k % 19 == 0, F.repeat(F.lit("x"), 101)).otherwise(F.col("name")).alias("event_name"),
        F.when(k % 31 == 0, "not a time").otherwise(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.when(k % 13 == 0, F.concat(F.lit("bad-"), F.col("user_id").cast("string"))).otherwise(F.col("visitor"))
        .alias("anonymous_id"),
        F.when(k % 23 == 0, "x_1").when(k % 2 == 0, F.concat(F.lit("s_"), F.col("user_id").cast("string")))
        .alias("session_id"),
        F.when(k % 29 != 0, F.concat(F.lit("e_"), F.floor(F.col("id") / 3).cast("string"))).alias("event_id"),
        F.when(k % 37 == 0, text('"phone"')).otherwise(text('{"type": "mobile"}')).alias("device"),
        F.when(k % 41 == 0, text("[1]")).when(k % 2 == 0, text('{"country": "BR"}')).alias("geo"),
        F.when((k == 97) & (F.col("id") % 10 == 0), F.repeat("props", 30000)).otherwise(F.col("props")).alias("payload"),
        F.timestamp_micros(F.unix_micros("at") + (k % 12 - 6) * 60_000_000).alias("ingested_at"), F.col("at"), "k")


def identifies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identify payloads: one per sign-up, with e-mails in several spellings, phones, both or neither."""
    k, person = F.col("k"), F.floor(F.col("user_id") / 3).cast("string")
    return raw(spark, sf_dir).where("name = 'signup'").select(
        "id", *SCOPE, F.col("visitor").alias("anonymous_id"), F.col("at").alias("timestamp"),
        F.when(k % 10 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user_id"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, F.concat(F.lit(" User"), person, F.lit("@Example.COM ")))
        .otherwise(F.concat(F.lit("user"), person, F.lit("@example.com"))).alias("email"),
        F.when(k % 3 == 0, F.concat(F.lit("+55 (11) 9000-"), F.floor(F.col("user_id") / 4).cast("string"))).alias("phone"),
        "k")

"""Keyed sinks for micro-batches.

A micro-batch writes its changes to a folder of its own, so replaying it overwrites the same folder and
changes nothing. A reader folds the changes; every fold used here is associative, so `compact` may replace
many small folders by one at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.params import FUNNEL, SCOPE

Fold = Callable[[DataFrame], DataFrame]


def fold_state(changes: DataFrame) -> DataFrame:
    """Latest funnel state per user; update-mode rows already carry the whole aggregate."""
    keys = [*FUNNEL, "anonymous_id"]
    row = F.struct(*[c for c in changes.columns if c not in keys])
    newest = F.struct("last_activity_at", "current_step_index", F.col("completed_at").isNotNull(), "_batch")
    return changes.groupBy(*keys).agg(F.max_by(row, newest).alias("_r")).select(*keys, "_r.*")


def fold_links(changes: DataFrame) -> DataFrame:
    keys = [*SCOPE, "anonymous_id", "lead_key"]
    return changes.groupBy(*keys).agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
                                      F.max("_batch").alias("_batch"))


def fold_visitors(changes: DataFrame) -> DataFrame:
    keys = [*SCOPE, "anonymous_id"]
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last_seen_at"))).alias(c)
    return changes.groupBy(*keys).agg(
        F.min_by("first_utm", "first_seen_at").alias("first_utm"), F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"), latest("last_utm"), latest("last_device"), latest("last_geo"),
        F.max("_batch").alias("_batch"))


def change_writer(path: str, prepare: Fold | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that writes a batch's changes to `path/batch=<id>`."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_folded(spark: SparkSession, path: str, fold: Fold) -> DataFrame:
    return fold(spark.read.option("basePath", path).parquet(path).drop("batch")).drop("_batch")


def compact(spark: SparkSession, path: str, fold: Fold, into: str) -> None:
    """Folds all changes into a fresh folder; the caller points readers and the next writer at it.

    The folded history stands before batch 0, so a writer with a fresh checkpoint cannot overwrite it.
    """
    fold(spark.read.option("basePath", path).parquet(path).drop("batch")).write.mode("errorifexists").parquet(
        f"{into}/batch=-1")

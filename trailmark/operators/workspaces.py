"""Workspace and tenant reports over the event table, all of them in one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.params import SCOPE


def _with_counts(base: DataFrame, keys: list[str], counts: dict[str, DataFrame]) -> DataFrame:
    for name, frame in counts.items():
        base = base.join(frame.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left").withColumn(
            name, F.coalesce(name, F.lit(0).cast("bigint")))
    return base


def workspace_stats(events: DataFrame, **counts: DataFrame) -> DataFrame:
    """Events, visitors and last activity per workspace, with the live rows of each given small table.

    `counts` maps an output column to a table with the scope columns (live funnels, active keys, active users).
    """
    visitors = events.groupBy(*SCOPE, "anonymous_id").agg(F.count("*").alias("n"), F.max("timestamp").alias("t"))
    base = visitors.groupBy(*SCOPE).agg(
        F.sum("n").alias("events"), F.count("*").alias("visitors"), F.max("t").alias("last_activity"))
    return _with_counts(base, SCOPE, counts)


def workspace_impact(events: DataFrame, **counts: DataFrame) -> DataFrame:
    """What deleting each workspace would remove."""
    return _with_counts(events.groupBy(*SCOPE).agg(F.count("*").alias("events")), SCOPE, counts)


def tenant_stats(events: DataFrame, **counts: DataFrame) -> DataFrame:
    """Workspaces with events, events and last activity per tenant."""
    by_workspace = events.groupBy(*SCOPE).agg(F.count("*").alias("n"), F.max("timestamp").alias("t"))
    base = by_workspace.groupBy("tenant_id").agg(
        F.count("*").alias("workspaces"), F.sum("n").alias("events"), F.max("t").alias("last_activity"))
    return _with_counts(base, ["tenant_id"], counts)

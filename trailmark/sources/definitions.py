"""Funnel definitions: the small dimension tables, their resolution and their checks."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.params import SCOPE

FUNNEL_SCHEMA = "id bigint, tenant_id bigint, workspace_id bigint, name string, created_at timestamp, archived_at timestamp"
VERSION_SCHEMA = "id bigint, funnel_id bigint, version int, state string, created_at timestamp"
PUBLICATION_SCHEMA = "id bigint, funnel_id bigint, version int, published_at timestamp, window_days int"
STEP_SCHEMA = "id bigint, funnel_version_id bigint, order_index int, type string, label string"
MATCH_SCHEMA = "id bigint, funnel_step_id bigint, kind string, rules string"

ARROW_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
               "double": pa.float64(), "timestamp": pa.timestamp("us", tz="UTC")}

# One row per (step, rule). A step with several rules matches when any of them does.
DEFINITION_COLUMNS = [
    *SCOPE, "funnel_id", "funnel_name", "funnel_version_id", "version", "window_days", "total_steps",
    "order_index", "step_type", "step_label", "kind", "rules",
]


def local_table(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """A small local relation: Spark knows its size, so joins with it need no hint to be cheap."""
    struct = T.StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, ARROW_TYPES[f.dataType.simpleString()]) for f in struct])
    columns = list(zip(*rows)) or [()] * len(struct)
    table = pa.Table.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, struct)


class Definitions:
    """The five dimension tables of the funnel builder."""

    def __init__(self, funnels: DataFrame, versions: DataFrame, publications: DataFrame, steps: DataFrame,
                 matches: DataFrame) -> None:
        self.funnels = funnels
        self.versions = versions
        self.publications = publications
        self.steps = steps
        self.matches = matches

    @classmethod
    def from_rows(cls, spark: SparkSession, funnels: Iterable, versions: Iterable, publications: Iterable,
                  steps: Iterable, matches: Iterable) -> Definitions:
        def make(rows, schema):
            return local_table(spark, rows, schema)

        return cls(make(funnels, FUNNEL_SCHEMA), make(versions, VERSION_SCHEMA),
                   make(publications, PUBLICATION_SCHEMA), make(steps, STEP_SCHEMA), make(matches, MATCH_SCHEMA))

    def latest(self, published_only: bool = True) -> DataFrame:
        """Latest (published) version of every live funnel."""
        versions = self.versions
        if published_only:
            versions = versions.where(F.lower("state") == "published")
        versions = versions.groupBy("funnel_id").agg(
            F.max(F.struct("version", "id")).alias("_v")
        ).select("funnel_id", F.col("_v.id").alias("funnel_version_id"), F.col("_v.version").alias("version"))
        window_days = self.publications.groupBy("funnel_id").agg(
            F.max_by("window_days", F.struct("published_at", "id")).alias("window_days")
        )
        return (
            self.funnels.where(F.col("archived_at").isNull())
            .select(F.col("id").alias("funnel_id"), *SCOPE, F.col("name").alias("funnel_name"))
            .join(versions, "funnel_id")
            .join(window_days, "funnel_id", "left")
        )

    def steps_of_latest(self, published_only: bool = True) -> DataFrame:
        """One row per step of the latest version, with the funnel's step count."""
        latest = self.latest(published_only)
        total = self.steps.groupBy("funnel_version_id").agg(F.count("*").cast("int").alias("total_steps"))
        steps = self.steps.select(
            F.col("id").alias("step_id"), "funnel_version_id", "order_index",
            F.col("type").alias("step_type"), F.col("label").alias("step_label"),
        )
        return latest.join(total, "funnel_version_id").join(steps, "funnel_version_id")

    def load(self, published_only: bool = True) -> DataFrame:
        """One row per rule of the latest version (DEFINITION_COLUMNS)."""
        rules = self.matches.select(F.col("funnel_step_id").alias("step_id"), "kind", "rules")
        return self.steps_of_latest(published_only).join(rules, "step_id", "left").select(*DEFINITION_COLUMNS)


def validate_funnel_defs(steps: DataFrame) -> DataFrame:
    """Violations per version: unique and consecutive order from 0, a start and a conversion step."""
    facts = steps.groupBy("funnel_version_id").agg(
        F.count("*").alias("steps"),
        F.countDistinct("order_index").alias("orders"),
        F.min("order_index").alias("first_order"),
        F.max("order_index").alias("last_order"),
        F.coalesce(F.bool_or(F.col("type") == "start"), F.lit(False)).alias("has_start"),
        F.coalesce(F.bool_or(F.col("type") == "conversion"), F.lit(False)).alias("has_conversion"),
    )
    gap = (F.col("first_order") != 0) | (F.col("last_order") != F.col("steps") - 1) | (
        F.col("orders") != F.col("steps"))
    found = F.array(
        F.when(F.col("orders") != F.col("steps"), "duplicate_order"),
        F.when(gap, "order_not_consecutive"),
        F.when(~F.col("has_start"), "no_start_step"),
        F.when(~F.col("has_conversion"), "no_conversion_step"),
    )
    return facts.select("funnel_version_id", F.explode(F.filter(found, lambda v: v.isNotNull())).alias("violation"))


def funnel_inventory(definitions: Definitions) -> DataFrame:
    """Per workspace: all funnels, those with a draft, with a published version, and archived ones."""
    states = definitions.versions.groupBy(F.col("funnel_id").alias("id")).agg(
        F.bool_or(F.lower("state") == "draft").alias("draft"),
        F.bool_or(F.lower("state") == "published").alias("published"),
    )
    archived = F.col("archived_at").isNotNull()
    has = lambda name: ~archived & F.coalesce(F.col(name), F.lit(False))
    return definitions.funnels.join(states, "id", "left").groupBy(*SCOPE).agg(
        F.count_if(~archived).alias("total_funnels"),
        F.count_if(has("draft")).alias("with_draft"),
        F.count_if(has("published")).alias("with_published"),
        F.count_if(archived).alias("archived_funnels"),
    )

"""Exports: step metrics as CSV, reports as JSON, datasets in either or in parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.identity import anonymize_columns
from trailmark.params import FUNNEL, Period

# Column titles of the CSV export.
CSV_TITLES = {
    "funnel_name": "Funnel Name", "step_order": "Step Order", "step_label": "Step Name", "users": "Unique Users",
    "conversion_from_previous": "Conversion Rate", "drop_off_rate": "Drop-off Rate",
    "average_minutes": "Avg Time to Complete (minutes)", "date_range": "Date Range",
}
FORMATS = ("csv", "json", "parquet")
PERSONAL = ("email", "user_id", "anonymous_id")


def csv_rows(steps: DataFrame, funnels: DataFrame, period: Period) -> DataFrame:
    """Step metrics under the fixed titles."""
    dates = F.lit(f"{period.start:%Y-%m-%d} to {period.end:%Y-%m-%d}")
    named = steps.join(funnels.select(F.col("id").alias("funnel_id"), F.col("name").alias("funnel_name")), "funnel_id")
    named = named.withColumn("date_range", dates)
    return named.select(*[F.col(c).alias(title) for c, title in CSV_TITLES.items()])


def json_report(overall: DataFrame, steps: DataFrame, funnels: DataFrame, period: Period) -> DataFrame:
    """One JSON text per funnel: metadata, summary and steps (bounded by the funnel's steps)."""
    step = F.struct(*[c for c in steps.columns if c not in FUNNEL])
    listed = steps.groupBy(*FUNNEL).agg(F.array_sort(F.collect_list(step)).alias("step_data"))
    summary = F.struct(*[c for c in overall.columns if c not in FUNNEL])
    rows = overall.select(*FUNNEL, summary.alias("summary")).join(listed, FUNNEL).join(
        funnels.select(F.col("id").alias("funnel_id"), F.col("name").alias("funnel_name")), "funnel_id")
    metadata = F.struct(
        "funnel_id", "funnel_name", F.lit("detailed").alias("export_type"),
        F.struct(F.lit(f"{period.start:%Y-%m-%d}").alias("start"), F.lit(f"{period.end:%Y-%m-%d}").alias("end"))
        .alias("date_range"), F.size("step_data").alias("total_records"))
    report = F.struct(metadata.alias("export_metadata"), "summary", "step_data")
    return rows.select(*FUNNEL, F.to_json(report).alias("report"))


def export_dataset(df: DataFrame, path: str, fmt: str = "parquet", anonymize: bool = False,
                   partition_by: tuple[str, ...] = ()) -> None:
    """Writes a dataset from the executors; nested columns become JSON text in CSV."""
    if fmt not in FORMATS:
        raise ValueError(f"choose one of {FORMATS}")
    if anonymize:
        df = anonymize_columns(df, [c for c in df.columns if c.lower() in PERSONAL], legacy=True)
    if fmt == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")]
        df = df.withColumns({c: F.to_json(c) for c in nested})
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)

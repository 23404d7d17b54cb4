"""Running order over a key's rows without bringing a whole key to one task.

A key's rows are cut into hours. Each (key, hour) is ordered by itself; one small row per hour carries the count,
last time or last value over to the hours after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 3_600_000_000


def block_of(micros: Column) -> Column:
    """Number of the hour a time in microseconds falls in."""
    return F.floor(micros / BLOCK)


def _block(df: DataFrame, at: str) -> Column:
    is_time = isinstance(df.schema[at].dataType, T.TimestampType)
    return block_of(F.unix_micros(at) if is_time else F.col(at))


def number_rows(df: DataFrame, keys: list[str], at: str = "timestamp", tie: str = "id") -> DataFrame:
    """Adds `position` (from 1, by time) and `previous_at` (time of the row before) per key."""
    rows = df.withColumn("_block", _block(df, at))
    blocks = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.max(at).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                           F.max("_last").over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(at, tie)
    numbered = rows.withColumns({"_rn": F.row_number().over(inside), "_lag": F.lag(at).over(inside)})
    return numbered.join(blocks, [*keys, "_block"]).withColumns({
        "position": F.col("_offset") + F.col("_rn"), "previous_at": F.coalesce("_lag", "_carried"),
    }).drop("_block", "_offset", "_carried", "_rn", "_lag")


def carry_forward(df: DataFrame, keys: list[str], column: str, into: str, at: str = "timestamp",
                  tie: str = "id", last: Column | None = None) -> DataFrame:
    """Adds `into`: the last non-null `column` of the key up to and including the row.

    `at` is a time or whole microseconds; negated microseconds run backwards. Where values grow or fall with
    time, `last` may say so (their max or min), which is cheaper than the general rule.
    """
    if last is None:
        last = F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(at, tie)))
    rows = df.withColumn("_block", _block(df, at))
    blocks = rows.groupBy(*keys, "_block").agg(last.alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(at, tie).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_found", F.last(column, ignorenulls=True).over(inside))
    return found.join(blocks, [*keys, "_block"]).withColumn(into, F.coalesce("_found", "_carried")).drop(
        "_block", "_found", "_carried")


def as_of(df: DataFrame, updates: DataFrame, keys: list[str], value: str, at: str = "timestamp",
          tie: str = "id") -> DataFrame:
    """Adds `value` to each row: the key's latest update at or before the row.

    `updates` has the keys, `at` and `value`. Updates are sorted in before rows of the same instant.
    """
    columns = df.columns
    marked = df.withColumns({"_is_row": F.lit(1), value: F.lit(None).cast(updates.schema[value].dataType)})
    facts = updates.select(*keys, at, value).withColumn("_is_row", F.lit(0))
    both = marked.unionByName(facts, allowMissingColumns=True).withColumn("_tie", F.struct("_is_row", tie))
    found = carry_forward(both, keys, value, "_as_of", at, "_tie")
    return found.where("_is_row = 1").select(*columns, F.col("_as_of").alias(value))

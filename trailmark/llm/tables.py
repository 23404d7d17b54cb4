"""Shared folders and written tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailmark.session import checkpoint_dir

FILTER_BITS = 24  # bits of a filter of wanted rows: 2 MB
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: later stages survive lost executors.

    Shuffle files of the write go when it ends, as nothing reads them again; else they stay until the driver's JVM happens
    to collect them."""
    spark = df.sparkSession
    path, before = shared_folder(spark, label), spark.conf.get(FREES_SHUFFLES, None)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREES_SHUFFLES) if before is None else spark.conf.set(FREES_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """(row, key, found): `found` is true where the key is among those of `keys`, and where it shares a place with one of
    them in a filter of fixed size. Rows stay where they are."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    taken = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    taken = F.broadcast(written(taken, "filter"))  # 2^18 words of 64 bits for 24 bits
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(key).alias("key"), place.alias("place"))
    held = held.join(taken, F.shiftright("place", 6) == F.col("word"), "left")
    found = F.coalesce(F.expr("(shiftright(bits, cast(place % 64 as int)) & 1L) = 1"), F.lit(False))
    return held.select("row", "key", found.alias("found"))


def unmatched(rows: DataFrame, gone: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key is not among those of `gone`. Only rows that share a place with such a key are moved and joined."""
    held = marked(rows, gone, key, bits)
    moved = held.where("found").join(gone.select(F.col(key).alias("key")), "key", "left_anti")
    return held.where("not found").select("row.*").union(moved.select("row.*"))


def text_rows(documents: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id (long) and text of every row. Other columns, whatever their names, stay behind, or come along as the
    struct `doc` of the whole row if `carry`."""
    rows = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return documents.select(*rows, *([F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc")] if carry else []))


def with_doc(schema: str, documents: DataFrame, carry: bool) -> StructType:
    """The schema of an operator's rows, with the struct of `text_rows` if `carry`."""
    fields = StructType.fromDDL(schema)
    return fields.add("doc", documents.schema, False) if carry else fields


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, mod `folds`; a null key counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))

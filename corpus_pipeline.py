"""From raw documents to packed sequences: the stages of a training corpus.

Each stage takes the documents that the one before it kept and returns documents, the last one sequences. Every row is a
document of its own, also without a doc_id or with one that other rows have.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.entries import packed_documents
from trailmark.llm.language import UNKNOWN, identified
from trailmark.llm.ngram_join import jaccard_components
from trailmark.llm.quality import quality
from trailmark.llm.secret_scan import redacted
from trailmark.llm.tables import FILTER_BITS, unmatched, written
from trailmark.session import prepare

LEAST_SURE = 0.5
WORDS_TOGETHER, NEAR = 5, (80, 100)


def kept_rows(judged: DataFrame, documents: DataFrame) -> DataFrame:
    return judged.select(*(F.col(f"doc.`{c}`") for c in documents.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kept_rows(quality(docs, labels, carry=True).where("kept"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; those without letters, or of no one language, go."""
    judged = identified(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=True)
    return kept_rows(judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SURE)), docs)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those of `gone`."""
    return unmatched(rows, gone, key, FILTER_BITS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Near are texts that share 80 % of their shingles of five words. Every row is a document of its own, whatever its
    doc_id: rows without one, or with one that others have, stay unless their text is near another's.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), WORDS_TOGETHER, NEAR)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    named = rows.select("doc_id", key).join(found.select(F.col("doc_id").alias(key), "component_id"), key)
    first = named.groupBy("component_id").agg(F.min(order)[key].alias(key)).select(key)
    near = written(named.select(key).join(first, key, "left_anti"), "near")
    return without(rows, near, key).select(*(F.col(f"`{c}`") for c in docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, their secrets replaced."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents and their places in sequences."""
    return packed_documents(docs)


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near duplicates", near_duplicates),
          ("secret scan", secret_scan), ("packing", packing)]
ORACLE_SQL = None  # hashes, merges and packing are beyond SQL; tests/llm holds the stages against brute force
PIPELINE_SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

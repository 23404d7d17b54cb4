"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.byte_bpe import encoded
from trailmark.llm.chat import PREFERENCES_SQL, contrasted, conversations, preferences
from trailmark.llm.hilbert import nearest
from trailmark.llm.language import identified
from trailmark.llm.ngram_join import jaccard_components
from trailmark.llm.packing import packed, token_pieces
from trailmark.llm.periodic import periodic_runs, planted_repeats
from trailmark.llm.ppm import ppm_scores
from trailmark.llm.quality import quality
from trailmark.llm.repair import damaged, repaired
from trailmark.llm.secret_scan import secret_spans
from trailmark.llm.simhash import simhash_components
from trailmark.llm.warc import read_archives, write_archives
from trailmark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op1_ngram_jaccard_links")
def op1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), links=True)


def packed_documents(documents: DataFrame) -> DataFrame:
    pieces = token_pieces(documents, public_tokenizers.path("word_bpe_49k.json"))
    return packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return encoded(table(spark, sf_dir, "documents"), path, pattern, decode=True).select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"

    def listed(spans: str):
        return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")

    return found.select(
        "doc_id", *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
                    for k in ("assign", "access", "hex")),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op3_preference_format", PREFERENCES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences(contrasted(conversations(table(spark, sf_dir, "conversations"))))
    listed = {m: F.array_join(F.transform(m, lambda x: F.concat(x["start"], F.lit(":"), x["end"])), ",") for m in ("chosen_mask", "rejected_mask")}
    return out.withColumns(listed)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_hilbert_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_ppm_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"))


@query("op11_simhash_pivots")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted_repeats)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")), F.col("kept"))

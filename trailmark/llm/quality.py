"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Words and pairs of neighbouring words are hashed to a fixed number of features. Two multinomials over the features are
counted: one from all documents, one from documents that labels call good. A document's score is the mean over its
features of the log ratio of the two; it is kept where the score reaches a fixed threshold. All of it is DataFrame
functions: counting is a map-side combined aggregation to one row per feature, and scoring looks the features up in
one constant array of that many ratios (the only thing that reaches the driver), so no document is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.tables import text_rows

FEATURES = 1 << 14
TRUSTED_MOST = 20_000  # labelled documents (by least hash of their id) that the trusted multinomial is fitted on
THRESHOLD = -0.12
SMOOTHING = 0.5
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def with_words(documents: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text ('' for null), words of every row, and doc, the whole row, if `carry`."""
    rows = text_rows(documents, carry).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))


def features(words: Column) -> Column:
    """The feature of each word, then of each pair of neighbours; all words said twice share one."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1),
                        lambda i: F.when(F.get(words, i - 1) == F.get(words, i), F.lit(0).cast("long")).otherwise(
                            F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), F.lit(FEATURES))))
    return F.concat(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES))),
                    F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<bigint>")))


def log_ratios(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the array of log ratios, by feature. Without trusted documents all are 0."""
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").cast("long").alias("trusted_id")).where(
        "trusted_id is not null").distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(TRUSTED_MOST)
    rows = with_words(documents).join(F.broadcast(good), F.col("doc_id") == F.col("trusted_id"), "left")
    counted = rows.select(F.explode(features(F.col("words"))).alias("feature"), F.col("trusted_id").isNotNull().alias("trusted"))
    counted = counted.groupBy("feature").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("good"))
    every = documents.sparkSession.range(FEATURES).select(F.col("id").alias("feature")).join(counted, "feature", "left")
    each = F.array_sort(F.collect_list(F.struct("feature", F.coalesce("raw", F.lit(0)).alias("raw"),
                                                F.coalesce("good", F.lit(0)).alias("good")))).alias("each")
    total = every.agg(each, F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))

    def share(n: Column, whole: str) -> Column:
        return (n + F.lit(SMOOTHING)) / (F.col(whole) + F.lit(SMOOTHING * FEATURES))

    return total.select(F.transform("each", lambda x: F.when(F.col("good") > 0, F.log(
        share(x["good"], "good") / share(x["raw"], "raw"))).otherwise(F.lit(0.0))).alias("ratios"))


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of WINDOW words that occur twice or more in the text.

    Windows are hashed; only where two are equal are they sorted, with their places, to find which.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    rows = rows.withColumn("windows", F.when(F.size("words") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    placed = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))

    def x(j: Column) -> Column:
        return F.get(F.col("sorted"), j)["x"]

    twice = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda j: F.coalesce(x(j) == x(j - 1), F.lit(False)) |
                     F.coalesce(x(j) == x(j + 1), F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda j: F.get(F.col("sorted"), j)["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"), (s + WINDOW).alias("end")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.when(F.col("sorted").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop(
        "windows", "sorted")


def quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
    kept; with `carry` also doc, the whole row.

    `labels` has doc_id, quality, toxic; rows with nulls there are not trusted. A null text counts as empty: no words,
    score 0, not kept. Repeated rows are judged alike; an empty table gives an empty result.
    """
    ratios = log_ratios(documents, labels).first()["ratios"]
    ratios = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")  # folded to one constant
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = with_words(documents, carry).withColumn("lines", lines).withColumn("features", features(F.col("words")))
    rows = repeated_words(rows)
    score = F.aggregate("features", F.lit(0.0), lambda total, f: total + F.get(ratios, f.cast("int")))
    n_words = F.size("words").cast("long")
    out = rows.select(
        *(["doc"] if carry else []), "doc_id", n_words.alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        (score / F.greatest(F.size("features"), F.lit(1))).alias("score"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # as generated rows: a filter on them is not pushed below, where it would compute everything again
    return out.select(*(["doc"] if carry else []), F.inline(F.array(F.struct(*(c for c in out.columns if c != "doc")))))

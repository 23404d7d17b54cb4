"""Exact distributions per group that never bring a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
NO_VALUE = -(2**63)


def distribution(df: DataFrame, keys: list[str], micros: Column, probabilities: dict[str, float],
                 sums: dict[str, Column] | None = None, min_rows: int = 1, bucket: int = SECOND) -> DataFrame:
    """Count, mean, deviation, range and PERCENTILE_CONT of a whole-microsecond value, in seconds.

    One row per group: `rows` (all), `n` (with a value), `mean`, `stddev`, `least`, `most`, a column per entry of
    `probabilities`, and the totals of `sums`. Groups with fewer than `min_rows` rows are left out.

    `percentile()` keeps every distinct value of a group in one task, which a group with a third of the rows
    does not allow. Here equal values collapse first (map-side too); counts per bucket, one second of value
    range each, locate the buckets that hold the wanted ranks; only those buckets are sorted, each by itself.
    """
    sums = sums or {}
    value = F.col("_v").cast("double")
    counts = (
        df.select(*keys, micros.cast("bigint").alias("_v"), *[c.alias(f"_x_{n}") for n, c in sums.items()])
        .groupBy(*keys, "_v").agg(F.count("*").alias("_n"), *[F.sum(f"_x_{n}").alias(f"_x_{n}") for n in sums])
        .withColumn("_b", F.coalesce(F.floor(F.col("_v") / bucket), F.lit(NO_VALUE)))
    )
    inner = (F.col("_v") - F.col("_b") * bucket).cast("double")  # place in the bucket: squares of small numbers do not cancel
    per_bucket = counts.groupBy(*keys, "_b").agg(
        F.sum("_n").alias("_rows"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)).alias("_bn"),
        F.sum(value * F.col("_n")).alias("_s"), F.sum(inner * F.col("_n")).alias("_r"), F.sum(inner * inner * F.col("_n")).alias("_q"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"), *[F.sum(f"_x_{n}").alias(f"_x_{n}") for n in sums])
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {"rows": F.sum("_rows"), "n": F.sum("_bn"), "_ts": F.sum("_s"), "_tmin": F.min("_min"),
              "_tmax": F.max("_max"), **{f"_t_{n}": F.sum(f"_x_{n}") for n in sums}}
    located = per_bucket.select(
        *keys, "_b", "_bn", "_s", "_r", "_q", (F.sum("_bn").over(running) - F.col("_bn")).alias("_before"),
        *[total.over(whole).alias(name) for name, total in totals.items()]).where(F.col("rows") >= min_rows)

    apart = F.col("_s") / F.col("_bn") - F.col("_ts") / F.col("n")
    squares = F.when(F.col("_bn") > 0, F.col("_q") - F.col("_r") * F.col("_r") / F.col("_bn") + F.col("_bn") * apart * apart)
    located = located.withColumn("_tq", F.sum(squares).over(whole)).drop("_s", "_r", "_q")

    ranks = {}
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        ranks[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_bn"))
    wanted = F.col("n") == 0
    for low, high, _ in ranks.values():
        wanted = wanted | inside(low) | inside(high)
    hits = located.where(wanted)

    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    fine = counts.select(*keys, "_b", "_v", "_n").join(hits, [*keys, "_b"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(in_bucket))
    at_rank = lambda r: F.min(
        F.when((r >= F.col("_before")) & (r < F.col("_upto")), F.col("_v"))).cast("double")
    picks = [F.max(name).alias(name) for name in (*totals, "_tq")]
    for name, (low, high, part) in ranks.items():
        picks += [at_rank(low).alias(f"_lo_{name}"), at_rank(high).alias(f"_hi_{name}"), F.max(part).alias(f"_f_{name}")]
    found = fine.groupBy(*keys).agg(*picks)
    seconds = lambda c: c / F.lit(1e6)
    n, s = F.col("n"), F.col("_ts")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("_tq") / (n - 1))))
    return found.select(
        *keys, "rows", "n", seconds(F.when(n > 0, s / n)).alias("mean"), seconds(spread).alias("stddev"),
        seconds(F.col("_tmin")).alias("least"), seconds(F.col("_tmax")).alias("most"),
        *[seconds(F.col(f"_lo_{p}") + (F.col(f"_hi_{p}") - F.col(f"_lo_{p}")) * F.col(f"_f_{p}")).alias(p)
          for p in probabilities],
        *[F.col(f"_t_{name}").alias(name) for name in sums])

"""Comparing the funnels of a workspace: totals, pairwise tests, corrections, ranking and A/B results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import banded, mean_seconds, normal_cdf, rate, two_sided_p
from trailmark.operators.conversion import conversion_steps
from trailmark.operators.state import reached_all_steps
from trailmark.params import FUNNEL, SCOPE, Period

MIN_FUNNELS, MAX_FUNNELS = 2, 5
# Labels of the comparison report.
BUSINESS = [(5.0, 0.5, "substantial"), (2.0, 0.3, "meaningful"), (0.5, 0.1, "marginal")]
ETA_LABELS = [(0.14, "large"), (0.06, "medium"), (0.01, "small")]
Z_95 = 1.96
MIN_SAMPLE = 1000
DETECTABLE_EFFECT = 0.02


def funnel_compare(state: DataFrame, period: Period, chosen: DataFrame | None = None) -> DataFrame:
    """Per funnel: entries, conversions, rate, seconds to convert and scores, in one pass over state.

    `chosen` names the funnels of the comparison (all by default); a comparison takes 2 to 5 of them. `status` says
    whether a workspace has so many; if not, its funnels are listed but not tested against each other.
    """
    entered = state.where(period.contains("entered_at"))
    if chosen is not None:
        entered = entered.join(chosen.select(*FUNNEL).distinct(), FUNNEL, "left_semi")
    done = reached_all_steps()
    facts = entered.groupBy(*FUNNEL).agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("current_step_index") + 1 == F.col("total_steps")).alias("conversions"),
        rate(F.count_if(done), F.count("*")).alias("conversion_rate"),
        F.coalesce(mean_seconds(F.when(done, F.col("completed_at")), F.col("entered_at")), F.lit(0.0)).alias("avg_seconds"))
    scope = Window.partitionBy(*SCOPE)
    compared = F.count("*").over(scope)
    value = F.col("conversion_rate")
    return facts.withColumn("compared", compared).select(
        *FUNNEL, "entries", "conversions", "conversion_rate", "avg_seconds",
        F.row_number().over(scope.orderBy(F.desc("entries"), "funnel_id")).cast("bigint").alias("volume_rank"),
        F.least(F.lit(100.0), value * 10).alias("quality_score"),
        F.least(F.lit(100.0), value * 2 + 70).alias("engagement_score"),
        "compared", F.when(F.col("compared") < MIN_FUNNELS, "too_few").when(F.col("compared") > MAX_FUNNELS, "too_many")
        .otherwise("ok").alias("status"))


def _test(a: str, b: str, alpha: float) -> dict[str, Column]:
    """Two-proportion test of side `b` against side `a` (column prefixes)."""
    p1, p2 = F.col(f"{a}_rate") / 100, F.col(f"{b}_rate") / 100
    n1, n2 = F.col(f"{a}_entries"), F.col(f"{b}_entries")
    pooled = (F.col(f"{a}_conversions") + F.col(f"{b}_conversions")) / (n1 + n2)
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = F.when(error > 0, F.abs(p1 - p2) / error)
    p_value = two_sided_p(z)
    margin = F.sqrt(p1 * (F.lit(1.0) - p1) / n1 + p2 * (F.lit(1.0) - p2) / n2) * Z_95
    effect = F.abs((F.asin(F.sqrt(p2)) - F.asin(F.sqrt(p1))) * 2)
    gap = F.col(f"{b}_rate") - F.col(f"{a}_rate")
    business = None
    for points, size, label in BUSINESS:
        hit = (F.abs(gap) > points) | (effect > size)
        business = F.when(hit, label) if business is None else business.when(hit, label)
    return {
        "rate_difference": gap,
        "rate_lift": F.when(F.col(f"{a}_rate") > 0, gap / F.col(f"{a}_rate") * 100).otherwise(F.lit(0.0)),
        "z_score": z, "p_value": p_value, "is_significant": F.coalesce(p_value < alpha, F.lit(False)),
        "ci_low": (p2 - p1 - margin) * 100, "ci_high": (p2 - p1 + margin) * 100, "effect_size": effect,
        "business_significance": business.otherwise("not_significant"),
        "recommendation": F.when((p_value < 0.05) & (F.abs(gap) > 2), "implement_winner")
        .when((p_value < 0.1) & (effect > 0.2), "continue_testing").when(effect > 0.1, "investigate_further")
        .otherwise("no_action"),
    }


def _side(compared: DataFrame, name: str) -> DataFrame:
    return compared.select(
        *SCOPE, F.col("funnel_id").alias(f"funnel_{name}"), F.col("entries").alias(f"{name}_entries"),
        F.col("conversions").alias(f"{name}_conversions"), F.col("conversion_rate").alias(f"{name}_rate"))


TEST_COLUMNS = ["rate_difference", "rate_lift", "z_score", "p_value", "is_significant", "ci_low", "ci_high",
                "effect_size", "business_significance", "recommendation"]


def compare_pairwise(compared: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-proportion test of every two of the (at most five) compared funnels."""
    compared = compared.where("status = 'ok'")
    pairs = _side(compared, "a").join(_side(compared, "b"), SCOPE).where("funnel_a < funnel_b")
    return pairs.withColumns(_test("a", "b", alpha)).select(*SCOPE, "funnel_a", "funnel_b", *TEST_COLUMNS)


def compare_bh(pairwise: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: a pair is significant when p < rank / pairs * alpha."""
    scope = Window.partitionBy(*SCOPE)
    rank = F.row_number().over(scope.orderBy(F.col("p_value").asc_nulls_last(), "funnel_a", "funnel_b"))
    level = rank / F.count("*").over(scope) * alpha
    return pairwise.select(*SCOPE, "funnel_a", "funnel_b", "p_value", rank.cast("bigint").alias("rank"),
                           level.alias("adjusted_alpha"),
                           F.coalesce(F.col("p_value") < level, F.lit(False)).alias("is_significant"))


def chi_square_tail(x: Column, df: Column) -> Column:
    """Probability of a chi-square above x: finite sums, over (x/2)^k / k! for even degrees and, besides the normal
    tail, over x^(k - 1/2) / (1 * 3 * ... * (2k - 1)) for odd ones."""
    def total(first: Column, terms: Column, factor) -> Column:
        start = F.struct(first.alias("term"), F.when(terms > 0, first).otherwise(F.lit(0.0)).alias("sum"))
        more = F.when(terms > 1, F.sequence(F.lit(1).cast("bigint"), terms - 1)).otherwise(F.array().cast("array<bigint>"))

        def step(a: Column, k: Column) -> Column:
            term = a["term"] * factor(k)
            return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

        return F.aggregate(more, start, step, lambda a: a["sum"])

    half = F.floor(df / 2)
    even = F.exp(-x / 2) * total(F.lit(1.0), half, lambda k: x / 2 / k)
    density = F.exp(-x / 2) / F.sqrt(F.lit(2.0) * F.pi())
    odd = F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.sqrt(x))) + F.lit(2.0) * density * total(
        F.sqrt(x), half, lambda k: x / (2 * k + 1))
    return F.when(df % 2 == 0, even).otherwise(odd)


def compare_chi_square(compared: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Chi-square of conversions over the compared funnels, with its p-value for any degrees of freedom."""
    scope = Window.partitionBy(*SCOPE)
    expected = F.col("entries") * (F.sum("conversions").over(scope) / F.sum("entries").over(scope))
    facts = compared.withColumn("_e", expected).groupBy(*SCOPE).agg(
        F.sum(F.when(F.col("_e") > 0, F.pow(F.col("conversions") - F.col("_e"), F.lit(2.0)) / F.col("_e")))
        .alias("chi_square"), (F.count("*") - 1).alias("degrees_of_freedom"))
    x, df = F.col("chi_square"), F.col("degrees_of_freedom")
    p_value = F.when(df >= 1, chi_square_tail(x, df))
    return facts.withColumn("p_value", p_value).withColumns({
        "is_significant": F.coalesce(F.col("p_value") < alpha, F.lit(False)), "adjusted_alpha": F.lit(alpha) / (df + 1)})


def compare_effect_size(compared: DataFrame) -> DataFrame:
    """Share of variance between the compared rates, with its label."""
    facts = compared.groupBy(*SCOPE).agg(F.var_samp("conversion_rate").alias("v"), F.avg("conversion_rate").alias("m"))
    eta = F.when(F.col("v") + F.col("m") * F.col("m") > 0, F.col("v") / (F.col("v") + F.col("m") * F.col("m")))
    return facts.select(
        *SCOPE, eta.alias("eta_squared"), banded(eta, ETA_LABELS, "negligible").alias("practical_significance"),
        banded(eta, [(0.06, "high"), (0.01, "medium")], "low").alias("business_impact"))


def with_baseline(compared: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Marks each workspace's baseline funnel: the given one, else the lowest id."""
    if baseline is None:
        baseline = compared.groupBy(*SCOPE).agg(F.min("funnel_id").alias("baseline_id"))
    return compared.join(baseline.select(*SCOPE, "baseline_id"), SCOPE).withColumn(
        "is_baseline", F.col("funnel_id") == F.col("baseline_id"))


def compare_ranking(marked: DataFrame) -> DataFrame:
    """Per funnel: rank by rate, lift over baseline and mean, gap to the best, time rank and velocity."""
    scope = Window.partitionBy(*SCOPE)
    value, spent = F.col("conversion_rate"), F.col("avg_seconds")
    base = F.max(F.when(F.col("is_baseline"), value)).over(scope)
    mean = F.avg("conversion_rate").over(scope)
    lift = lambda to: F.when(to > 0, (value - to) / to * 100).otherwise(F.lit(0.0))
    return marked.select(
        *FUNNEL, "is_baseline", "conversion_rate",
        F.row_number().over(scope.orderBy(F.desc("conversion_rate"), "funnel_id")).cast("bigint").alias("overall_rank"),
        lift(base).alias("vs_baseline_lift"), lift(mean).alias("vs_average_lift"),
        (F.max("conversion_rate").over(scope) - F.min("conversion_rate").over(scope)).alias("efficiency_gap"),
        "avg_seconds", F.row_number().over(scope.orderBy("avg_seconds", "funnel_id")).cast("bigint").alias("timing_rank"),
        F.greatest(F.lit(0.0), F.lit(100.0) - spent / 36).alias("velocity_score"),
        (F.max("avg_seconds").over(scope) - F.min("avg_seconds").over(scope)).alias("time_gap_seconds"))


def ab_test(marked: DataFrame, alpha: float = 0.05, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Baseline against the best variant: winner, whether the sample suffices, what to do."""
    scope = Window.partitionBy(*SCOPE)
    best = scope.orderBy("is_baseline", F.desc("conversion_rate"), "funnel_id")
    rows = marked.withColumns({"_rn": F.row_number().over(best), "sample": F.sum("entries").over(scope)})
    variant = _side(rows.where("_rn = 1"), "b")
    base = _side(rows.where("is_baseline"), "a").join(rows.where("is_baseline").select(*SCOPE, "sample"), SCOPE)
    tested = base.join(variant, SCOPE).withColumns(_test("a", "b", alpha))
    enough = F.col("sample") >= min_sample
    return tested.select(
        *SCOPE, F.col("funnel_a").alias("baseline"), F.col("funnel_b").alias("best_variant"), "rate_lift", "p_value",
        "effect_size", F.col("sample").alias("actual_sample_size"), enough.alias("has_sufficient_sample"),
        (F.col("is_significant") & enough).alias("is_conclusive"),
        F.when(F.col("is_significant"), F.col("funnel_b")).alias("winner"),
        (F.abs("rate_difference") / 100).alias("actual_effect"), F.lit(DETECTABLE_EFFECT).alias("detectable_effect"),
        F.when(F.col("is_significant") & (F.abs("rate_lift") > 5), "implement_winner").otherwise("continue_testing")
        .alias("recommendation"))


def compare_steps(state: DataFrame, steps: DataFrame, period: Period) -> DataFrame:
    """Per step number: best and worst funnel by conversion, spread, mean drop-off, fastest and slowest funnel."""
    rows = conversion_steps(state, steps, period)
    better = F.struct((-F.col("conversion_from_previous")).alias("k"), F.col("funnel_id").alias("f"),
                      F.col("conversion_from_previous").alias("v"))
    worse = F.struct(F.col("conversion_from_previous").alias("k"), F.col("funnel_id").alias("f"),
                     F.col("conversion_from_previous").alias("v"))
    faster = F.struct(F.col("average_minutes").alias("k"), F.col("funnel_id").alias("f"))
    slower = F.struct((-F.col("average_minutes")).alias("k"), F.col("funnel_id").alias("f"))
    facts = rows.groupBy(*SCOPE, "step_order").agg(
        F.count("*").alias("funnels"), F.min(better).alias("b"), F.min(worse).alias("w"),
        F.avg("drop_off_rate").alias("avg_drop_off_rate"), F.avg("average_minutes").alias("avg_minutes"),
        F.min(faster)["f"].alias("fastest_funnel"), F.min(slower)["f"].alias("slowest_funnel"))
    return facts.select(
        *SCOPE, "step_order", "funnels", F.col("b.f").alias("best_funnel"), F.col("b.v").alias("best_rate"),
        F.col("w.f").alias("worst_funnel"), F.col("w.v").alias("worst_rate"),
        (F.col("b.v") - F.col("w.v")).alias("performance_spread"), "avg_drop_off_rate", "avg_minutes",
        "fastest_funnel", "slowest_funnel")

"""Funnel comparison queries."""

from __future__ import annotations

from trailmark.operators import comparison
from trailmark.plans import sql
from trailmark.plans.conversion import DONE, G, LAST, p_value_sql
from trailmark.plans.registry import CURRENT, Inputs, query
from trailmark.plans.sql import avg_secs, oracle, pct, rnd
from trailmark.plans.timing import rounded

S = "tenant_id, workspace_id"
COMPARED = f"""
c0 AS (SELECT {G}, COUNT(*) AS entries, COUNT(*) FILTER (WHERE {LAST}) AS conversions,
         {pct(f'COUNT(*) FILTER (WHERE {DONE})', 'COUNT(*)')} AS conversion_rate,
         COALESCE({avg_secs('completed_at', 'entered_at', DONE)}, 0.0) AS avg_seconds
       FROM st WHERE entered_at {sql.CURRENT} GROUP BY 1, 2, 3),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY {S}) AS compared FROM c0)"""


def _compared(i: Inputs):
    return comparison.funnel_compare(i.state, CURRENT)


def _marked(i: Inputs):
    return comparison.with_baseline(_compared(i))


@query("funnel_compare", oracle("st", f"""{COMPARED}
SELECT {G}, entries, conversions, conversion_rate, {rnd('avg_seconds', 3)} AS avg_seconds,
  ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY entries DESC, funnel_id) AS volume_rank,
  least(100.0, conversion_rate * 10) AS quality_score, least(100.0, conversion_rate * 2 + 70) AS engagement_score, compared,
  CASE WHEN compared < 2 THEN 'too_few' WHEN compared > 5 THEN 'too_many' ELSE 'ok' END AS status FROM c"""))
def funnel_compare(i: Inputs):
    return rounded(_compared(i), 3, "avg_seconds")


def _pair(left: str, right: str) -> str:
    """Test of `right` against `left` (subqueries with funnel_id, entries, conversions, conversion_rate)."""
    return f"""
p0 AS (SELECT a.tenant_id, a.workspace_id, a.funnel_id AS funnel_a, b.funnel_id AS funnel_b, a.entries AS n1, b.entries AS n2,
         a.conversion_rate AS r1, b.conversion_rate AS r2, CAST(a.conversions + b.conversions AS DOUBLE) / (a.entries + b.entries) AS pool
       FROM {left} a JOIN {right} b ON b.workspace_id = a.workspace_id AND a.tenant_id = b.tenant_id),
p1 AS (SELECT *, abs(r1 / 100 - r2 / 100) / sqrt(pool * (1.0 - pool) * (1.0 / n1 + 1.0 / n2)) AS z,
         1.96::DOUBLE * sqrt(r1 / 100 * (1.0 - r1 / 100) / n1 + r2 / 100 * (1.0 - r2 / 100) / n2) AS mg,
         abs(2 * (asin(sqrt(r2 / 100)) - asin(sqrt(r1 / 100)))) AS eff, r2 - r1 AS gap FROM p0),
pv AS ({p_value_sql('p1', '*')})"""


PAIRS = f"{COMPARED}, {_pair('c', 'c')}, pp AS (SELECT * FROM pv WHERE funnel_a < funnel_b)"


@query("compare_pairwise", oracle("st", f"""{PAIRS}
SELECT {S}, funnel_a, funnel_b, {rnd('gap', 4)} + 0.0 AS rate_difference, {rnd('CASE WHEN r1 > 0 THEN gap / r1 * 100 ELSE 0.0 END', 4)} + 0.0 AS rate_lift,
  {rnd('z', 4)} AS z_score, {rnd('p', 6)} AS p_value, p < 0.05 AS is_significant,
  {rnd('(r2 / 100 - r1 / 100 - mg) * 100', 4)} + 0.0 AS ci_low, {rnd('(r2 / 100 - r1 / 100 + mg) * 100', 4)} + 0.0 AS ci_high,
  {rnd('eff', 6)} AS effect_size,
  CASE WHEN abs(gap) > 5 OR eff > 0.5 THEN 'substantial' WHEN abs(gap) > 2 OR eff > 0.3 THEN 'meaningful'
       WHEN abs(gap) > 0.5 OR eff > 0.1 THEN 'marginal' ELSE 'not_significant' END AS business_significance,
  CASE WHEN p < 0.05 AND abs(gap) > 2 THEN 'implement_winner' WHEN p < 0.1 AND eff > 0.2 THEN 'continue_testing'
       WHEN eff > 0.1 THEN 'investigate_further' ELSE 'no_action' END AS recommendation FROM pp"""))
def pairwise(i: Inputs):
    rows = rounded(comparison.compare_pairwise(_compared(i)), 4, "rate_difference", "rate_lift", "z_score", "ci_low", "ci_high")
    rows = rounded(rows, 6, "p_value", "effect_size")
    return rows.withColumns({c: rows[c] + 0.0 for c in ("rate_difference", "rate_lift", "ci_low", "ci_high")})


@query("compare_bh", oracle("st", f"""{PAIRS},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY p, funnel_a, funnel_b) AS rank, COUNT(*) OVER (PARTITION BY {S}) AS m FROM pp)
SELECT {S}, funnel_a, funnel_b, {rnd('p', 6)} AS p_value, rank, {rnd('rank / m * 0.05::DOUBLE', 6)} AS adjusted_alpha,
  p < rank / m * 0.05::DOUBLE AS is_significant FROM r"""))
def bh(i: Inputs):
    return rounded(comparison.compare_bh(comparison.compare_pairwise(_compared(i))), 6, "p_value", "adjusted_alpha")


@query("compare_chi_square", oracle("st", f"""{COMPARED},
x AS (SELECT *, entries * (SUM(conversions) OVER (PARTITION BY {S}) / SUM(entries) OVER (PARTITION BY {S})) AS ex FROM c),
y AS (SELECT {S}, SUM(pow(conversions - ex, 2) / ex) AS chi_square, COUNT(*) - 1 AS degrees_of_freedom FROM x GROUP BY 1, 2)
SELECT {S}, {rnd('chi_square', 4)} AS chi_square, degrees_of_freedom, {rnd('exp(-chi_square / 2)', 6)} AS p_value,
  exp(-chi_square / 2) < 0.05 AS is_significant, {rnd('0.05::DOUBLE / (degrees_of_freedom + 1)', 6)} AS adjusted_alpha FROM y"""))
def chi_square(i: Inputs):
    return rounded(rounded(comparison.compare_chi_square(_compared(i)), 4, "chi_square"), 6, "p_value", "adjusted_alpha")


@query("compare_effect_size", oracle("st", f"""{COMPARED},
x AS (SELECT {S}, var_samp(conversion_rate) AS v, AVG(conversion_rate) AS m FROM c GROUP BY 1, 2),
y AS (SELECT {S}, v / (v + m * m) AS eta FROM x)
SELECT {S}, {rnd('eta', 6)} AS eta_squared, CASE WHEN eta > 0.14 THEN 'large' WHEN eta > 0.06 THEN 'medium' WHEN eta > 0.01 THEN 'small'
  ELSE 'negligible' END AS practical_significance, CASE WHEN eta > 0.06 THEN 'high' WHEN eta > 0.01 THEN 'medium' ELSE 'low' END
  AS business_impact FROM y"""))
def effect_size(i: Inputs):
    return rounded(comparison.compare_effect_size(_compared(i)), 6, "eta_squared")


@query("compare_ranking", oracle("st", f"""{COMPARED},
x AS (SELECT *, MIN(funnel_id) OVER (PARTITION BY {S}) = funnel_id AS is_baseline, AVG(conversion_rate) OVER (PARTITION BY {S}) AS mn,
        FIRST_VALUE(conversion_rate) OVER (PARTITION BY {S} ORDER BY funnel_id) AS bs FROM c)
SELECT {G}, is_baseline, conversion_rate, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY conversion_rate DESC, funnel_id) AS overall_rank,
  {rnd('CASE WHEN bs > 0 THEN (conversion_rate - bs) / bs * 100 ELSE 0.0 END', 4)} + 0.0 AS vs_baseline_lift,
  {rnd('CASE WHEN mn > 0 THEN (conversion_rate - mn) / mn * 100 ELSE 0.0 END', 4)} + 0.0 AS vs_average_lift,
  {rnd(f'MAX(conversion_rate) OVER (PARTITION BY {S}) - MIN(conversion_rate) OVER (PARTITION BY {S})', 4)} AS efficiency_gap,
  {rnd('avg_seconds', 3)} AS avg_seconds, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY avg_seconds, funnel_id) AS timing_rank,
  {rnd('greatest(0.0, 100.0 - avg_seconds / 36)', 4)} AS velocity_score,
  {rnd(f'MAX(avg_seconds) OVER (PARTITION BY {S}) - MIN(avg_seconds) OVER (PARTITION BY {S})', 3)} AS time_gap_seconds FROM x"""))
def ranking(i: Inputs):
    rows = rounded(comparison.compare_ranking(_marked(i)), 4, "vs_baseline_lift", "vs_average_lift", "efficiency_gap", "velocity_score")
    rows = rounded(rows, 3, "avg_seconds", "time_gap_seconds")
    return rows.withColumns({c: rows[c] + 0.0 for c in ("vs_baseline_lift", "vs_average_lift")})


@query("ab_test", oracle("st", f"""{COMPARED},
bl AS (SELECT * FROM c WHERE funnel_id = (SELECT MIN(funnel_id) FROM c x WHERE x.workspace_id = c.workspace_id)),
vr AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY conversion_rate DESC, funnel_id) AS rn
         FROM c ANTI JOIN bl USING (funnel_id)) WHERE rn = 1), {_pair('bl', 'vr')},
sz AS (SELECT {S}, CAST(SUM(entries) AS BIGINT) AS sample FROM c GROUP BY 1, 2),
z AS (SELECT pv.*, sample, CASE WHEN r1 > 0 THEN gap / r1 * 100 ELSE 0.0 END AS lift FROM pv JOIN sz USING ({S}))
SELECT {S}, funnel_a AS baseline, funnel_b AS best_variant, {rnd('lift', 4)} + 0.0 AS rate_lift, {rnd('p', 6)} AS p_value,
  {rnd('eff', 6)} AS effect_size, sample AS actual_sample_size, sample >= 1000 AS has_sufficient_sample,
  p < 0.05 AND sample >= 1000 AS is_conclusive, CASE WHEN p < 0.05 THEN funnel_b END AS winner,
  {rnd('abs(gap) / 100', 6)} AS actual_effect, 0.02::DOUBLE AS detectable_effect,
  CASE WHEN p < 0.05 AND abs(lift) > 5 THEN 'implement_winner' ELSE 'continue_testing' END AS recommendation FROM z"""))
def ab_test(i: Inputs):
    rows = rounded(rounded(comparison.ab_test(_marked(i)), 4, "rate_lift"), 6, "p_value", "effect_size", "actual_effect")
    return rows.withColumn("rate_lift", rows.rate_lift + 0.0)


@query("compare_steps", oracle("st", f"""
r AS (SELECT steps.tenant_id, steps.workspace_id, steps.funnel_id, order_index, COUNT(st.anonymous_id) AS users,
        COALESCE({rnd('AVG(CAST(epoch_us(last_activity_at) - epoch_us(entered_at) AS DOUBLE)) / 60e6')}, 0.0) AS mins
      FROM steps LEFT JOIN st ON st.funnel_id = steps.funnel_id AND st.current_step_index >= order_index
           AND entered_at {sql.CURRENT} GROUP BY 1, 2, 3, 4),
l AS (SELECT *, COALESCE(LAG(users) OVER (PARTITION BY funnel_id ORDER BY order_index), users) AS pv FROM r),
d AS (SELECT {G}, CAST(order_index + 1 AS BIGINT) AS step_order, {pct('users', 'pv')} AS cv, {pct('pv - users', 'pv')} AS dr, mins FROM l)
SELECT {S}, step_order, COUNT(*) AS funnels, (ARRAY_AGG(funnel_id ORDER BY cv DESC, funnel_id))[1] AS best_funnel, MAX(cv) AS best_rate,
  (ARRAY_AGG(funnel_id ORDER BY cv, funnel_id))[1] AS worst_funnel, MIN(cv) AS worst_rate, {rnd('MAX(cv) - MIN(cv)', 4)} AS performance_spread,
  {rnd('AVG(dr)', 4)} AS avg_drop_off_rate, {rnd('AVG(mins)', 4)} AS avg_minutes,
  (ARRAY_AGG(funnel_id ORDER BY mins, funnel_id))[1] AS fastest_funnel,
  (ARRAY_AGG(funnel_id ORDER BY mins DESC, funnel_id))[1] AS slowest_funnel FROM d GROUP BY 1, 2, 3"""))
def compare_steps(i: Inputs):
    return rounded(comparison.compare_steps(i.state, i.steps, CURRENT), 4, "performance_spread", "avg_drop_off_rate", "avg_minutes")

"""The column macros as SQL functions: expressions Spark inlines, no Python per row."""

from __future__ import annotations

from pyspark.sql import SparkSession

from trailmark.functions.columns import ERF_COEFFICIENTS, ERF_P

_HORNER = "0D"
for _a in reversed(ERF_COEFFICIENTS):
    _HORNER = f"({_HORNER} * t + {_a}D)"

SQL_FUNCTIONS = {
    "normal_cdf(z DOUBLE) RETURNS DOUBLE": f"""
      SELECT 0.5D * (1D + IF(z < 0, -1D, 1D) * (1D - {_HORNER} * t * exp(-z * z / 2D)))
      FROM (SELECT 1D / (1D + {ERF_P}D * abs(z) / sqrt(2D)) AS t)""",
    "week_label(at TIMESTAMP) RETURNS STRING":
        "concat(year(at), '-W', lpad(CAST(floor((dayofyear(at) - 1) / 7) + 1 AS STRING), 2, '0'))",
    "touchpoint_type(utm_source STRING, referrer STRING) RETURNS STRING": """
      CASE WHEN utm_source IS NOT NULL THEN 'paid_search' WHEN contains(referrer, 'google') THEN 'organic_search'
           WHEN referrer IS NULL THEN 'direct' WHEN contains(referrer, 'social') THEN 'social' ELSE 'referral' END""",
    "wildcard_match(value STRING, pattern STRING) RETURNS BOOLEAN": r"""
      CASE WHEN contains(pattern, '*') THEN regexp_like(value, concat('(?is)^', replace(replace(
             regexp_replace(pattern, r'([\\.\[\]{}()+\-^$|&#~])', r'\\$1'), '*', '.*'), '?', '.'), '$'))
           ELSE contains(lower(value), lower(pattern)) END""",
}
# HMAC derives its pads from the key on the driver, so it stays a Column macro (functions.columns.hmac_sha256).


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Makes the macros callable from SQL in this session; returns their names."""
    for signature, body in SQL_FUNCTIONS.items():
        head, returns = signature.split(" RETURNS ")
        body = f"({body})" if body.strip().upper().startswith("SELECT") else body
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    return [s.split("(")[0] for s in SQL_FUNCTIONS]

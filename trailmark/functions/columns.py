"""Column macros: arithmetic, time, statistics and matching. All JVM-side, no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000.0


# ---------------------------------------------------------------- arithmetic
def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round halves towards +infinity on the binary double, e.g. 2.5 -> 3 and -2.5 -> -2."""
    factor = float(10**digits)
    return F.floor(value * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def share(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole * 100, `empty` where there is no whole."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(empty).cast("double"))


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_half_up(share(part, whole), digits)


def change_percent(current: Column, previous: Column) -> Column:
    return F.when(previous > 0, (current - previous) / previous * F.lit(100.0)).otherwise(F.lit(0.0))


def direction(change: Column, threshold: float, names: tuple[str, str, str] = ("up", "down", "stable")) -> Column:
    up, down, flat = names
    return (
        F.when(F.abs(change) < threshold, flat).when(change > 0, up).when(change < 0, down).otherwise(flat)
    )


def banded(value: Column, bands: list[tuple[float, object]], default: object, strict: bool = True) -> Column:
    """First label whose lower bound the value exceeds (strict) or reaches; bounds run downwards."""
    result = None
    for bound, label in bands:
        hit = value > bound if strict else value >= bound
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return result.otherwise(F.lit(default))


def ceilinged(value: Column, bands: list[tuple[float, object]], default: object, strict: bool = True) -> Column:
    """First label whose upper bound the value stays below (strict) or within; bounds run upwards."""
    result = None
    for bound, label in bands:
        hit = value < bound if strict else value <= bound
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return result.otherwise(F.lit(default))


def labels_where(*conditions: tuple[Column, Column | str]) -> Column:
    """Array of the labels whose condition holds."""
    marked = [F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in conditions]
    return F.filter(F.array(*marked), lambda x: x.isNotNull())


# ---------------------------------------------------------------------- time
def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Fractional seconds; unix_timestamp would drop the fraction."""
    return micros_between(later, earlier) / F.lit(MICROS)


def mean_seconds(later: Column, earlier: Column) -> Column:
    """Mean of an interval. Averages whole microseconds, so the sum does not depend on row order."""
    return F.avg(micros_between(later, earlier).cast("double")) / F.lit(MICROS)


def ts_text(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def week_of_year_label(value: Column) -> Column:
    """`YYYY-Www` counting weeks from January 1st (not ISO weeks)."""
    week = F.floor((F.dayofyear(value) - 1) / 7) + 1
    return F.concat(F.year(value).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def period_label(value: Column, unit: str) -> Column:
    if unit == "week":
        return week_of_year_label(value)
    pattern = {"hour": "yyyy-MM-dd HH:00:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit]
    return F.date_format(value, pattern)


def duration_text(seconds: Column) -> Column:
    """Largest whole unit, e.g. 45s, 12m, 3h, 2d."""
    def whole(divisor: int, suffix: str) -> Column:
        return F.concat(F.floor(seconds / divisor + 0.5).cast("string"), F.lit(suffix))

    return (
        F.when(seconds < 60, whole(1, "s")).when(seconds < 3600, whole(60, "m"))
        .when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))
    )


# ---------------------------------------------------------------- statistics
# Coefficients of the Abramowitz-Stegun 7.1.26 approximation of erf.
ERF_P = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function by the published five-term rational approximation (Spark has none)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    horner = reduce(lambda acc, a: acc * t + F.lit(a), reversed(ERF_COEFFICIENTS), F.lit(0.0))
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * (F.lit(1.0) - horner * t * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return (F.lit(1.0) + erf(x / F.sqrt(F.lit(2.0)))) / F.lit(2.0)


def two_sided_p(z: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


# ------------------------------------------------------------------ matching
def wildcard_match(value: Column, pattern: str) -> Column:
    """`*` and `?` make an anchored pattern, anything else is a substring; case does not count."""
    if "*" in pattern:
        special = set(r"\.[]{}()+-^$|&#~")
        body = "".join(
            ".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in special else ch for ch in pattern
        )
        return value.rlike(f"(?is)^{body}$")
    return F.lower(value).contains(pattern.lower())


def json_value(props: Column, key: str) -> Column:
    return F.get_json_object(props, f"$.{key}")


# --------------------------------------------------------------- fingerprints
def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 as lower-case hex, from two native SHA-256 calls."""
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)

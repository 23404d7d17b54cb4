"""Ingest: validation, quarantine, deduplication and enrichment of tracked events.

Every function works on batch and on streaming DataFrames; where the two differ it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import labels_where, micros_between

# Limits of the ingest contract.
MAX_NAME, MAX_PAYLOAD_BYTES, MAX_BATCH = 100, 256 * 1024, 50
SKEW_MINUTES = 5
ANONYMOUS_PATTERN = r"^a_[A-Za-z0-9_]+$"
SESSION_PATTERN = r"^s_[A-Za-z0-9_]+$"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
SEMVER_PATTERN = r"^(\d+)\.(\d+)\.(\d+)(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?$"
DEFAULT_SCHEMA_VERSION = "1.0"
# Address headers, most trusted first, and the forms of addresses.
ADDRESS_HEADERS = ("x_forwarded_for", "x_real_ip", "x_client_ip", "cf_connecting_ip", "x_forwarded", "forwarded_for",
                   "forwarded")
IPV4_PATTERN = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
IPV6_PATTERN = r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
PRIVATE_PATTERN = r"^(127\.0\.0\.1$|::1$|192\.168\.|10\.)"


# ---------------------------------------------------------------- validation
def _outside(value: Column, longest: int) -> Column:
    return (F.length(value) < 1) | (F.length(value) > longest)


def _not_object(value: Column) -> Column:
    """Text that is present and not a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return value.isNotNull() & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def timestamp_error(at: Column, arrived: Column) -> Column:
    """Why a time is refused (more than five minutes off arrival), or null."""
    off, limit = micros_between(at, arrived), SKEW_MINUTES * 60_000_000
    return F.when(at.isNull(), "invalid_timestamp").when(off < -limit, "too_old").when(off > limit, "in_future")


def validate_events(payloads: DataFrame) -> DataFrame:
    """Adds `errors`, the rules each payload breaks, from the payload's text fields.

    Columns: event_name, timestamp (text), anonymous_id, session_id, event_id, device, geo (JSON text), payload
    (the whole body as text), ingested_at.
    """
    c = F.col
    at = F.try_to_timestamp(c("timestamp"))
    return payloads.withColumn("event_time", at).withColumn("errors", labels_where(
        (c("event_name").isNull() | _outside(c("event_name"), MAX_NAME), "event_name"),
        (c("anonymous_id").isNull() | ~c("anonymous_id").rlike(ANONYMOUS_PATTERN), "anonymous_id"),
        (~c("session_id").rlike(SESSION_PATTERN), "session_id"),
        (_outside(c("event_id"), MAX_NAME), "event_id"),
        (at.isNull(), "timestamp"),
        (F.octet_length(c("payload")) > MAX_PAYLOAD_BYTES, "payload_size"),
        (_not_object(c("device")), "device"),
        (_not_object(c("geo")), "geo"),
    ))


def validate_batches(payloads: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Batches over the allowed size, with their size."""
    return payloads.groupBy(batch).agg(F.count("*").alias("events")).where(F.col("events") > MAX_BATCH)


def validate_timestamp(events: DataFrame, at: str = "timestamp", arrived: str = "ingested_at") -> DataFrame:
    return events.withColumn("timestamp_error", timestamp_error(F.col(at), F.col(arrived)))


def validate_identify(identifies: DataFrame) -> DataFrame:
    """Adds `errors`: an identify needs a user id or traits, a visitor id and a well-formed e-mail."""
    c = F.col
    return identifies.withColumn("errors", labels_where(
        (c("anonymous_id").isNull() | ~c("anonymous_id").rlike(ANONYMOUS_PATTERN), "anonymous_id"),
        (c("user_id").isNull() & c("email").isNull() & c("phone").isNull(), "user_id_or_traits"),
        (~F.trim("email").rlike(EMAIL_PATTERN), "email"),
    ))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their errors)."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def schema_version(header: Column) -> Column:
    return F.when(header.rlike(SEMVER_PATTERN), header).otherwise(F.lit(DEFAULT_SCHEMA_VERSION))


def ingest_summary(checked: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Accepted, rejected and duplicate events per batch; `is_duplicate` marks the duplicates.

    A duplicate is reported as accepted, as a client that retries expects.
    """
    ok = F.size("errors") == 0
    return checked.groupBy(batch).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"),
        F.count_if(ok & F.col("is_duplicate")).alias("duplicates"))


# ------------------------------------------------------------- deduplication
def dedup_events(events: DataFrame, at: str = "ingested_at", tie: str = "id") -> DataFrame:
    """The first row of each (tenant, event_id); rows without an event_id are never duplicates.

    The first row is an aggregate that combines before the shuffle, so a third of all rows being copies of
    one event is one row per task by then.
    """
    row = F.struct(*events.columns)
    first = (
        events.where(F.col("event_id").isNotNull()).groupBy("tenant_id", "event_id")
        .agg(F.min_by(row, F.struct(at, tie)).alias("_row")).select("_row.*")
    )
    return first.unionByName(events.where(F.col("event_id").isNull()))


def mark_duplicates(events: DataFrame, at: str = "ingested_at", tie: str = "id") -> DataFrame:
    """Adds `is_duplicate`: not the first row of its (tenant, event_id). Rows without an event_id need no join."""
    keys, columns = ["tenant_id", "event_id"], events.columns
    named = events.where(F.col("event_id").isNotNull())
    first = named.groupBy(*keys).agg(F.min(F.struct(at, tie)).alias("_first"))
    marked = named.join(first, keys, "left").select(
        *columns, F.coalesce(F.struct(at, tie) > F.col("_first"), F.lit(False)).alias("is_duplicate"))
    return marked.unionByName(events.where(F.col("event_id").isNull()).withColumn("is_duplicate", F.lit(False)))


# ---------------------------------------------------------------- enrichment
# User-agent rules, first match wins. (needs any of, needs none of, name, version pattern)
OS_RULES = [
    (("windows",), (), "Windows", r"windows nt ([\d.]+)"),
    (("mac os x",), (), "macOS", r"mac os x ([\d_]+)"),
    (("linux",), (), "Linux", None),
    (("android",), (), "Android", r"android ([\d.]+)"),
    (("ios", "iphone", "ipad"), (), "iOS", r"os ([\d_]+)"),
]
BROWSER_RULES = [
    (("chrome",), ("edg",), "Chrome", r"chrome/([\d.]+)"),
    (("firefox",), (), "Firefox", r"firefox/([\d.]+)"),
    (("safari",), ("chrome",), "Safari", r"version/([\d.]+)"),
    (("edg",), (), "Edge", r"edg/([\d.]+)"),
    (("opera", "opr"), (), "Opera", r"(?:opera|opr)/([\d.]+)"),
]
MOBILE_PATTERN = r"mobile|android|iphone|ipod|blackberry|iemobile|opera mini"
TABLET_PATTERN = r"tablet|ipad"


def _by_rules(ua: Column, rules: list) -> tuple[Column, Column]:
    """(name, version) of the first rule that fits; version null when the pattern finds none."""
    name = version = None
    for any_of, none_of, label, pattern in rules:
        hit = F.lit(False)
        for word in any_of:
            hit = hit | ua.contains(word)
        for word in none_of:
            hit = hit & ~ua.contains(word)
        found = F.lit(None).cast("string")
        if pattern:
            text = F.regexp_extract(ua, pattern, 1)
            found = F.when(text != "", F.replace(text, F.lit("_"), F.lit(".")))
        name = F.when(hit, label) if name is None else name.when(hit, label)
        version = F.when(hit, found) if version is None else version.when(hit, found)
    return name.otherwise("unknown"), version


def parse_device(user_agent: Column) -> Column:
    """device struct from a user agent: type, os and browser with versions."""
    ua = F.lower(user_agent)
    missing = user_agent.isNull() | (user_agent == "")
    kind = F.when(ua.rlike(MOBILE_PATTERN), "mobile").when(ua.rlike(TABLET_PATTERN), "tablet").otherwise("desktop")
    os_name, os_version = _by_rules(ua, OS_RULES)
    browser, browser_version = _by_rules(ua, BROWSER_RULES)
    known = lambda c: F.when(missing, F.lit("unknown")).otherwise(c)
    return F.struct(
        known(kind).alias("type"),
        F.struct(known(os_name).alias("name"), os_version.alias("version")).alias("os"),
        F.struct(known(browser).alias("name"), browser_version.alias("version")).alias("browser"))


def client_ip(headers: dict[str, Column], remote: Column | None = None) -> Column:
    """First valid public address among the headers (first entry of each), else the connection's own."""
    candidates = []
    for name in ADDRESS_HEADERS:
        if name in headers:
            first = F.trim(F.split(headers[name], ",")[0])
            valid = (first.rlike(IPV4_PATTERN) | first.rlike(IPV6_PATTERN)) & ~first.rlike(PRIVATE_PATTERN)
            candidates.append(F.when(valid, first))
    return F.coalesce(*candidates, *([remote] if remote is not None else []))


def processed(payloads: DataFrame, user_agent: str = "user_agent", addresses: dict[str, str] | None = None,
              batch: str = "batch_id") -> DataFrame:
    """A whole ingest of track payloads: each with its `outcome` (accepted, duplicate or rejected), `errors`, the device
    that its user agent tells, the client's address and the page's path.

    A batch over the allowed size is rejected whole. Duplicates are counted among valid payloads, the first arrival being
    accepted. `addresses` names the columns of address headers. Rejected rows are the quarantine, accepted ones the events.
    """
    columns = payloads.columns
    large = validate_batches(payloads, batch).select(F.col(batch).alias("_large"))
    checked = validate_events(payloads).join(large, F.col(batch) == F.col("_large"), "left").withColumn(
        "errors", F.when(F.col("_large").isNotNull(), F.array_append("errors", "batch_size")).otherwise(F.col("errors"))).drop("_large")
    valid, refused = checked.where(F.size("errors") == 0), checked.where(F.size("errors") > 0)
    rows = mark_duplicates(valid).unionByName(refused.withColumn("is_duplicate", F.lit(False)))
    outcome = F.when(F.size("errors") > 0, "rejected").when(F.col("is_duplicate"), "duplicate").otherwise("accepted")
    headers = {header: F.col(column) for header, column in (addresses or {}).items()}
    page = [F.col(c) if c in columns else F.lit(None).cast("string") for c in ("page_path", "page_url")]
    return rows.select(
        *columns, "event_time", "errors", outcome.alias("outcome"),
        parse_device(F.col(user_agent) if user_agent in columns else F.lit(None).cast("string")).alias("parsed_device"),
        (client_ip(headers) if headers else F.lit(None).cast("string")).alias("client_address"), page_path(*page).alias("path"))


def page_path(path: Column, url: Column) -> Column:
    """The given path, else the URL's; null for a URL that cannot be parsed."""
    return F.coalesce(path, F.try_parse_url(url, F.lit("PATH")))

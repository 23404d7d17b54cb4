"""Rollups kept up to date batch by batch, equal to a full build.

A batch changes the states of its users only. Each changed user is taken out of the partial sums of the day and step it
was counted in and put into those it belongs to now, so a refresh reads the states of its own users and rewrites the
partial sums of the days they left or reached; all other days stay as they are. Sums are whole numbers, so taking out and
putting in leaves no rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.columns import round_half_up
from trailmark.operators.matching import FUNNEL_COLUMNS
from trailmark.operators.rollups import DAILY_DAYS, days_before
from trailmark.params import FUNNEL, SCOPE, timestamp
from trailmark.sources.keyed import BUCKETS, Keyed, KeyedStore

USER = [*SCOPE, *FUNNEL_COLUMNS, "anonymous_id"]
DAY = [*FUNNEL, "window_days", "current_step_index", "activity_date"]
STATE = """tenant_id bigint, workspace_id bigint, funnel_id bigint, funnel_version_id bigint, window_days int, total_steps int,
  anonymous_id string, entered_at timestamp, last_activity_at timestamp, current_step_index int, completed boolean,
  lead_id bigint, lead_order struct<timestamp: timestamp, id: bigint>"""
DAILY = """tenant_id bigint, workspace_id bigint, funnel_id bigint, window_days int, current_step_index int, activity_date date,
  users bigint, completions bigint, conversion_micros bigint"""
BOUNDS = "tenant_id bigint, workspace_id bigint, funnel_id bigint, first_entry timestamp, last_activity timestamp"


def rollup_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, path, {
        "state": Keyed(STATE, [*FUNNEL, "anonymous_id"], buckets), "daily": Keyed(DAILY, [*FUNNEL, "activity_date"], buckets),
        "bounds": Keyed(BOUNDS, FUNNEL, max(1, buckets // 8))})


def state_changes(matched: DataFrame) -> DataFrame:
    order = F.struct("timestamp", "id")
    lead = F.col("lead_id") if "lead_id" in matched.columns else F.lit(None).cast("bigint")
    known = F.when(lead.isNotNull(), order)
    return matched.groupBy(*USER).agg(
        F.min("timestamp").alias("entered_at"), F.max("timestamp").alias("last_activity_at"), F.max("step_order").alias("current_step_index"),
        F.bool_or(F.col("step_type") == "conversion").alias("completed"), F.max_by(lead, known).alias("lead_id"), F.max(known).alias("lead_order"))


def fold_states(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*USER).agg(
        F.min("entered_at").alias("entered_at"), F.max("last_activity_at").alias("last_activity_at"),
        F.max("current_step_index").alias("current_step_index"), F.bool_or("completed").alias("completed"),
        F.max_by("lead_id", "lead_order").alias("lead_id"), F.max("lead_order").alias("lead_order"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DAY).agg(
        F.sum("users").alias("users"), F.sum("completions").alias("completions"), F.sum("conversion_micros").alias("conversion_micros"))


def fold_daily(rows: DataFrame) -> DataFrame:
    """Sums of each day and step; where nobody is left, none."""
    return summed(rows).where("users <> 0")


def fold_bounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FUNNEL).agg(F.min("first_entry").alias("first_entry"), F.max("last_activity").alias("last_activity"))


def _counted(states: DataFrame, sign: int) -> DataFrame:
    """What each state adds to (or, with sign -1, takes from) the sums of its day and step."""
    micros = F.unix_micros("last_activity_at") - F.unix_micros("entered_at")
    done = F.col("completed").cast("bigint") * sign
    return states.select(*FUNNEL, "window_days", "current_step_index", F.to_date("last_activity_at").alias("activity_date"),
                         F.lit(sign).cast("bigint").alias("users"), done.alias("completions"), (done * micros).alias("conversion_micros"))


def refresh(store: KeyedStore, matched: DataFrame, batch_id: int, writer: str = "matched") -> bool:
    """Takes a batch of matched events into the rollups; False if it was applied before."""
    version = store.version()
    if version.batches.get(writer, -1) >= batch_id:
        return False
    with store.staged(state_changes(matched)) as [changes]:
        stored = store.read("state", store.buckets_of("state", changes), version)
        before = stored.join(changes.select(*USER), USER, "left_semi")
        after = fold_states(before.unionByName(changes))
        daily = summed(_counted(before, -1).unionByName(_counted(after, 1)))
        bounds = changes.select(*FUNNEL, F.col("entered_at").alias("first_entry"), F.col("last_activity_at").alias("last_activity"))
        # days a user left and reached again cancel out in the batch already
        with store.staged(daily) as [daily]:
            return store.upsert({"state": (changes, fold_states), "daily": (daily, fold_daily), "bounds": (fold_bounds(bounds), fold_bounds)},
                                writer, batch_id)


def _given_up(as_of: str) -> Column:
    """Whether the open users of a day have been idle for longer than the funnel's window, at the start of a day."""
    return F.col("activity_date") < F.date_sub(F.to_date(timestamp(as_of)), F.col("window_days"))


def daily_step_completions(store: KeyedStore, as_of: str) -> DataFrame:
    """As `rollups.daily_step_completions` of the states at the start of the day `as_of`, from the partial sums."""
    rows = store.read("daily").where(F.col("activity_date") >= F.to_date(days_before(as_of, DAILY_DAYS)))
    exits = F.sum(F.when(_given_up(as_of), F.col("users") - F.col("completions")).otherwise(0))
    return rows.groupBy(*FUNNEL, "current_step_index", "activity_date").agg(
        F.sum("users").alias("users_at_step"), F.sum("completions").alias("completions"), exits.alias("exits"),
        (F.try_divide(F.sum("conversion_micros"), F.sum("completions")) / F.lit(1e6)).alias("avg_conversion_time"))


def conversion_summary(store: KeyedStore, funnels: DataFrame, as_of: str) -> DataFrame:
    """As `rollups.conversion_summary` of the states at the start of the day `as_of`, from the partial sums."""
    gone = F.sum(F.when(_given_up(as_of), F.col("users") - F.col("completions")).otherwise(0))
    facts = store.read("daily").groupBy(*FUNNEL).agg(
        F.sum("users").alias("total_users"), F.sum("completions").alias("conversions"), gone.alias("exits"), gone.alias("abandoned"),
        (F.try_divide(F.sum("conversion_micros"), F.sum("completions")) / F.lit(1e6)).alias("avg_conversion_time"))
    live = funnels.where("archived_at is null").select(*SCOPE, F.col("id").alias("funnel_id"), F.col("name").alias("funnel_name"))
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total_users", "conversions", "exits", "abandoned")]
    return live.join(facts, FUNNEL, "left").join(store.read("bounds"), FUNNEL, "left").select(
        *FUNNEL, "funnel_name", *counts, F.when(F.col("total_users") > 0, round_half_up(F.col("conversions") / F.col("total_users") * 100))
        .alias("conversion_rate"), "avg_conversion_time", "first_entry", "last_activity")

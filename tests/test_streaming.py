"""Batch and stream agree, at several micro-batch splits and with late rows."""

from __future__ import annotations

import itertools
import random

import pytest
from helpers import at, events, rows
from pyspark.sql import functions as F

from trailmark.operators import sessions
from trailmark.operators.matching import match_funnel_events
from trailmark.operators.state import funnel_user_state, progression_events
from trailmark.streaming import ingest as stream_ingest
from trailmark.streaming import sinks, sources
from trailmark.streaming import state as streams

NAMES = itertools.count()


def replay(spark, df, folder, files: int, order=("timestamp", "id")):
    """The rows as a stream of `files` files in the given order."""
    all_rows = df.orderBy(*order).collect()
    size = -(-len(all_rows) // files)
    for n in range(files):
        spark.createDataFrame(all_rows[n * size:(n + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(
            f"{folder}/f={n:04d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/f=*")


def drain(spark, stream, folder, mode="append"):
    name = f"out_{next(NAMES)}"
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", f"{folder}/checkpoint_{name}").trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.mark.parametrize("files", [1, 4])
def test_funnel_state(spark, inputs, folder, files):
    """Whatever the split and the order of arrival, the last update per user is the batch result."""
    ev = inputs.anonymous_events.drop("value")
    stream = replay(spark, ev, f"{folder}/in", files, order=(F.xxhash64("id"),))
    path = f"{folder}/state"
    query = (streams.state_stream(match_funnel_events(stream, inputs.defs)).writeStream.outputMode("update")
             .foreachBatch(sinks.change_writer(path)).option("checkpointLocation", f"{folder}/c")
             .trigger(availableNow=True).start())
    query.awaitTermination(300)
    batch = funnel_user_state(match_funnel_events(ev, inputs.defs))
    columns = ["funnel_id", "anonymous_id", "current_step_index", "entered_at", "last_activity_at", "completed_at", "status"]
    assert rows(sinks.read_folded(spark, path, sinks.fold_state), *columns) == rows(batch, *columns)


def test_replayed_batch_changes_nothing(spark, folder):
    links = spark.createDataFrame([(1, 1, "a_1", "e:x", at(1), at(2))],
                                  "tenant_id bigint, workspace_id bigint, anonymous_id string, lead_key string, "
                                  "first_at timestamp, last_at timestamp")
    write = sinks.change_writer(f"{folder}/links")
    later = links.withColumns({"first_at": F.lit(at(5)), "last_at": F.lit(at(9))})
    for batch_id, rows_ in ((0, links), (1, later), (1, later)):
        write(rows_, batch_id)
    found = sinks.read_folded(spark, f"{folder}/links", sinks.fold_links).collect()
    assert [(r.first_at, r.last_at) for r in found] == [(at(1), at(9))]
    sinks.compact(spark, f"{folder}/links", sinks.fold_links, f"{folder}/compacted")
    assert sinks.read_folded(spark, f"{folder}/compacted", sinks.fold_links).count() == 1


def test_visitors_fold_from_parts(spark, inputs, folder):
    from trailmark.operators.identity import visitors

    write = sinks.change_writer(f"{folder}/visitors", visitors)
    for part in range(3):
        write(inputs.anonymous_events.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part), part)
    columns = ["anonymous_id", "first_seen_at", "last_seen_at", "first_utm", "last_device"]
    assert rows(sinks.read_folded(spark, f"{folder}/visitors", sinks.fold_visitors), *columns) == rows(
        visitors(inputs.anonymous_events), *columns)


def test_latest_lead_joins_a_stream(spark, folder):
    ev = _late_events(spark, 1)
    links = spark.createDataFrame([(1, 1, "a_1", "e:x", at(0), at(1)), (1, 1, "a_1", "e:y", at(0), at(2))],
                                  "tenant_id bigint, workspace_id bigint, anonymous_id string, lead_key string, "
                                  "first_at timestamp, last_at timestamp")
    found = drain(spark, stream_ingest.with_latest_lead(replay(spark, ev, f"{folder}/in", 2), links), folder)
    assert {(r.anonymous_id, r.lead_key) for r in found.collect()} == {
        ("a_0", None), ("a_1", "e:y"), ("a_2", None), ("a_end", None)}


def _late_events(spark, seed):
    rng = random.Random(seed)
    made = [{"id": n, "t": rng.randrange(4 * 3600), "who": f"a_{rng.randrange(3)}"} for n in range(120)]
    return events(spark, made + [{"id": 999, "t": 30 * 86400, "who": "a_end"}]).select(
        "id", "tenant_id", "workspace_id", "anonymous_id", "timestamp", "session_id")


@pytest.mark.parametrize("files", [2, 5])
def test_anchored_sessions(spark, folder, files):
    """Rows up to four minutes late are put in order before they are anchored."""
    ev = _late_events(spark, files)
    jitter = F.unix_micros("timestamp") + F.pmod(F.xxhash64("id"), F.lit(240)) * 1_000_000
    stream = replay(spark, ev, f"{folder}/in", files, order=(jitter,))
    found = drain(spark, streams.anchored_sessions(stream), folder).where("anonymous_id <> 'a_end'")
    batch = sessions.anchored_starts(ev).where("anonymous_id <> 'a_end'")
    assert rows(found, "id", "session_start") == rows(batch, "id", "session_start")


def test_gap_sessions(spark, folder):
    ev = _late_events(spark, 9)
    found = drain(spark, streams.gap_sessions(replay(spark, ev, f"{folder}/in", 3)), folder).where("anonymous_id <> 'a_end'")
    batch = sessions.sessions_of(sessions.sessionize(ev, "gap")).where("anonymous_id <> 'a_end'")
    assert rows(found, "anonymous_id", "started_at", "ended_at", "events") == rows(
        batch, "anonymous_id", "started_at", "ended_at", "events")


def test_progressions_and_abandonment(spark, inputs, folder):
    ev = inputs.anonymous_events.drop("value")
    end = ev.limit(1).withColumns({"id": F.lit(10**9).cast("bigint"), "timestamp": F.lit(at(60 * 86400)),
                                   "anonymous_id": F.lit("a_end"), "event_name": F.lit("view")})
    stream = replay(spark, ev.unionByName(end), f"{folder}/in", 3)
    found = drain(spark, streams.progression_stream(match_funnel_events(stream, inputs.defs)), folder)
    moved = found.where("not is_abandoned and anonymous_id <> 'a_end'")
    batch = progression_events(match_funnel_events(ev, inputs.defs))
    columns = ["funnel_id", "anonymous_id", "step_order", "timestamp", "is_entry", "is_advance", "is_conversion"]
    assert rows(moved, *columns) == rows(batch, *columns)
    gone = found.where("is_abandoned and anonymous_id <> 'a_end'")
    active = funnel_user_state(match_funnel_events(ev, inputs.defs)).where("status = 'active'")
    assert rows(gone, "funnel_id", "anonymous_id") == rows(active, "funnel_id", "anonymous_id")


def test_minute_counts(spark, inputs, folder):
    steps = progression_events(match_funnel_events(inputs.anonymous_events, inputs.defs)).withColumn("id", F.col("step_order"))
    last = steps.limit(1).withColumns({"timestamp": F.lit(at(60 * 86400)), "is_entry": F.lit(False)})
    stream = replay(spark, steps.unionByName(last), f"{folder}/in", 2)
    found = drain(spark, streams.live_counts(stream), folder)
    batch = steps.groupBy("funnel_id", F.date_trunc("minute", "timestamp").alias("minute")).agg(
        F.count_if("is_entry"), F.count_if("is_conversion"))
    assert rows(found, "funnel_id", "minute", "entries", "conversions") == rows(batch)
    assert drain(spark, streams.trailing_counts(stream), folder).count() > found.count()


def test_ingest(spark, folder):
    base = {"tenant_id": 1, "workspace_id": 1, "batch_id": 0, "event_name": "view", "anonymous_id": "a_1"}
    made = []
    for n in range(40):
        made.append({**base, "id": n, "event_id": f"e{n // 2}" if n % 5 else None, "timestamp": str(at(n)),
                     "ingested_at": at(n), "session_id": "s_1", "device": '{"type": "mobile"}',
                     "page": {"url": "https://h.io/p?x", "title": None, "referrer": None, "path": None}})
    made.append({**base, "id": 100, "timestamp": str(at(0)), "ingested_at": at(301)})
    made.append({**base, "id": 101, "timestamp": str(at(0)), "ingested_at": at(0), "anonymous_id": "x"})
    import json
    import os

    os.makedirs(f"{folder}/in")
    for part in range(3):
        with open(f"{folder}/in/{part}.json", "w") as out:
            out.writelines(json.dumps({**r, "ingested_at": str(r["ingested_at"])}) + "\n" for r in made[part::3])
    stream = sources.payload_stream(spark, f"{folder}/in", max_files=1)
    valid, bad = stream_ingest.split(stream_ingest.checked(stream))
    assert rows(drain(spark, bad.select("id", F.array_join("errors", ",").alias("e")), folder)) == [
        (100, "too_old"), (101, "anonymous_id")]
    accepted = drain(spark, stream_ingest.deduplicated(stream_ingest.events_of(valid)), folder)
    keys = {(n // 2) if n % 5 else f"none {n}" for n in range(40)}
    assert accepted.count() == len(keys)
    assert accepted.first().page.path == "/p" and accepted.first().device.type == "mobile"
    messages = spark.createDataFrame([(json.dumps({"id": 7, "event_name": "x"}),)], "value string")
    assert sources.from_messages(messages).first().id == 7

"""Distributed ways against brute force, with hot keys forced onto them."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from helpers import BASE, at, events, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import cohorts, sessions, state, timing
from trailmark.operators.blocks import as_of, carry_forward, number_rows
from trailmark.operators.matching import FUNNEL_COLUMNS, match_funnel_events
from trailmark.operators.percentiles import distribution
from trailmark.params import FUNNEL, Period

KEYS = ["tenant_id", "workspace_id", "anonymous_id"]


def random_events(spark, seed: int, span: int, count: int, users: int = 3):
    """Most events belong to one hot user."""
    rng = random.Random(seed)
    made = []
    for n in range(count):
        who = "a_hot" if rng.random() < 0.7 else f"a_{rng.randrange(users)}"
        made.append({"id": n, "t": rng.randrange(span * 1000) / 1000, "who": who})
    return events(spark, made)


@pytest.mark.parametrize("span", [3 * 3600, 5 * 86400])
def test_anchored_sessions_agree_with_a_plain_loop(spark, span):
    ev = random_events(spark, span, span, 400)
    expected = {}
    state: dict[str, object] = {}
    for r in sorted(ev.collect(), key=lambda r: (r.timestamp, r.id)):
        start = state.get(r.anonymous_id)
        if start is None or r.timestamp - start > timedelta(minutes=30):
            state[r.anonymous_id] = start = r.timestamp
        expected[r.id] = start
    folded = {r.id: r.session_start for r in sessions.anchored_starts(ev, 10_000).select("id", "session_start").collect()}
    chained = {r.id: r.session_start for r in sessions.anchored_starts(ev, 5).select("id", "session_start").collect()}
    assert folded == expected
    assert chained == expected


def test_session_edges(spark):
    ev = events(spark, [{"t": 0}, {"t": 1800}, {"t": 1800.001}, {"t": 3000}, {"t": 3600.001}, {"t": 9, "session": "s_own"}])
    found = {r.id: r for r in sessions.sessionize(ev).collect()}
    assert found[1].session_start == at(0)  # exactly 30 minutes still belongs
    assert found[2].session_start == at(1800.001)
    assert found[4].session_start == at(1800.001)
    assert found[5].session_id == "s_own"
    gap = {r.id: r.session_start for r in sessions.sessionize(ev.where("session_id is null"), "gap").collect()}
    assert gap[1] == at(1800) and gap[4] == at(1800)
    assert sessions.sessions_of(sessions.sessionize(ev)).count() == 3


def test_sessionize_keeps_every_row(spark):
    ev = random_events(spark, 5, 86400, 200)
    for mode in ("anchored", "gap"):
        assert sessions.sessionize(ev, mode, fold_limit=5).count() == 200


def test_blocks_agree_with_windows(spark):
    ev = random_events(spark, 7, 6 * 86400, 300).withColumn("lead", F.when(F.col("id") % 7 == 0, F.col("id")))
    whole = Window.partitionBy(*KEYS).orderBy("timestamp", "id")
    plain = ev.select("id", F.row_number().over(whole), F.lag("timestamp").over(whole),
                      F.last("lead", True).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    blocked = carry_forward(number_rows(ev, KEYS), KEYS, "lead", "last_lead")
    assert rows(blocked, "id", "position", "previous_at", "last_lead") == rows(plain)


def test_as_of_takes_updates_of_the_same_instant(spark):
    ev = events(spark, [{"t": 5, "who": "a_1"}, {"t": 9, "who": "a_1"}, {"t": 100_000, "who": "a_1"}, {"t": 3, "who": "a_2"}])
    updates = spark.createDataFrame([(1, 1, "a_1", at(9), "x"), (1, 1, "a_1", at(50), "y")],
                                    "tenant_id bigint, workspace_id bigint, anonymous_id string, timestamp timestamp, v string")
    assert rows(as_of(ev, updates, KEYS, "v"), "id", "v") == [(0, None), (1, "x"), (2, "y"), (3, None)]


def test_distribution_agrees_with_percentile(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.choice([rng.randrange(10**8), 5_000_000]))
            for _ in range(500)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(data, "k string, v bigint")
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    found = {r.k: r for r in distribution(df, ["k"], F.col("v"), probs, {"twice": F.lit(2)}).collect()}
    plain = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("p"),
                                F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.count("*").alias("c")).collect()
    assert len(found) == len(plain)
    for r in plain:
        got = found[r.k]
        assert got.rows == r.c and got.twice == 2 * r.c
        if r.m is None:
            assert got["mean"] is None and got.n == 0
            continue
        assert [got[p] for p in probs] == pytest.approx([x / 1e6 for x in r.p])
        assert got["mean"] == pytest.approx(r.m / 1e6)
        assert (got["stddev"] is None and r.sd is None) or got["stddev"] == pytest.approx(r.sd / 1e6)
    assert {r.k for r in distribution(df, ["k"], F.col("v"), probs, min_rows=2).collect()} == {
        r.k for r in plain if r.c >= 2}


def _matched(spark, seed: int):
    ev = random_events(spark, seed, 20 * 86400, 250)
    return ev.withColumns({
        "step_order": (F.col("id") % 3).cast("int"), "step_type": F.lit("page"), "funnel_id": F.lit(1).cast("bigint"),
        "funnel_version_id": F.lit(1).cast("bigint"), "window_days": F.lit(7), "total_steps": F.lit(3)})


def test_step_transitions_agree_with_all_pairs(spark):
    assert FUNNEL_COLUMNS
    matched, period = _matched(spark, 11), Period(BASE, BASE + timedelta(days=15))
    all_rows = matched.collect()
    pairs, alone, waits = defaultdict(list), defaultdict(int), defaultdict(list)
    for a in all_rows:
        if a.timestamp > period.end:
            continue
        later = [(b.timestamp - a.timestamp).total_seconds() for b in all_rows
                 if b.anonymous_id == a.anonymous_id and b.step_order == a.step_order + 1
                 and a.timestamp < b.timestamp <= a.timestamp + timedelta(days=7)]
        pairs[a.step_order] += later
        alone[a.step_order] += not later
        waits[a.step_order].append(min(later) if later else None)
    found = {r.step_order: r for r in timing.step_transition_pairs(matched, period).collect()}
    for step, values in pairs.items():
        assert (found[step].pairs, found[step].without_next) == (len(values), alone[step])
        if values:
            assert found[step].avg_pair_seconds == pytest.approx(sum(values) / len(values))
    nearest = defaultdict(list)
    for r in timing.nearest_next(matched, period).collect():
        nearest[r.step_order].append(None if r.wait_micros is None else r.wait_micros / 1e6)
    key = lambda v: (v is None, v)
    for step, values in waits.items():
        assert sorted(nearest[step], key=key) == pytest.approx(sorted(values, key=key))
    assert set(FUNNEL) <= set(matched.columns)


def test_step_transitions_read_matched_events_once(spark):
    """Gaps of about 7 days, within an hour and across hours; the events are read once, not once for each figure."""
    week = 7 * 86400
    times = [(0, 0), (0, 1), (0, 3599.5), (0, week), (1, week), (1, week + 1), (0, week + 5), (1, 2 * week + 6), (0, 3 * week), (1, 3 * week + 1800)]
    matched = events(spark, [{"t": t} for _, t in times]).withColumns({
        "step_order": F.element_at(F.array(*[F.lit(s) for s, _ in times]), (F.col("id") + 1).cast("int")),
        "funnel_id": F.lit(1).cast("bigint"), "total_steps": F.lit(2)})
    out = timing.step_transition_pairs(matched, Period(BASE, BASE + timedelta(days=60)))
    waits = [[b - a for s, b in times if s == 1 and a < b <= a + week] for r, a in times if r == 0]
    first = next(r for r in out.collect() if r.step_order == 0)
    assert (first.events, first.without_next, first.pairs) == (len(waits), sum(not w for w in waits), sum(map(len, waits)))
    assert first.avg_pair_seconds == pytest.approx(sum(map(sum, waits)) / first.pairs)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Scan") == 1


def test_states_of_one_workspace_are_dealt_by_visitor(spark, inputs):
    """Matching leaves no partitioning by workspace behind that the fold of the events would inherit."""
    seen = events(spark, [{"id": n, "who": f"a_{n % 200}", "name": ("view", "purchase")[n % 2]} for n in range(400)]).drop("lead_id")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        users = state.funnel_user_state(match_funnel_events(seen, inputs.defs))
        plan = users._jdf.queryExecution().executedPlan().toString()
        dealt = users.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < sum(r["count"] for r in dealt) / 2
    fold = plan[:plan.index("Generate")]
    assert "SortAggregate" not in fold and "Sort [" not in fold  # nor are a task's rows sorted to be folded


def test_cohort_values_are_counted_from_one_row_per_visitor(spark):
    schema = """tenant_id bigint, workspace_id bigint, funnel_id bigint, anonymous_id string, entered_at timestamp"""
    users = spark.createDataFrame([(1, 1, 7, w, at(0)) for w in ("a", "b", "c")] + [(1, 1, 7, None, at(0)), (1, 1, 8, "a", at(9))], schema)
    seen = events(spark, [{"who": "a", "t": 0, "device": "x", "source": "s"}, {"who": "a", "t": 5, "device": "x"}, {"who": "a", "t": 9, "device": "y"},
                          {"who": "b", "t": 86400, "device": "x"}, {"who": "b", "t": 86401, "device": "y"}])
    found = cohorts.cohorts(users, seen, Period.of("2024-01-01", "2024-01-02"))
    got = rows(found, "funnel_id", "dimension", "value", "users", "cohort_size")
    assert got == sorted([
        (7, "device", "x", 2, 4), (7, "device", "y", 1, 4), (7, "device", "unknown", 2, 4), (7, "source", "s", 1, 4), (7, "source", "direct", 4, 4),
        (7, "geo", "unknown", 4, 4), (8, "device", "y", 1, 1), (8, "source", "direct", 1, 1), (8, "geo", "unknown", 1, 1)], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    by_visitor = [line for line in plan.splitlines() if "Aggregate [" in line and "anonymous_id" in line]
    assert by_visitor and not any("dimension" in line.split("], [")[0] for line in by_visitor)  # not a row per visitor and value

"""Rollups refreshed batch by batch against a full build, and states as of an instant."""

from __future__ import annotations

import random

import pytest
from helpers import at, events, rows
from test_edges import SIMPLE, definitions

from trailmark.operators import live, refresh, rollups
from trailmark.operators.matching import match_funnel_events
from trailmark.operators.state import abandon_users, funnel_user_state, state_as_of

AS_OF = "2024-01-20 00:00:00"
DAY_S = 86_400


def made(seed: int, n: int = 240) -> list[dict]:
    draw = random.Random(seed)
    return [{"id": k, "who": f"a_{draw.randint(0, 25)}", "t": draw.randint(0, 15 * DAY_S), "name": draw.choice("abcde"),
             "lead": draw.choice([None, None, 7, 8]), "ws": draw.choice([1, 1, 2])} for k in range(n)]


@pytest.mark.parametrize("parts", [1, 4])
def test_refreshed_rollups_equal_a_full_build(spark, tmp_path, parts):
    defs, all_rows = definitions(spark, SIMPLE, window=3), made(parts)
    store = refresh.rollup_store(spark, str(tmp_path / "rollups"), 4)
    for number in range(parts):
        batch = match_funnel_events(events(spark, all_rows[number::parts]), defs)
        assert refresh.refresh(store, batch, number)
        assert not refresh.refresh(store, batch, number)
    state = abandon_users(funnel_user_state(match_funnel_events(events(spark, all_rows), defs)), AS_OF)
    daily = ["current_step_index", "activity_date", "users_at_step", "completions", "exits"]
    got, want = refresh.daily_step_completions(store, AS_OF), rollups.daily_step_completions(state, AS_OF)
    assert rows(got, *daily) == rows(want, *daily) and sum(r.exits for r in got.collect()) > 0
    near = lambda df: sorted((str(r.activity_date), r.current_step_index, round(r.avg_conversion_time or -1, 3)) for r in df.collect())
    assert near(got) == near(want)
    total = ["funnel_id", "total_users", "conversions", "exits", "abandoned", "conversion_rate", "first_entry", "last_activity"]
    assert rows(refresh.conversion_summary(store, defs.funnels, AS_OF), *total) == rows(rollups.conversion_summary(defs.funnels, state), *total)
    leads = {(r.anonymous_id, r.lead_id) for r in store.read("state").collect()}
    assert leads == {(r.anonymous_id, r.lead_id) for r in state.collect()} and any(x for _, x in leads)


def test_only_days_left_or_reached_are_rewritten(spark, tmp_path):
    defs = definitions(spark, SIMPLE, window=3)
    store = refresh.rollup_store(spark, str(tmp_path / "rollups"), 64)
    first = [{"id": d, "who": f"a_{d}", "t": d * DAY_S + 5, "name": "a"} for d in range(12)]
    refresh.refresh(store, match_funnel_events(events(spark, first), defs), 0)
    before = store.version()
    refresh.refresh(store, match_funnel_events(events(spark, [{"id": 99, "who": "a_3", "t": 7 * DAY_S, "name": "b"}]), defs), 1)
    changed = {k for k, folder in store.version().folders.items() if k[0] == "daily" and before.folders.get(k) != folder}
    assert 1 <= len(changed | (before.folders.keys() - store.version().folders.keys())) <= 3
    found = {str(r.activity_date): r.users_at_step for r in refresh.daily_step_completions(store, AS_OF).collect() if r.current_step_index == 0}
    assert "2024-01-04" not in found and found["2024-01-08"] == 1


def test_state_as_of_an_instant(spark):
    ev = events(spark, [{"who": "a", "t": 0, "name": "a"}, {"who": "a", "t": 5000, "name": "d"}, {"who": "b", "t": 100, "name": "b"},
                        {"who": "c", "t": 9000, "name": "a"}])
    defs = definitions(spark, SIMPLE)
    matched = match_funnel_events(ev, defs)
    past, later = state_as_of(matched, str(at(200))), state_as_of(matched, str(at(6000)))
    assert rows(past, "anonymous_id", "status", "last_activity_at") == [("a", "active", at(0)), ("b", "active", at(100))]
    assert rows(later, "anonymous_id", "status") == [("a", "completed"), ("b", "active")]
    found = live.live_basic(past, defs.steps_of_latest(), str(at(200))).first()
    assert (found.active_users, found.entries_last_hour, found.conversions_last_hour) == (2, 2, 0)  # whoever acts later is active now


def test_attribution_plans_its_input_four_times_at_most(spark, inputs):
    from trailmark.plans.registry import load_all

    registry = load_all()
    for name, scans in (("attribution", 4), ("attr_time_decay", 4), ("credit_distribution", 2), ("user_journeys", 4), ("match_funnel_events", 1)):
        plan = registry[name](spark, inputs.sf_dir)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan parquet") <= scans, name


def test_returning_visitors_without_their_history(spark):
    from trailmark.operators import traffic
    from trailmark.operators.identity import visitors
    from trailmark.params import Period

    period = Period.of("2024-01-05", "2024-01-08")
    ev = events(spark, [{"who": "old", "t": 0}, {"who": "old", "t": 5 * DAY_S, "lead": 3}, {"who": "new", "t": 5 * DAY_S}, {"who": "later", "t": 12 * DAY_S}])
    seen, inside = visitors(ev), ev.where(period.contains("timestamp"))
    for report in (traffic.user_summary, traffic.user_analytics):
        assert rows(report(inside, period, seen)) == rows(report(ev, period))
    assert traffic.user_summary(inside, period, seen).first().returning_visitors == 1

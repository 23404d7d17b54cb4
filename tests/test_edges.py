"""Thresholds and odd inputs, on hand-built frames."""

from __future__ import annotations

import json
import math
from datetime import timedelta

import pytest
from helpers import BASE, at, events, rows
from pyspark.sql import functions as F

from trailmark.functions.columns import duration_text, normal_cdf, round_half_up, week_of_year_label, wildcard_match
from trailmark.operators import anomalies, attribution, comparison, conversion, dropoff, identity, ingest, journeys, live, state, traffic
from trailmark.operators.matching import bad_rules, match_funnel_events
from trailmark.params import Period
from trailmark.sources.definitions import Definitions, funnel_inventory, validate_funnel_defs
from trailmark.sources.events import derive_sessions, read_events, write_events

DAY = Period(BASE, BASE + timedelta(days=1))
MONTH = Period(BASE, BASE + timedelta(days=30))


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# -------------------------------------------------------------------- columns
def test_rounding_goes_up_at_half(spark):
    assert one(spark, round_half_up(F.lit(2.5), 0)) == 3.0
    assert one(spark, round_half_up(F.lit(-2.5), 0)) == -2.0


@pytest.mark.parametrize("z, p", [(0.0, 0.5), (1.96, 0.975), (-1.0, 0.158655), (6.0, 1.0)])
def test_normal_cdf(spark, z, p):
    assert one(spark, normal_cdf(F.lit(z))) == pytest.approx(p, abs=1e-5)


@pytest.mark.parametrize("value, pattern, hit", [
    ("https://example.com/cart", "*example.com/c*", True), ("https://exampleXcom/cart", "*example.com/c*", False),
    ("/a/b", "/a/?*", True), ("/A/PRODUCT", "product", True), ("a+b", "a+b", True), ("x(1)y", "x(1)*", True),
    ("abc", "abd*", False)])
def test_wildcards(spark, value, pattern, hit):
    assert one(spark, wildcard_match(F.lit(value), pattern)) is hit


def test_labels(spark):
    assert one(spark, week_of_year_label(F.lit("2024-01-07").cast("timestamp"))) == "2024-W01"
    assert one(spark, week_of_year_label(F.lit("2024-01-08").cast("timestamp"))) == "2024-W02"
    assert [one(spark, duration_text(F.lit(float(s)))) for s in (59, 60, 3600, 172800)] == ["59s", "1m", "1h", "2d"]


def test_sql_functions(spark):
    from trailmark.functions.sql import register_sql_functions

    assert len(register_sql_functions(spark)) == 4
    row = spark.sql("""SELECT normal_cdf(1.96D) AS p, normal_cdf(-1D) AS q, week_label(TIMESTAMP'2024-01-08') AS w,
      touchpoint_type(NULL, 'https://social.io') AS t, wildcard_match('https://h.io/Cart', '*h.io/c*') AS hit,
      wildcard_match('https://hxio/cart', '*h.io/c*') AS miss, wildcard_match('a+B', 'A+b') AS inside""").first()
    assert (row.p, row.q) == (pytest.approx(0.975, abs=1e-5), pytest.approx(0.158655, abs=1e-5))
    assert tuple(row)[2:] == ("2024-W02", "social", True, False, True)


# -------------------------------------------------------------------- traffic
def test_gaps_before_between_and_after(spark):
    ev = events(spark, [{"t": 2 * 86400}, {"t": 4 * 86400}, {"t": 4 * 86400 + 1}])
    week = Period(BASE, BASE + timedelta(days=5))
    found = traffic.timeseries(ev, week, "day", ("events",))
    assert [r.events for r in found.orderBy("period").collect()] == [0, 0, 1, 0, 2, 0]


def test_activity_bounds_and_bounce(spark):
    made = []
    for n in (1, 2, 3, 9, 10):
        made += [{"t": n * 100 + k, "who": f"a_{n}", "session": f"s_{n}"} for k in range(n)]
    ev = events(spark, made)
    empty = spark.createDataFrame([(1, 1, "s_0", "a_0", at(5), at(5))], derive_sessions(ev).schema)
    sessions = derive_sessions(ev).unionByName(empty)
    levels = {r.activity_level: r.visitors for r in traffic.activity_levels(sessions, ev, DAY).collect()}
    assert levels == {"high_activity": 1, "medium_activity": 2, "low_activity": 3}
    quality = traffic.session_metrics(sessions, ev, DAY).first()
    assert quality.sessions == 6 and quality.bounce_rate == pytest.approx(100 / 6)
    assert quality.avg_session_duration == pytest.approx((1 + 2 + 8 + 9) / 4)


def test_overview_without_a_previous_period(spark):
    ev = events(spark, [{"t": 10, "session": "s_1"}, {"t": 20, "session": "s_1", "lead": 4}])
    row = traffic.overview(derive_sessions(ev), ev, DAY).first()
    assert (row.events, row.events_change_pct, row.events_direction) == (2, 0.0, "stable")
    assert row.conversion_rate == 100.0


def test_trend_threshold_and_missing_event(spark):
    before = [{"t": -3600 - n, "name": "a"} for n in range(20)]
    now = [{"t": n, "name": "a"} for n in range(21)] + [{"t": 50, "name": "new"}]
    found = {r.event_name: r for r in traffic.top_events_trend(events(spark, before + now), DAY).collect()}
    assert (found["a"].change_pct, found["a"].direction) == (5.0, "up")
    assert (found["new"].change_pct, found["new"].direction) == (0.0, "stable")


def test_details_filter_page_and_segments(spark):
    ev = events(spark, [{"t": n, "name": "x" if n % 2 else "y", "device": "mobile" if n < 5 else "desktop", "source": "g",
                         "lead": 1 if n > 7 else None} for n in range(10)] + [{"t": -90000, "who": "a_1"}])
    details = traffic.event_details(ev, DAY, event_name="x")
    assert details.count() == 5
    assert [r.id for r in traffic.page_of(details, 2, 2).collect()] == [5, 3]
    assert traffic.event_details(ev, DAY, has_lead=True).count() == 2
    assert traffic.segment_filters(ev, device_types=["mobile"], utm_sources=["g"]).count() == 5
    assert traffic.segment_filters(ev, user_type="new", period=DAY).count() == 0
    assert traffic.segment_filters(ev, user_type="returning", period=DAY).count() == 10
    with pytest.raises(ValueError):
        traffic.timeseries(ev, DAY, metrics=("nothing",))


def test_sampling_takes_whole_users(spark):
    ev = events(spark, [{"t": n, "who": f"a_{n % 50}"} for n in range(500)])
    kept = traffic.sample_users(ev, 0.5).groupBy("anonymous_id").count().collect()
    assert 10 <= len(kept) <= 40 and all(r["count"] == 10 for r in kept)


# --------------------------------------------------------------------- ingest
PAYLOAD = ("id bigint, tenant_id bigint, batch_id bigint, event_id string, event_name string, timestamp string, "
           "anonymous_id string, session_id string, device string, geo string, payload string, ingested_at timestamp")


def payload(spark, **over):
    base = dict(id=1, tenant_id=1, batch_id=1, event_id="e", event_name="view", timestamp="2024-01-01 00:00:00",
                anonymous_id="a_1", session_id="s_1", device="{}", geo=None, payload="{}", ingested_at=BASE)
    return spark.createDataFrame([tuple({**base, **over}.values())], PAYLOAD)


@pytest.mark.parametrize("over, errors", [
    ({}, []), ({"event_name": "n" * 100}, []), ({"event_name": "n" * 101}, ["event_name"]), ({"event_name": ""}, ["event_name"]),
    ({"anonymous_id": "b_1"}, ["anonymous_id"]), ({"anonymous_id": None}, ["anonymous_id"]), ({"session_id": None}, []),
    ({"session_id": "s-1"}, ["session_id"]), ({"event_id": "e" * 101}, ["event_id"]), ({"timestamp": "yesterday"}, ["timestamp"]),
    ({"payload": "x" * 262144}, []), ({"payload": "x" * 262145}, ["payload_size"]), ({"device": "[]"}, ["device"])])
def test_validation(spark, over, errors):
    assert ingest.validate_events(payload(spark, **over)).first().errors == errors


@pytest.mark.parametrize("seconds, error", [(300, None), (-300, None), (301, "in_future"), (-301, "too_old")])
def test_time_limit(spark, seconds, error):
    ev = events(spark, [{"t": seconds, "ingested": BASE}])
    assert ingest.validate_timestamp(ev).first().timestamp_error == error


def test_batch_limit(spark):
    df = spark.range(101).select((F.col("id") / 51).cast("int").alias("batch_id"))
    assert rows(ingest.validate_batches(df)) == [(0, 51)]


def test_dedup(spark):
    ev = events(spark, [
        {"event_id": "x", "ingested": at(5)}, {"event_id": "x", "ingested": at(1)}, {"event_id": "x", "tenant": 2},
        {"event_id": None}, {"event_id": None}])
    assert rows(ingest.dedup_events(ev), "id") == [(1,), (2,), (3,), (4,)]
    assert rows(ingest.mark_duplicates(ev).where("is_duplicate"), "id") == [(0,)]


def test_page_path(spark):
    found = spark.createDataFrame([(None, "https://h.example/a/b?q=1"), ("/own", "x"), (None, "ht tp://bad url")], "p string, u string")
    assert [r[0] for r in found.select(ingest.page_path(F.col("p"), F.col("u"))).collect()] == ["/a/b", "/own", None]


# ------------------------------------------------------------------- identity
def test_leads(spark):
    made = [(1, "a_1", 0, "A@x.io ", "11-22"), (2, "a_2", 1, " a@X.io", None), (3, "a_3", 2, None, "1122"),
            (4, "a_4", 3, None, "99"), (5, "a_5", 4, None, "(9)9"), (6, "a_6", 5, None, None), (7, "a_7", 6, None, None),
            (8, "a_1", 7, "a@x.io", "33")]
    ids = spark.createDataFrame([(i, 1, 1, w, at(t), e, p) for i, w, t, e, p in made],
                                "id bigint, tenant_id bigint, workspace_id bigint, anonymous_id string, timestamp timestamp, "
                                "email string, phone string")
    marked = identity.with_fingerprints(ids, b"k1", b"k2")
    lead = {r.id: r.lead_key for r in identity.resolve_identifies(marked).collect()}
    assert lead[1] == lead[2] == lead[8] and lead[1].startswith("e:")
    assert lead[4] == lead[5] and lead[4].startswith("p:")
    assert lead[6] != lead[7]
    assert lead[3] != lead[1]  # the e-mail lead holds phone 33 after the batch, no longer 1122
    leads = identity.resolve_leads(identity.resolve_identifies(marked))
    assert leads.count() == 5
    links = identity.identity_links(identity.resolve_identifies(marked))
    assert links.where("anonymous_id = 'a_1'").first().last_at == at(7)


def test_hmac_matches_the_standard(spark):
    import hashlib
    import hmac

    from trailmark.functions.columns import hmac_sha256

    for key in (b"short", b"long" * 40):
        assert one(spark, hmac_sha256(F.lit("text"), key)) == hmac.new(key, b"text", hashlib.sha256).hexdigest()


def test_encryption_is_bound_to_kind_and_version(spark):
    key = F.lit(bytearray(b"0" * 32))
    df = spark.createDataFrame([("a@b.c",), ("a@b.c",)], "email string").select(
        identity.encrypt(F.col("email"), key, "email", 1).alias("e")).cache()
    first, second = (r.e for r in df.collect())
    assert first != second  # random iv
    assert df.select(identity.decrypt(F.col("e"), key, "email", 1)).first()[0] == "a@b.c"
    with pytest.raises(Exception):
        df.select(identity.decrypt(F.col("e"), key, "email", 2)).collect()


# --------------------------------------------------------------------- funnel
def definitions(spark, steps, state="published", archived=None, window=7):
    """`steps`: (order, type, [(kind, rules)]) of one funnel with id 1."""
    step_rows = [(n, 1, order, kind, f"Step {order}") for n, (order, kind, _) in enumerate(steps)]
    matches = [(n * 10 + k, n, rule, json.dumps(body)) for n, (_, _, rules) in enumerate(steps)
               for k, (rule, body) in enumerate(rules)]
    return Definitions.from_rows(spark, [(1, 1, 1, "F", BASE, archived)], [(1, 1, 1, state, BASE)],
                                 [(1, 1, 1, BASE, window)], step_rows, matches)


RULES = [
    (0, "start", [("page", {"url_match": {"type": "exact", "value": "https://h/x"}})]),
    (1, "page", [("page_url", {"pattern": "*/product/?"}), ("page_title", {"pattern": "offer"})]),
    (2, "event", [("event", {"event_name": "button", "prop_filters": [{"key": "text", "operator": "eq", "value": "Add"}]})]),
    (3, "event", [("utm_source", {"source": "mail"}), ("custom_property", {"property": "plan", "value": "pro"})]),
    (4, "conversion", [("event_name", {"event_name": "purchase"})]),
]
HITS = [
    ({"url": "https://h/x"}, 0), ({"url": "https://h/x/"}, None), ({"url": "https://h/Product/7"}, 1), ({"title": "Big OFFER"}, 1),
    ({"name": "button", "props": '{"text": "Add"}'}, 2), ({"name": "button", "props": '{"text": "No"}'}, None),
    ({"source": "mail"}, 3), ({"props": '{"plan": "pro"}'}, 3), ({"name": "purchase"}, 4), ({"name": "purchase", "source": "mail"}, 3),
    ({"name": "other"}, None), ({"name": "purchase", "ws": 2}, None),
]


def test_rules(spark):
    ev = events(spark, [row for row, _ in HITS])
    found = {r.id: r.step_order for r in match_funnel_events(ev, definitions(spark, RULES)).collect()}
    assert found == {n: step for n, (_, step) in enumerate(HITS) if step is not None}


def test_rules_compare_json_values_and_bad_rules_match_nothing(spark):
    typed = [(0, "start", [("custom_property", {"property": "flag", "value": True})]),
             (1, "event", [("custom_property", {"property": "n", "value": 1}), ("custom_property", {"property": "a.b", "value": "x"})]),
             (2, "event", [("event", {"prop_filters": [{"key": "k", "operator": "in", "value": ["a", 2]}]})]),
             (3, "event", [("event", {"prop_filters": [{"key": "k", "operator": "like", "value": "z"}]}), ("event_name", {}), ("other", {"x": 1})]),
             (4, "conversion", [("event_name", {"event_name": "purchase"})])]
    cases = [('{"flag": true}', 0), ('{"flag": "true"}', None), ('{"n": 1}', 1), ('{"n": 1.0}', 1), ('{"n": "1"}', None), ('{"a.b": "x"}', 1),
             ('{"a": {"b": "x"}}', None), ('{"k": "a"}', 2), ('{"k": 2}', 2), ('{"k": "2"}', None), ('{"k": "z"}', None), ("not json", None), (None, None)]
    defs = definitions(spark, typed)
    found = {r.id: r.step_order for r in match_funnel_events(events(spark, [{"props": p} for p, _ in cases]), defs).collect()}
    assert found == {n: step for n, (_, step) in enumerate(cases) if step is not None}
    broken = Definitions.from_rows(spark, [(1, 1, 1, "F", BASE, None)], [(1, 1, 1, "published", BASE)], [(1, 1, 1, BASE, 7)],
                                   [(1, 1, 0, "start", "S")], [(1, 1, "event_name", "{")])
    assert match_funnel_events(events(spark, [{"name": "view"}]), broken).count() == 0
    assert [r.violation for r in bad_rules(broken.load()).collect()] == ["malformed_rule"]
    assert sorted(r.violation for r in bad_rules(defs.load()).collect()) == ["incomplete_rule", "unknown_kind", "unknown_operator"]


def test_workspaces_outside_the_comparable_number(spark):
    st = spark.createDataFrame([(1, ws, f, f"a{u}", 0, 2, BASE, None) for ws, n in ((1, 1), (2, 5), (3, 6)) for f in range(n) for u in range(3)],
                               "tenant_id bigint, workspace_id bigint, funnel_id bigint, anonymous_id string, current_step_index int, "
                               "total_steps int, entered_at timestamp, completed_at timestamp")
    compared = comparison.funnel_compare(st, DAY)
    assert {(r.workspace_id, r.compared, r.status) for r in compared.collect()} == {(1, 1, "too_few"), (2, 5, "ok"), (3, 6, "too_many")}
    assert {(r.workspace_id, r["count"]) for r in comparison.compare_pairwise(compared).groupBy("workspace_id").count().collect()} == {(2, 10)}


def test_fifty_touches_are_all_credited(spark):
    ev = events(spark, [{"who": "a", "t": n * 60, "source": "s0" if n == 0 else "s49" if n == 49 else "mid"} for n in range(50)])
    touches = attribution.journey_touches(attribution.touchpoints(ev, DAY), DAY)
    by_source = {r.utm_source: r for r in attribution.credits(touches).groupBy("utm_source").agg(
        F.sum("last_touch").alias("last"), F.sum("linear").alias("linear")).collect()}
    assert by_source["s49"].last == 1 and by_source["mid"].linear == pytest.approx(48 / 50)


def test_quiet_workspaces_have_zero_series(spark):
    scopes = spark.createDataFrame([(1, 1), (1, 9)], "tenant_id bigint, workspace_id bigint")
    rows_ = traffic.timeseries(events(spark, [{"t": 60}]), DAY, "hour", scopes=scopes).where("workspace_id = 9")
    assert rows_.count() >= 24 and rows_.agg(F.sum("events")).first()[0] == 0


def test_drafts_and_archived_funnels_match_nothing(spark):
    ev = events(spark, [{"name": "purchase"}])
    assert match_funnel_events(ev, definitions(spark, RULES, state="draft")).count() == 0
    assert match_funnel_events(ev, definitions(spark, RULES, archived=BASE)).count() == 0


def test_definition_checks(spark):
    steps = spark.createDataFrame(
        [(1, 0, "start"), (1, 1, "conversion"), (2, 0, "start"), (2, 0, "page"), (2, 3, "page"), (3, 1, "conversion")],
        "funnel_version_id bigint, order_index int, type string")
    assert rows(validate_funnel_defs(steps)) == [
        (2, "duplicate_order"), (2, "no_conversion_step"), (2, "order_not_consecutive"), (3, "no_start_step"),
        (3, "order_not_consecutive")]
    found = funnel_inventory(definitions(spark, RULES, archived=BASE)).first()
    assert (found.total_funnels, found.archived_funnels) == (0, 1)


SIMPLE = [(n, kind, [("event_name", {"event_name": name})]) for n, (kind, name) in enumerate(
    [("start", "a"), ("page", "b"), ("event", "c"), ("conversion", "d")])]


def simple_state(spark, made, window=7):
    return match_funnel_events(events(spark, made), definitions(spark, SIMPLE, window=window))


def test_state_edges(spark):
    m = simple_state(spark, [
        {"t": 10, "name": "c", "who": "a_mid"}, {"t": 0, "name": "a", "who": "a_jump"}, {"t": 5, "name": "d", "who": "a_jump"},
        {"t": 9, "name": "a", "who": "a_jump"}, {"t": 50, "name": "d", "who": "a_first"}, {"t": 20, "name": "a", "who": "a_first"}])
    found = {r.anonymous_id: r for r in state.funnel_user_state(m).collect()}
    assert (found["a_mid"].current_step_index, found["a_mid"].status) == (2, "active")
    assert found["a_jump"].current_step_index == 3
    assert found["a_jump"].completed_at == at(9)  # moves with later matched events
    assert found["a_first"].entered_at == at(20) and found["a_first"].conversion_time_seconds == 30.0
    steps = [(r.step_order, r.is_entry, r.is_advance, r.is_conversion)
             for r in state.progression_events(m).where("anonymous_id = 'a_jump'").orderBy("timestamp").collect()]
    assert steps == [(0, True, True, False), (3, False, True, True)]


def test_abandonment_and_strict_order(spark):
    m = simple_state(spark, [
        {"t": 0, "name": "a", "who": "a_1"}, {"t": 5, "name": "c", "who": "a_1"}, {"t": 6, "name": "b", "who": "a_1"},
        {"t": 7, "name": "c", "who": "a_1"}, {"t": 8, "name": "d", "who": "a_1"},
        {"t": 0, "name": "a", "who": "a_2"}, {"t": 86400, "name": "b", "who": "a_2"}, {"t": 86401, "name": "c", "who": "a_2"}],
        window=1)
    reached = {r.anonymous_id: (r.step_reached, r.completed) for r in state.strict_funnel(m, definitions(spark, SIMPLE)).collect()}
    assert reached == {"a_1": (3, True), "a_2": (1, False)}
    st = state.funnel_user_state(m)
    for seconds, status in ((86401 + 86400, "active"), (86401 + 86401, "abandoned")):
        found = {r.anonymous_id: r.status for r in state.abandon_users(st, str(at(seconds))).collect()}
        assert found == {"a_1": "completed", "a_2": status}


def test_dropoff_of_exactly_half_is_no_bottleneck(spark):
    made = [{"t": n, "name": "a", "who": f"a_{n}"} for n in range(4)] + [{"t": 100 + n, "name": "b", "who": f"a_{n}"} for n in range(2)]
    m = simple_state(spark, made)
    defs = definitions(spark, SIMPLE)
    st, steps = state.funnel_user_state(m), defs.steps_of_latest()
    table = {r.step_order: r for r in conversion.conversion_steps(st, steps, MONTH).collect()}
    assert (table[2].drop_off_rate, table[2].is_bottleneck, table[2].bottleneck_severity) == (50.0, False, "medium")
    assert [table[k].users for k in (1, 2, 3, 4)] == [4, 2, 0, 0]
    exits = {r.step_order: r for r in dropoff.dropoff_steps(st, steps, MONTH).collect()}
    assert (exits[0].exits, exits[0].exit_velocity, exits[0].drop_off_severity) == (2, "immediate", "high")
    assert dropoff.dropoff_recommendations(st.where("false"), steps, MONTH).first().type == "timing"


# ------------------------------------------------------- journeys, attribution
def touches(spark, counts):
    made = [{"t": 10 * k + 1000 * n, "who": f"a_{n}", "source": f"s{k % 3}"} for n, c in enumerate(counts) for k in range(c)]
    return attribution.touchpoints(events(spark, made), MONTH)


def test_credit_sums(spark):
    found = attribution.journey_touches(touches(spark, [1, 2, 3, 20, 21]), MONTH)
    assert {r.anonymous_id: r.touches for r in found.collect()} == {"a_0": 1, "a_1": 2, "a_2": 3, "a_3": 20, "a_4": 21}
    for journey in attribution.credits(found).groupBy("anonymous_id").agg(
            *[F.sum(m).alias(m) for m in attribution.MODELS]).collect():
        assert [journey[m] for m in attribution.MODELS] == pytest.approx([1.0] * 6)
    two = attribution.credits(found.where("touches = 2").withColumn("converted", F.lit(True)))
    sums = two.agg(F.sum("position_based"), F.sum("custom"), F.sum("linear")).first()
    assert tuple(sums) == pytest.approx((0.8, 0.8, 1.0))  # the middle share is lost
    with pytest.raises(ValueError):
        attribution.credits(found, custom=(0.9, 0.9, 0.1))


def test_real_conversions_replace_the_touch_rule(spark):
    found = touches(spark, [1, 5])
    done = spark.createDataFrame([(1, 1, "a_0")], "tenant_id bigint, workspace_id bigint, anonymous_id string")
    credited = attribution.credits(attribution.journey_touches(found, MONTH, done))
    assert rows(credited, "anonymous_id", "linear") == [("a_0", 1.0)]


def test_channels(spark):
    made = [{"source": "x", "referrer": "https://www.google.com/"}, {"referrer": "https://www.google.com/q"}, {"url": "u"},
            {"referrer": "https://social.io/p"}, {"referrer": "http://blog.io/z?y"}]
    found = attribution.touchpoints(events(spark, made), MONTH).orderBy("id").collect()
    assert [r.touchpoint_type for r in found] == ["paid_search", "organic_search", "direct", "social", "referral"]
    assert found[4].referrer_domain == "blog.io"


def test_long_journeys_are_whole(spark):
    """500 steps over several hours and two visitors of one person, and the same path taken by twelve others."""
    name = lambda n: f"s{n * n % 7}"
    ev = events(spark, [{"t": n * 40, "who": f"a_{n % 2}", "lead": 7, "name": name(n)} for n in range(500)] + [{"t": 3, "who": "a_x"}]
                + [{"t": 50 * n + k, "who": f"b_{k}", "name": name(n)} for n in range(60) for k in range(12)])
    steps = journeys.journey_steps(ev, MONTH).cache()
    mine = [r for r in steps.where("user_id = '7'").orderBy("step_order").collect()]
    assert [r.step_order for r in mine] == list(range(1, 501)) and [r.position for r in mine] == [n // 2 + 1 for n in range(500)]
    assert [r.time_spent_seconds for r in mine] == [40.0] * 499 + [60.0]
    assert [r.from_step for r in mine] == [None, None] + [name(n - 2) for n in range(2, 500)]
    found = journeys.user_journeys(steps, 3)
    whole = {r.anonymous_id: r for r in found.collect()}
    assert "a_x" not in whole and whole["a_1"].total_events == 250 and whole["a_1"].converted and whole["a_1"].last_order == 500
    assert whole["b_0"].pattern == "event:s0 -> event:s1 -> event:s4 -> (60 steps)" and whole["a_0"].pattern != whole["b_0"].pattern
    assert len({whole[f"b_{k}"].path for k in range(12)}) == 1 and len({r.path for r in whole.values()}) == 3
    path = journeys.path_groups(found).collect()
    assert [(r.users, r.path_steps, r.conversion_rate) for r in path] == [(12, 60, 100.0)]
    by_step = journeys.path_steps(found, steps).orderBy("step_order").collect()
    assert [r.step_identifier for r in by_step] == [name(n) for n in range(60)] and by_step[-1].alternative_exits == 12
    assert journeys.path_transitions(steps).agg(F.sum("moves")).first()[0] == 12 * 59 + 2 * 249


# ------------------------------------------------------------------ statistics
def series(spark, values):
    return spark.createDataFrame([(1, 1, 1, at(3600 * n), float(v), 5) for n, v in enumerate(values)],
                                 "tenant_id bigint, workspace_id bigint, funnel_id bigint, period_start timestamp, "
                                 "conversion_rate double, entries bigint")


def test_control_chart_runs(spark):
    flat = [10.0] * 60
    assert anomalies.spc_anomalies(series(spark, flat)).count() == 0
    spike = flat[:30] + [90.0] + flat[30:]
    assert anomalies.spc_anomalies(series(spark, spike)).count() == 0  # a run of one
    run = flat[:30] + [90.0, 95.0] + flat[30:]
    found = anomalies.spc_anomalies(series(spark, run)).collect()
    assert [(r.type, r.duration_hours, r.affected_users) for r in found] == [("spike", 1.0, 10)]
    assert anomalies.spc_anomalies(series(spark, flat + [90.0, 95.0])).count() == 0  # not closed
    assert anomalies.spc_anomalies(series(spark, run[20:43])).count() == 0  # under 24 points


def test_trends(spark):
    falling = anomalies.trend_anomalies(series(spark, [100 - n for n in range(24)])).collect()
    assert {r.type for r in falling} == {"gradual_decline"} and len(falling) == 18
    assert anomalies.trend_analysis(series(spark, [50 + n / 100 for n in range(10)])).first().overall_direction == "improving"
    assert anomalies.trend_analysis(series(spark, [5.0] * 6)).first().overall_direction == "stable"


def window_rows(spark, entries, conversion_rate, seconds):
    return spark.createDataFrame([(1, 1, 1, 0, "S", entries, float(conversion_rate), float(seconds))],
                                 "tenant_id bigint, workspace_id bigint, funnel_id bigint, step_order bigint, step_label string, "
                                 "total_entries bigint, conversion_rate double, avg_completion_seconds double")


def test_bottlenecks(spark):
    compared = anomalies.compare_windows(window_rows(spark, 1000, 40, 100), window_rows(spark, 1000, 80, 50))
    found = {r.detection_type: r for r in anomalies.bottlenecks(compared).collect()}
    assert found["conversion_drop"].severity == "high"  # 50 * log10(1000) = 150 exactly
    assert found["conversion_drop"].lost_conversions == 500.0
    assert found["time_stuck"].severity == "critical"
    assert anomalies.bottleneck_recommendations(anomalies.bottlenecks(compared), anomalies.trend_anomalies(
        series(spark, [1.0] * 24))).count() == 2
    same = anomalies.compare_windows(window_rows(spark, 0, 0, 0), window_rows(spark, 0, 0, 0))
    assert anomalies.bottlenecks(same, "high").count() == 0


def compared_rows(spark, rows_):
    made = []
    for n, (entries, conversions) in enumerate(rows_, 1):
        made.append((1, 1, n, entries, conversions, 100.0 * conversions / entries if entries else 0.0, 60.0 * n, n, 0.0, 70.0, len(rows_),
                     "too_few" if len(rows_) < 2 else "too_many" if len(rows_) > 5 else "ok"))
    return spark.createDataFrame(made, "tenant_id bigint, workspace_id bigint, funnel_id bigint, entries bigint, conversions bigint, "
                                       "conversion_rate double, avg_seconds double, volume_rank bigint, quality_score double, "
                                       "engagement_score double, compared bigint, status string")


def test_comparison(spark):
    two = compared_rows(spark, [(1000, 100), (1000, 150)])
    test = comparison.compare_pairwise(two).first()
    assert test.z_score == pytest.approx(3.3806, abs=1e-3) and test.is_significant
    assert (test.rate_lift, test.recommendation) == (pytest.approx(50.0), "implement_winner")
    chi = comparison.compare_chi_square(two).first()
    assert chi.chi_square == pytest.approx(2 * 25**2 / 125)  # over conversions only
    assert chi.p_value == pytest.approx(0.0015654, abs=1e-6)
    assert comparison.ab_test(comparison.with_baseline(two)).first().winner == 2
    equal = comparison.compare_pairwise(compared_rows(spark, [(50, 0), (50, 0)])).first()
    assert equal.z_score is None and not equal.is_significant
    five = compared_rows(spark, [(100, 10 * n) for n in range(1, 6)])
    assert comparison.compare_pairwise(five).count() == 10
    chi = comparison.compare_chi_square(five).first()
    x = chi.chi_square / 2
    assert chi.p_value == pytest.approx(math.exp(-x) * (1 + x), rel=1e-9)
    four = comparison.compare_chi_square(compared_rows(spark, [(100, 10), (100, 20), (100, 15), (100, 12)])).first()
    x = four.chi_square
    tail = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    assert four.p_value == pytest.approx(tail, abs=1e-6)
    assert comparison.compare_bh(comparison.compare_pairwise(five)).agg(F.max("rank")).first()[0] == 10


def test_live_alert_bounds(spark):
    def anomaly(change):
        return spark.createDataFrame([(1, 1, 1, 50.0, 100.0, change, 9, 9)],
                                     "tenant_id bigint, workspace_id bigint, funnel_id bigint, current_rate double, "
                                     "historical_rate double, rate_change_pct double, current_entries bigint, historical_entries bigint")

    stuck = spark.createDataFrame([(1, 1, 1, 0, 20, 1.0, 1.0), (1, 1, 1, 1, 21, 1.0, 1.0)],
                                  "tenant_id bigint, workspace_id bigint, funnel_id bigint, step_order bigint, users_stuck bigint, "
                                  "avg_idle_seconds double, max_idle_seconds double")
    severities = lambda change: [r.severity for r in live.live_alerts(anomaly(change), stuck).collect()]
    assert severities(-20.0) == ["medium", "high"]
    assert severities(-50.0) == ["high", "medium", "high"]
    assert severities(-51.0) == ["critical", "medium", "high"]


# ---------------------------------------------------------------------- stores
def test_event_store_round_trip(spark, tmp_path):
    ev = events(spark, [{"t": 86400 * n, "who": f"a_{n}"} for n in range(5)])
    write_events(ev, str(tmp_path / "store"))
    found = read_events(spark, str(tmp_path / "store"), Period(at(86400), at(3 * 86400)))
    assert rows(found, "id") == [(1,), (2,), (3,)]


def test_exports(spark, inputs, tmp_path):
    from trailmark.sources.exports import csv_rows, export_dataset

    steps = conversion.conversion_steps(inputs.state, inputs.steps, MONTH)
    export_dataset(csv_rows(steps, inputs.defs.funnels, MONTH), str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns[0] == "Funnel Name" and back.count() == inputs.steps.count()
    export_dataset(inputs.events, str(tmp_path / "json"), "json", anonymize=True)
    assert spark.read.json(str(tmp_path / "json")).where("anonymous_id like 'hash_%***'").count() == 1000
    with pytest.raises(ValueError):
        export_dataset(inputs.events, str(tmp_path / "x"), "xlsx")


def test_empty_inputs(spark, inputs):
    none = inputs.events.where("false")
    st = state.funnel_user_state(match_funnel_events(none, inputs.defs))
    assert st.count() == 0
    assert traffic.overview_counts(none, DAY).count() == 0
    assert conversion.conversion_steps(st, inputs.steps, DAY).agg(F.sum("users")).first()[0] == 0
    assert journeys.user_journeys(journeys.journey_steps(none, DAY), 5).count() == 0
    assert live.live_basic(st, inputs.steps, str(BASE)).where("active_users = 0").count() == 9


def test_whole_progression(spark):
    m = simple_state(spark, made := [
        {"t": 0, "name": "a", "who": "a_gone"}, {"t": 60, "name": "x", "who": "a_gone"}, {"t": 100, "name": "b", "who": "a_gone"},
        {"t": 7 * 86400, "name": "a", "who": "a_new"}, {"t": 7 * 86400 + 50, "name": "c", "who": "a_new"},
        {"t": 7 * 86400, "name": "d", "who": "a_done"}, {"t": 9 * 86400, "name": "x", "who": "a_new"}])
    now, steps = str(at(8 * 86400)), definitions(spark, SIMPLE).steps_of_latest()
    st = state.abandon_users(state.funnel_user_state(m), now)
    found = live.whole_progression(st, steps, events(spark, made), now).collect()
    of = lambda part, who: sorted((r for r in found if (r.part, r.anonymous_id) == (part, who)), key=lambda r: r.step_order)
    status = {r.anonymous_id: (r.conversion_status, r.step_label) for r in found if r.part == "progression"}
    label = {r.order_index: r.step_label for r in steps.collect()}
    assert status == {"a_gone": ("abandoned", label[1]), "a_new": ("in_progress", label[2]), "a_done": ("converted", label[3])}
    # every step that users stand on, also those that this one did not reach
    assert [(r.step_order, r.user_seconds, r.performance, r.percentile) for r in of("step_timing", "a_gone")] == [
        (1, 100, "average", 50), (2, None, "average", None), (3, None, "average", None)]
    assert [r.step_order for r in of("step_timing", "a_done")] == [1, 2, 3]
    # every event since the entry up to the instant, whether it is of a step or not
    assert [(r.step_order, r.step_label, r.event_name, r.time_from_start, r.time_from_previous) for r in of("journey_history", "a_gone")] == [
        (1, label[1], "a", 0, 0), (2, label[2], "x", 60, 60), (3, label[3], "b", 100, 40)]
    assert [r.event_name for r in of("journey_history", "a_new")] == ["a", "c"]
    assert len(found) == 3 + 9 + 6


def test_registered_progression_is_whole(spark, tmp_path):
    from trailmark.plans.registry import load_all

    raw = [(n, at(t), 1, name, 1.0, '{"k": 1}') for n, (t, name) in enumerate([(0, "view"), (30, "click"), (40, "view")])]
    spark.createDataFrame(raw, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").select(
        "event_id", F.col("ts").cast("timestamp_ntz"), "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    found = load_all()["user_progression"](spark, str(tmp_path)).collect()
    assert {r.conversion_status for r in found if r.part == "progression"} == {"abandoned"}
    assert {r.part for r in found} == {"progression", "step_timing", "journey_history"}

"""Indexed matching against a plain evaluation of every rule on every event."""

from __future__ import annotations

import json
import random
import re

import pytest
from helpers import BASE, events

from trailmark.operators.matching import match_funnel_events, rule_index
from trailmark.sources.definitions import Definitions

NAMES, SOURCES = [f"name{k}" for k in range(40)], ["google", "mail", "Mail", None]
URLS = [None, "https://x.com/", "https://x.com/View?a=1", "https://x.com/view/7", "https://y.org/Cart", "https://x.com/a+b", "line\nbreak/view"]
TITLES = [None, "Home", "the CART page", "100% (sale)", "Éclair ΣΑΣ"]
VALUES = [1, 1.0, 1.5, "1", "a", "A", "", True, None, 20, "20", "pro plan"]
KEYS = ["k", "plan", "a.b", "k x"]


def draw_rule(draw: random.Random) -> tuple[str, dict]:
    kind = draw.choice(["event_name", "page_url", "page_title", "utm_source", "custom_property", "page", "event", "odd"])
    if kind == "event_name":
        return kind, {"event_name": draw.choice([*NAMES, "other", None])}
    if kind in ("page_url", "page_title"):
        return kind, {"pattern": draw.choice(["*x.com/v*", "/view", "*?art*", "?a=", "a+b", "zzz", "*", "SALE)", "éclair", "σας", "nothing*", "*VIEW*", "ΣΑΣ*", None])}
    if kind == "utm_source":
        return kind, {"source": draw.choice(["google", "mail", "none"])}
    if kind == "custom_property":
        return kind, {"property": draw.choice(KEYS), "value": draw.choice(VALUES)}
    if kind == "odd":
        return kind, {"event_name": "name1"}
    body = {}
    if draw.random() < 0.5:
        body["event_name"] = draw.choice(NAMES)
    if draw.random() < 0.4:
        body["url_match"] = {"type": draw.choice(["exact", "contains"]), "value": draw.choice(["https://x.com/", "/view", "?a=", "Cart", None])}
    if draw.random() < 0.5:
        body["prop_filters"] = [{"key": draw.choice(KEYS), "operator": draw.choice(["eq", "contains", "starts_with", "in", "greater_than", "less_than", None, "odd"]),
                                 "value": draw.choice([*VALUES, [1, "a"], 5])} for _ in range(draw.randint(0, 2))]
    return kind, body


def number(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if number(a) is not None and number(b) is not None:
        return number(a) == number(b)
    return type(a) is type(b) and a == b


def text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x)


def to_number(x) -> float | None:
    try:
        return float(x) if x is not None and not isinstance(x, bool) else None
    except ValueError:
        return None


def condition(f: dict, props: dict) -> bool:
    if f["key"] not in props:
        return False
    actual, wanted, operator = props[f["key"]], f["value"], f["operator"] or "eq"
    if operator in ("eq", "equals"):
        return same(actual, wanted)
    if operator == "in":
        return isinstance(wanted, list) and any(same(actual, x) for x in wanted)
    if isinstance(wanted, list) or actual is None:
        return False
    if operator == "contains":
        return text(wanted if wanted is not None else "null") in text(actual)
    if operator == "starts_with":
        return text(actual).startswith(text(wanted if wanted is not None else "null"))
    a, b = to_number(actual), to_number(wanted)
    return a is not None and b is not None and {"greater_than": a > b, "less_than": a < b}.get(operator, False)


def holds(kind: str, body: dict, e: dict) -> bool:
    props = json.loads(e["props"]) if e.get("props") else {}
    if kind == "event_name":
        return body["event_name"] == e["name"]
    if kind in ("page_url", "page_title"):
        value, pattern = e.get("url" if kind == "page_url" else "title"), body["pattern"]
        if value is None or pattern is None:
            return False
        if "*" not in pattern:
            return pattern.lower() in value.lower()
        return re.match(re.sub(r"\\\?", ".", re.sub(r"\\\*", ".*", re.escape(pattern))) + r"\Z", value, re.I | re.S | re.A) is not None
    if kind == "utm_source":
        return e.get("source") is not None and body["source"] == e["source"]
    if kind == "custom_property":
        return body["property"] in props and same(props[body["property"]], body["value"])
    if kind not in ("page", "event") or not body:
        return False
    match, url = body.get("url_match"), e.get("url")
    if match and (match["value"] is None or url is None or not (url == match["value"] if match["type"] == "exact" else match["value"] in url)):
        return False
    return body.get("event_name") in (None, e["name"]) and all(condition(f, props) for f in body.get("prop_filters") or [])


def built(spark, rules: dict[int, list[tuple[int, int, str, dict]]]) -> Definitions:
    """rules: workspace -> (funnel, order, kind, body)."""
    funnels, versions, publications, steps, matches = [], [], [], {}, []
    for ws, rows in rules.items():
        for funnel in {r[0] for r in rows}:
            funnels.append((funnel, 1, ws, f"f{funnel}", BASE, None))
            versions.append((funnel, funnel, 1, "published", BASE))
            publications.append((funnel, funnel, 1, BASE, 7))
        for funnel, order, kind, body in rows:
            steps[funnel * 100 + order] = (funnel * 100 + order, funnel, order, "event", "x")
            matches.append((len(matches), funnel * 100 + order, kind, json.dumps(body)))
    return Definitions.from_rows(spark, funnels, versions, publications, list(steps.values()), matches)


@pytest.mark.parametrize("seed", [1, 2])
def test_index_finds_what_every_rule_finds(spark, seed):
    draw = random.Random(seed)
    rules = {1: [(f, draw.randint(0, 6), *draw_rule(draw)) for f in range(1, 101) for _ in range(10)],
             2: [(f, draw.randint(0, 3), *draw_rule(draw)) for f in range(200, 206) for _ in range(4)],
             3: [(300, 0, "custom_property", {"property": "k", "value": 1})], 4: [(400, 0, "event", {"prop_filters": []})]}
    made = [{"id": k, "ws": draw.choice([1, 2, 3, 4, 5]), "name": draw.choice(NAMES), "url": draw.choice(URLS), "title": draw.choice(TITLES),
             "source": draw.choice(SOURCES), "props": draw.choice([None, "{}", "not json", *[json.dumps({x: draw.choice(VALUES) for x in draw.sample(KEYS, 2)})] * 4])}
            for k in range(300)]
    for e in made:
        if e["props"] == "not json":
            e["plain"] = None
    want = set()
    for e in made:
        seen = {**e, "props": e.get("plain", e["props"])}
        for funnel in {r[0] for r in rules.get(e["ws"], [])}:
            orders = [o for f, o, kind, body in rules[e["ws"]] if f == funnel and holds(kind, body, seen)]
            if orders:
                want.add((e["id"], funnel, min(orders)))
    got = match_funnel_events(events(spark, made), built(spark, rules))
    found = [(r.id, r.funnel_id, r.step_order) for r in got.select("id", "funnel_id", "step_order").collect()]
    assert len(found) == len(set(found)) and len(want) > 1000
    assert set(found) == want, (sorted(want - set(found))[:5], sorted(set(found) - want)[:5])


def test_an_event_meets_only_rules_of_its_keys(spark):
    rules = {1: [(k, 0, "event_name", {"event_name": f"name{k}"}) for k in range(1, 1001)]
             + [(2000, 0, "custom_property", {"property": "plan", "value": k}) for k in range(500)]
             + [(2001, 0, "page_url", {"pattern": f"/part{k}"}) for k in range(20)]}
    index = {r["_key"]: r for r in rule_index(built(spark, rules).load().where("kind is not null")).collect()}
    assert len(index) == 1001 and all(len(r["_rules"]) == 1 and r["_rules"][0]["test"] is None for k, r in index.items() if k != "w:")
    assert len(index["w:"]["_named"]) == 500 and len(index["w:"]["_rules"]) == 20 and index["w:"]["_url_lower"].count("|") == 19
    made = events(spark, [{"name": "name7"}, {"name": "none", "props": '{"plan": 7.0}'}, {"name": "x", "url": "http://a/PART3?"}])
    found = match_funnel_events(made, built(spark, rules))
    assert sorted((r.id, r.funnel_id) for r in found.collect()) == [(0, 7), (1, 2000), (2, 2001)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan

"""Funnel definitions the registered queries use: four funnels in each workspace."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import SparkSession

from trailmark.sources.definitions import Definitions

WORKSPACES = (1, 2, 3)
CREATED = datetime(2023, 12, 1)


def _event(name: str) -> tuple[str, dict]:
    return "event", {"event_name": name}


def _page(how: str, value: str) -> tuple[str, dict]:
    return "page", {"url_match": {"type": how, "value": value}}


SIGNUP_STEPS = [
    ("start", "View", _event("view")),
    ("event", "Click", _event("click")),
    ("event", "Signup", _event("signup")),
    ("conversion", "Purchase", _event("purchase")),
]
# number -> (name, version state, steps)
FUNNELS = {
    1: ("Signup to purchase", "published", SIGNUP_STEPS),
    2: ("Pages to purchase", "published", [
        ("start", "View page", _page("contains", "/view")),
        ("page", "Signup page", _page("exact", "https://example.com/signup")),
        ("conversion", "Purchase", _event("purchase")),
    ]),
    3: ("Click to purchase", "published", [
        ("start", "Click page", ("page_url", {"pattern": "*example.com/c*"})),
        ("conversion", "Purchase", ("event_name", {"event_name": "purchase"})),
    ]),
    4: ("Draft", "draft", SIGNUP_STEPS),
}


def fixture_definitions(spark: SparkSession) -> Definitions:
    funnels, versions, publications, steps, matches = [], [], [], [], []
    for number, (name, state, parts) in FUNNELS.items():
        for workspace in WORKSPACES:
            funnel_id = 10 * number + workspace
            funnels.append((funnel_id, 1, workspace, name, CREATED, None))
            versions.append((funnel_id, funnel_id, 1, state, CREATED))
            if state == "published":
                publications.append((funnel_id, funnel_id, 1, CREATED, 7))
            for order, (kind, label, (rule, body)) in enumerate(parts):
                step_id = funnel_id * 10 + order
                steps.append((step_id, funnel_id, order, kind, label))
                matches.append((step_id, step_id, rule, json.dumps(body)))
    return Definitions.from_rows(spark, funnels, versions, publications, steps, matches)

from __future__ import annotations

from datetime import datetime, timedelta

BASE = datetime(2024, 1, 1)
EVENT = """id bigint, event_id string, event_name string, timestamp timestamp, tenant_id bigint, workspace_id bigint,
  anonymous_id string, lead_id bigint, session_id string,
  page struct<url:string,title:string,referrer:string,path:string>,
  utm struct<source:string,medium:string,campaign:string,term:string,content:string>,
  device struct<type:string>, geo struct<country:string>, props string, ingested_at timestamp"""


def at(seconds: float) -> datetime:
    return BASE + timedelta(seconds=seconds)


def events(spark, rows: list[dict]):
    """Canonical events from partial rows; `t` is seconds after the base time."""
    out = []
    for n, r in enumerate(rows):
        t = at(r.get("t", n))
        page = (r.get("url"), r.get("title"), r.get("referrer"), None) if {"url", "title", "referrer"} & r.keys() else None
        utm = (r.get("source"), r.get("medium"), None, None, None) if "source" in r else None
        out.append((r.get("id", n), r.get("event_id"), r.get("name", "view"), t, r.get("tenant", 1), r.get("ws", 1),
                    r.get("who", "a_1"), r.get("lead"), r.get("session"), page, utm,
                    (r["device"],) if "device" in r else None, None, r.get("props"), r.get("ingested", t)))
    return spark.createDataFrame(out, EVENT)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)

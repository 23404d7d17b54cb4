"""Times headline queries: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trailmark.plans.registry import load_all  # noqa: E402
from trailmark.session import build_session  # noqa: E402

HEADLINE = [
    "overview", "top_events_trend", "timeseries", "activity_levels", "user_analytics", "sessionize", "dedup_events",
    "validate_events", "link_leads", "resolve_leads", "match_funnel_events", "funnel_user_state", "conversion_steps",
    "conversion_significance", "segment_conversion", "conversion_timeseries", "bottleneck_severity", "cohorts",
    "cohort_progression", "retention_curve", "timing_distribution", "step_timing", "join_step_transition",
    "velocity_trends", "segment_timing", "live_basic", "user_progression_history", "spc_anomalies", "path_groups",
    "attribution", "compare_pairwise", "ab_test",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        started = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("overview_counts")  # warms the JVM and the file cache
    seconds = {name: min(run(name), run(name)) for name in names}  # the first run also compiles
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "runs": "best of 2",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "events": events,
        "ingest_rows_per_sec": round(events / seconds["validate_events"]) if seconds.get("validate_events") else None}))
    spark.stop()


if __name__ == "__main__":
    main()

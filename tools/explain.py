"""Runs queries and prints the final adaptive plan's shape: python tools/explain.py [--full] name ..."""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trailmark.plans.registry import load_all  # noqa: E402
from trailmark.session import build_session  # noqa: E402

OPERATORS = ("FileScan|Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning|ReusedExchange|"
             "BroadcastExchange|SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|"
             "HashAggregate|ObjectHashAggregate|SortAggregate|Window(?:GroupLimit)?|Generate|Expand|Sort ")


def main() -> None:
    full, names = "--full" in sys.argv, [a for a in sys.argv[1:] if not a.startswith("--")]
    spark = build_session("explain", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    for name in names or list(registry):
        df = registry[name](spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01"))
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        final = text.split("== Initial Plan ==")[0]
        seen = Counter(m.strip() for m in re.findall(OPERATORS, final))
        print(f"{name:28}", dict(seen), flush=True)
        if full:
            print(final)


if __name__ == "__main__":
    main()

"""Run registered queries against their SQL: python tools/check.py [--sf 0.01] [name ...]."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from trailmark.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr)


def kind(value):
    return type(value).__name__


def compare(spark_columns, spark_rows, sql_columns, sql_rows) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns differ: {sorted(set(spark_columns) ^ set(sql_columns))}"
    a, b = rows_of(spark_columns, spark_rows), rows_of(sql_columns, sql_rows)
    if len(a) != len(b):
        return f"rows differ: spark {len(a)}, sql {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(c, p, q) for c, p, q in zip(sorted(spark_columns), x, y) if p != q]
        return f"{len(bad)} of {len(a)} rows differ, first: {diff}\n    spark {x}\n    sql   {y}"
    types = {(c, kind(p), kind(q)) for x, y in zip(a, b) for c, p, q in zip(sorted(spark_columns), x, y)
             if p is not None and kind(p) != kind(q)}
    return f"types differ: {sorted(types)}" if types else None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module", default=None)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                  "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from trailmark.plans.registry import load_all

    registry = load_all()
    names = args.names or [n for n, q in registry.items()
                           if args.module is None or q.plan.__module__.endswith(args.module)]
    db, failed = connect(sf_dir), []
    for name in names:
        started = time.time()
        try:
            df = registry[name](spark, sf_dir)
            rows = df.collect()
            took = time.time() - started
            if registry[name].sql is None:
                print(f"rows  {name:32} {len(rows):7} rows {took:6.2f}s", flush=True)
                continue
            res = db.execute(registry[name].sql)
            columns = [d[0] for d in res.description]
            problem = compare(df.columns, rows, columns, res.fetchall())
        except Exception as error:  # noqa: BLE001
            problem, rows, took = f"{type(error).__name__}: {str(error)[:700]}", [], time.time() - started
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '}  {name:32} {len(rows):7} rows {took:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

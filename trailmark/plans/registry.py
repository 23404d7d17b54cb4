"""The query registry: name -> (Spark plan over the tables, DuckDB SQL over the same tables)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from trailmark.params import Period
from trailmark.operators.matching import match_funnel_events
from trailmark.operators.state import funnel_user_state
from trailmark.plans.fixtures import fixture_definitions
from trailmark.session import prepare
from trailmark.sources.events import canonical_events, derive_sessions

AS_OF = "2024-01-31 00:00:00"
CURRENT = Period.of("2024-01-16 00:00:00", "2024-01-30 23:59:59.999")
WHOLE = Period.of("2024-01-01 00:00:00", "2024-01-30 23:59:59.999")


class Inputs:
    """Lazily built inputs of one query run."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return canonical_events(self.spark, self.sf_dir)

    @cached_property
    def anonymous_events(self) -> DataFrame:
        """Events without the lead, where a query has no use for it."""
        return canonical_events(self.spark, self.sf_dir, leads=False)

    @cached_property
    def sessions(self) -> DataFrame:
        return derive_sessions(self.anonymous_events)

    @cached_property
    def defs(self):
        return fixture_definitions(self.spark)

    @cached_property
    def steps(self) -> DataFrame:
        return self.defs.steps_of_latest()

    @cached_property
    def matched(self) -> DataFrame:
        return match_funnel_events(self.anonymous_events, self.defs)

    @cached_property
    def state(self) -> DataFrame:
        return funnel_user_state(self.matched)

    @cached_property
    def led_state(self) -> DataFrame:
        """Funnel state with leads."""
        return funnel_user_state(match_funnel_events(self.events, self.defs))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Inputs], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Inputs(spark, sf_dir))


MODULES = ("traffic", "conversion", "timing", "journeys", "attribution", "live", "comparison", "events", "identity")
REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, plan, sql)
        return plan

    return register


def load_all() -> dict[str, Query]:
    import importlib

    for module in MODULES:
        importlib.import_module(f"trailmark.plans.{module}")

    return REGISTRY

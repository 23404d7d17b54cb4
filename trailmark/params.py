"""Periods: plain parameters worked out on the driver, no data touched."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SCOPE = ["tenant_id", "workspace_id"]
FUNNEL = [*SCOPE, "funnel_id"]

# Names of relative periods.
PRESET_HOURS = {"24h": 24, "7d": 24 * 7, "30d": 24 * 30}


@dataclass(frozen=True)
class Period:
    """Closed time range [start, end]."""

    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError("a period cannot end before it starts")

    @classmethod
    def of(cls, start: str, end: str) -> Period:
        return cls(datetime.fromisoformat(start), datetime.fromisoformat(end))

    @classmethod
    def preset(cls, name: str, as_of: datetime) -> Period:
        if name not in PRESET_HOURS:
            raise ValueError(f"unknown period {name!r}")
        return cls(as_of - timedelta(hours=PRESET_HOURS[name]), as_of)

    @property
    def length(self) -> timedelta:
        return self.end - self.start

    def previous(self) -> Period:
        """Same length, ending a millisecond before this one starts."""
        end = self.start - timedelta(milliseconds=1)
        return Period(end - self.length, end)

    def previous_days(self) -> Period:
        """Previous range for funnel significance: ends the day before, both ends cut to midnight."""
        end = self.start - timedelta(days=1)
        start = end - self.length
        midnight = time()
        return Period(datetime.combine(start.date(), midnight), datetime.combine(end.date(), midnight))

    def contains(self, column: Column | str) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        return column.between(timestamp(self.start), timestamp(self.end))

    def granularity(self) -> str:
        if self.length <= timedelta(hours=48):
            return "hour"
        return "day" if self.length <= timedelta(days=30) else "week"


def timestamp(value: datetime | date | str) -> Column:
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp")

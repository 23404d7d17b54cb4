from __future__ import annotations

from datetime import datetime

import pytest

from trailmark.params import Period


def test_previous_period_ends_a_millisecond_before():
    p = Period.of("2024-01-16", "2024-01-30 23:59:59.999")
    q = p.previous()
    assert q.end == datetime(2024, 1, 15, 23, 59, 59, 999000)
    assert q.start == datetime(2024, 1, 1)


def test_previous_days_are_cut_to_midnight():
    q = Period.of("2024-01-16 10:00", "2024-01-18 09:00").previous_days()
    assert (q.start, q.end) == (datetime(2024, 1, 13), datetime(2024, 1, 15))


@pytest.mark.parametrize("end, unit", [("2024-01-03", "hour"), ("2024-01-03 00:00:01", "day"), ("2024-01-31", "day"),
                                       ("2024-01-31 00:00:01", "week")])
def test_granularity(end, unit):
    assert Period.of("2024-01-01", end).granularity() == unit


def test_limits():
    with pytest.raises(ValueError):
        Period.of("2024-01-02", "2024-01-01")
    assert Period.preset("7d", datetime(2024, 1, 8)).start == datetime(2024, 1, 1)

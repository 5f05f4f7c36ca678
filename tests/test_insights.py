from __future__ import annotations

import datetime as dt

import pytest

from pedalflow.operators import insights as I

STATUS = "station_id string, captured_at_local timestamp_ntz"


def test_sketches_of_days_merge_to_any_period(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"s{(i * 7919) % 3000}", start + dt.timedelta(minutes=7 * i)) for i in range(6000)]
    status = spark.createDataFrame(rows, STATUS)
    days = I.coverage_sketches(status)
    assert days.count() == len({t.date() for _, t in rows})
    for since in (start, start + dt.timedelta(days=11)):
        inside = [(s, t) for s, t in rows if t.date() >= since.date()]
        got = I.merged_coverage(days.filter(f"date >= DATE '{since.date()}'")).first()
        exact = I.feed_coverage(spark.createDataFrame(inside, STATUS)).first()
        assert (got["capturas"], got["tmin"], got["tmax"]) == (exact["capturas"], exact["tmin"], exact["tmax"])
        assert got["estaciones"] == pytest.approx(exact["estaciones"], rel=0.05)


def test_no_captures(spark):
    got = I.merged_coverage(I.coverage_sketches(spark.createDataFrame([], STATUS))).first()
    assert tuple(got) == (0, 0, None, None)

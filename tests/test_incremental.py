from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pedalflow.operators import features, hourly
from pedalflow.plans import incremental

TRIP = "trip_id string, origin_station_id string, dest_station_id string, retiro_ts timestamp_ntz, arribo_ts timestamp_ntz"
START = datetime(2024, 3, 1)


def trips(spark, seed, days, stations, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(days=rng.choice(days), minutes=rng.randrange(1440))
        rows.append((f"{seed}-{i}", rng.choice(stations), rng.choice(stations), at, at + timedelta(minutes=rng.randrange(3, 90))))
    return spark.createDataFrame(rows, TRIP)


@pytest.fixture
def meta(spark):
    rows = [(s, 10 + i, 19.4, -99.1 - i) for i, s in enumerate("abcd")]
    return spark.createDataFrame(rows, "station_id string, capacity int, lat double, lon double")


@pytest.fixture
def stock(spark):
    rows = [(s, START + timedelta(hours=h), float(h % 7)) for s in "abc" for h in range(0, 24 * 70, 5)]
    return spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, bikes_end double")


def rows_of(df):
    return sorted(map(str, df.collect()))


def written(path):
    """Files of each day, with their times of writing."""
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def load(spark, out, run_id, batch, meta, stock):
    touched = incremental.refresh_demand(spark, out, run_id, batch)
    return touched, incremental.refresh_features(spark, out, run_id, touched, meta, stock)


def test_loads_one_after_the_other_equal_the_full_rebuild(spark, tmp_path, meta, stock):
    out = str(tmp_path / "out")
    batches = [trips(spark, 1, range(5, 30), "ab"), trips(spark, 2, range(38, 60), "abc"), trips(spark, 3, range(0, 3), "bc"), trips(spark, 4, [20], "ad", 9)]
    whole = None
    for i, batch in enumerate(batches):
        load(spark, out, f"r{i}", batch, meta, stock)
        whole = batch if whole is None else whole.unionByName(batch)
        demand = hourly.demand_hourly(whole)
        assert rows_of(incremental.stored_demand(spark, out).select(*demand.columns)) == rows_of(demand)
        frame = features.build_feature_frame(demand, meta, stock)
        assert rows_of(incremental.stored_features(spark, out).select(*frame.columns)) == rows_of(frame)


def test_a_load_writes_only_the_days_it_touches_and_those_that_look_back_on_them(spark, tmp_path, meta, stock):
    out = str(tmp_path / "out")
    load(spark, out, "r1", trips(spark, 1, range(0, 60), "abc", 400), meta, stock)
    before = {t: written(f"{out}/{t}") for t in ("demand_hourly", "model_features")}
    touched, days = load(spark, out, "r2", trips(spark, 2, [20], "ab", 20), meta, stock)
    first = (START + timedelta(days=20)).date()
    assert touched <= {first, first + timedelta(days=1)} and days == {d + timedelta(days=k) for d in touched for k in range(8)}
    for table, of_days in (("demand_hourly", touched), ("model_features", days)):
        fresh = {f for f, t in written(f"{out}/{table}").items() if before[table].get(f) != t}
        assert {date.fromisoformat(next(p for p in f.parts if p.startswith("date="))[5:]) for f in fresh} == of_days
        assert len(fresh) <= 2 * len(of_days)


def test_a_repeated_load_replaces_itself_and_new_places_restate_all_days(spark, tmp_path, meta, stock):
    out, batch, more = str(tmp_path / "out"), trips(spark, 1, range(0, 20), "ab"), trips(spark, 2, range(10, 12), "abd", 20)
    load(spark, out, "r1", batch, meta, stock)
    for _ in range(2):
        load(spark, out, "r2", more, meta, stock)
    demand = hourly.demand_hourly(batch.unionByName(more))
    frame = features.build_feature_frame(demand, meta, stock)
    assert rows_of(incremental.stored_features(spark, out).select(*frame.columns)) == rows_of(frame)
    moved = meta.withColumn("capacity", F.when(F.col("station_id") == "a", 99).otherwise(F.col("capacity")))
    load(spark, out, "r3", batch.limit(0), moved, stock)
    frame = features.build_feature_frame(demand, moved, stock)
    assert rows_of(incremental.stored_features(spark, out).select(*frame.columns)) == rows_of(frame)


def test_nothing_to_load(spark, tmp_path, meta):
    out = str(tmp_path / "out")
    assert load(spark, out, "r1", spark.createDataFrame([], TRIP), meta, None) == (set(), set())

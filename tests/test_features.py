from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pedalflow.operators import features as FE

DEMAND = "station_id string, date date, hour int, salidas double, llegadas double, flujo_neto double"
START = dt.datetime(2025, 6, 1)


def demand(spark, series: dict[str, dict[int, float]]):
    rows = []
    for station, values in series.items():
        for hour, value in values.items():
            ts = START + dt.timedelta(hours=hour)
            rows.append((station, ts.date(), ts.hour, float(value), 1.0, 1.0 - float(value)))
    return spark.createDataFrame(rows, DEMAND)


def meta(spark):
    return spark.createDataFrame([("1", 20, 19.4, -99.1)], "station_id string, capacity int, lat double, lon double")


def frame(spark, series, lags, windows, availability=None):
    df = FE.build_feature_frame(demand(spark, series), meta(spark), availability, lags, windows).toPandas()
    return df.sort_values(["station_id", "ts"]).reset_index(drop=True)


def test_lag_and_rolling_use_the_past_only(spark):
    df = frame(spark, {"1": {i: i for i in range(30)}}, [1, 2], [3])
    assert df["salidas_lag_1"].iloc[1:].tolist() == df["salidas"].iloc[:-1].tolist()
    assert df["salidas_lag_2"].iloc[:2].isna().all() and df.loc[2, "salidas_lag_2"] == 0.0
    for i in range(3, 30):
        assert df.loc[i, "salidas_roll_mean_3"] == pytest.approx(i - 2)
        assert df.loc[i, "salidas_roll_median_3"] == i - 2
    assert pd.isna(df.loc[0, "salidas_roll_mean_3"]) and pd.isna(df.loc[0, "salidas_roll_median_3"])


def test_grid_is_dense_and_shared_by_all_stations(spark):
    df = frame(spark, {"1": {0: 2, 5: 4}, "2": {3: 7}}, [1], [3])
    assert len(df) == 12
    two = df[df["station_id"] == "2"]
    assert two["salidas"].tolist() == [0, 0, 0, 7, 0, 0]
    assert two["capacity"].isna().all() and (df[df["station_id"] == "1"]["capacity"] == 20).all()


def test_availability_lag(spark):
    stock = spark.createDataFrame(
        [("1", START, 4.0), ("1", START + dt.timedelta(hours=2), 9.0), ("zz", START, 1.0)], "station_id string, ts timestamp_ntz, bikes_end double"
    )
    df = frame(spark, {"1": {0: 1, 3: 1}}, [1], [3], stock)
    assert len(df) == 4
    assert [None if pd.isna(v) else v for v in df["bikes_end_lag_1"]] == [None, 4.0, None, 9.0]


def test_features_do_not_change_with_later_demand(spark):
    base = {i: (i * 7) % 5 for i in range(40)}
    changed = {**base, **{i: 99 for i in range(30, 40)}}
    a, b = (frame(spark, {"1": s}, [1, 2], [3, 24]) for s in (base, changed))
    past = [c for c in a.columns if "lag" in c or "roll" in c]
    pd.testing.assert_frame_equal(a.loc[:30, past], b.loc[:30, past])


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**32 - 1))
def test_blocks_equal_pandas_over_many_blocks(spark, seed):
    """Series longer than a block: the halo makes every window see its past across the border."""
    rng = np.random.default_rng(seed)
    hours = 3200
    values = {s: {int(h): int(v) for h, v in zip(rng.choice(hours, 900, replace=False), rng.integers(1, 9, 900), strict=True)} for s in ("1", "2")}
    df = frame(spark, values, [1, 24, 168], [3, 24, 168])
    for _, g in df.groupby("station_id"):
        x = g["salidas"].reset_index(drop=True)
        g = g.reset_index(drop=True)
        for k in (1, 24, 168):
            pd.testing.assert_series_equal(g[f"salidas_lag_{k}"], x.shift(k), check_names=False)
        for w in (3, 24, 168):
            rolled = x.shift(1).rolling(w, min_periods=1)
            np.testing.assert_allclose(g[f"salidas_roll_mean_{w}"], rolled.mean(), atol=1e-9)
            pd.testing.assert_series_equal(g[f"salidas_roll_median_{w}"], rolled.median(), check_names=False)


def test_medians_slide_over_small_batches_and_are_not_worked_out_when_not_asked_for(spark):
    """A moving frame of ``percentile`` adds up the whole window again for every row; groups may start within a batch."""
    values = {s: {h: (h * k) % 11 for h in range(0, 90, k)} for k, s in enumerate(("1", "2", "3"), 1)}
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        df = frame(spark, values, [1], [3, 24])
    finally:
        spark.conf.set(setting, before)
    assert len(df) == 3 * 90
    for _, g in df.groupby("station_id"):
        x = g["salidas"].reset_index(drop=True)
        for w in (3, 24):
            pd.testing.assert_series_equal(g[f"salidas_roll_median_{w}"].reset_index(drop=True), x.shift(1).rolling(w, min_periods=1).median(), check_names=False)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole = FE.build_feature_frame(demand(spark, values), meta(spark))
    assert "percentile" not in plan(whole) and "ArrowEvalPython" in plan(whole)
    assert "ArrowEvalPython" not in plan(whole.select("station_id", "ts", "salidas_roll_mean_24"))

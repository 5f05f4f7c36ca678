from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pedalflow.operators import forecast as FC
from pedalflow.operators import insights as I
from pedalflow.operators import metrics as M


def series(spark, hours=240, stations=("1", "2", "3"), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in stations:
        for i in range(hours):
            ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
            rows.append((s, ts, ts.hour, ts.weekday(), float(rng.poisson(2 + (ts.hour in (8, 18)) * 6)), float(i % 7), None if i % 11 == 0 else 1.0, i % 2 == 0))
    return spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, hour int, dow int, salidas double, lag double, capacity double, flag boolean")


def test_split_follows_the_quantiles_of_all_rows(spark):
    pdf = pd.DataFrame({"ts": pd.to_datetime("2024-01-01") + pd.to_timedelta([0, 0, 0, 1, 2, 5, 9, 9, 30, 31, 70], unit="h")})
    df = spark.createDataFrame(pdf, "ts timestamp_ntz")
    bounds = FC.temporal_quantiles(df).first()
    assert bounds["val_start"] == pdf["ts"].quantile(0.6) and bounds["test_start"] == pdf["ts"].quantile(0.8)
    counts = {r["split"]: r["count"] for r in FC.temporal_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 6, "val": 2, "test": 3}


def test_baseline_equals_pandas_with_every_fallback(spark):
    rows = series(spark)
    train = rows.filter("station_id <> '3' AND hour <> 5 AND NOT (station_id = '2' AND dow = 1) AND NOT (station_id = '1' AND hour = 7)")
    got = FC.predict_baseline(FC.fit_baseline(train), rows).toPandas()
    t = train.toPandas()
    m3, m2, m1 = (t.groupby(k)["salidas"].median().to_dict() for k in (["station_id", "dow", "hour"], ["station_id", "hour"], "hour"))
    overall = t["salidas"].median()
    for r in got.itertuples():
        want = m3.get((r.station_id, r.dow, r.hour), m2.get((r.station_id, r.hour), m1.get(r.hour, overall)))
        assert r.y_pred_baseline == want
    with pytest.raises(ValueError):
        FC.fit_baseline(rows.drop("dow"))


def test_model_is_repeatable_non_negative_and_blind_to_the_future(spark):
    rows = series(spark)
    a, b = FC.train(rows, iterations=3), FC.train(rows, iterations=3)
    assert a.columns == ["hour", "dow", "lag", "capacity", "flag"]
    pa, pb = (t.scored.orderBy("station_id", "ts").toPandas() for t in (a, b))
    pd.testing.assert_frame_equal(pa, pb)
    assert (pa["y_pred_model"] >= 0).all() and set(pa["split"]) == {"train", "val", "test"}
    # other values after the training part leave model and baseline untouched
    start = a.bounds.first()["val_start"]
    later = rows.withColumn("salidas", F.when(F.col("ts") >= F.lit(start), F.lit(50.0)).otherwise(F.col("salidas")))
    pc = FC.train(later, iterations=3).scored.orderBy("station_id", "ts").toPandas()
    pd.testing.assert_series_equal(pa["y_pred_model"], pc["y_pred_model"])
    pd.testing.assert_series_equal(pa["y_pred_baseline"], pc["y_pred_baseline"])


def test_training_tasks_follow_the_rows(spark, monkeypatch):
    rows = series(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        few = FC.training_frame(rows, ["hour", "lag"]).persist()
        assert few.rdd.getNumPartitions() == 4 and few.count() == rows.count()
        few.unpersist()
        monkeypatch.setattr(FC, "_ROWS_PER_TASK", 100)
        many = FC.training_frame(rows, ["hour", "lag"]).persist()
        assert many.rdd.getNumPartitions() == 8 and many.count() == rows.count()
        many.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_saved_model_scores_alike_and_knows_new_stations(spark, tmp_path):
    rows = series(spark)
    trained = FC.train(rows, iterations=2)
    FC.save_model(spark, trained, str(tmp_path / "m"))
    model, meta = FC.load_model(spark, str(tmp_path / "m"))
    assert meta["feature_cols"] == trained.columns and meta["model_version"] == trained.version
    want = FC.predict_latest(trained.model, rows, trained.columns).collect()
    got = FC.predict_latest(model, rows, meta["feature_cols"]).collect()
    assert got == want and len(got) == 3
    assert [r["y_pred"] for r in got] == sorted((r["y_pred"] for r in got), reverse=True)
    other = rows.limit(1).withColumn("station_id", F.lit("new"))
    assert FC.predict_frame(model, other, meta["feature_cols"]).first()["y_pred"] >= 0


PREDICTIONS = "station_id string, ts timestamp_ntz, y_true double, y_pred_baseline double, y_pred_model double, split string"


def predictions(spark, rows):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, 1, h), t, b, m, split) for s, h, t, b, m, split in rows], PREDICTIONS)


def test_metrics(spark):
    p = predictions(spark, [("1", 8, 2.0, 1.0, 2.0, "test"), ("1", 3, 4.0, 7.0, 4.0, "test"), ("2", 8, 0.0, 1.0, 0.0, "test"), ("2", 8, 0.0, 0.0, 9.0, "val")])
    overall = {(r["split"], r["modelo"]): r for r in M.metrics_overall(p).collect()}
    base = overall["test", "linea_base"]
    assert (base["mae"], base["wape"], base["n"]) == (pytest.approx(5 / 3), pytest.approx(5 / 6), 3)
    assert base["rmse"] == pytest.approx(math.sqrt(11 / 3)) and base["sesgo_medio"] == pytest.approx(1.0)
    assert math.isnan(overall["val", "modelo"]["wape"])
    verdict = M.evaluation_verdict(M.metrics_overall(p)).first()
    assert (verdict["mejora_pct"], verdict["veredicto"]) == (100.0, M.MODEL_WINS)
    test = p.filter("split = 'test'")
    assert {r["n"] for r in M.metrics_peak(test).collect()} == {2}
    assert [r["station_id"] for r in M.top_demand_stations(test, 1).collect()] == ["1"]
    assert {r["n"] for r in M.metrics_top(test, 1).collect()} == {2}
    by = {r["station_id"]: r for r in M.compare_by_group(test, "station_id").collect()}
    assert (by["1"]["mae_base"], by["1"]["mae_modelo"], by["2"]["n_modelo"]) == (2.0, 0.0, 1)


def test_perfect_baseline_gives_no_improvement(spark):
    p = predictions(spark, [("1", 8, 2.0, 2.0, 3.0, "test")])
    verdict = M.evaluation_verdict(M.metrics_overall(p)).first()
    assert (verdict["mejora_pct"], verdict["veredicto"]) == (0.0, M.MODEL_LOSES)


def test_move_totals_count_a_receiver_once(spark):
    rows = [("w", "d1", "r", 5, 3.0, 1.0), ("w", "d2", "r", 2, 3.0, 1.0), ("w", "d1", "s", 1, 1.0, 0.0)]
    moves = spark.createDataFrame(rows, "target_ts string, donor_station_id string, receiver_station_id string, bikes_to_move int, receiver_deficit_before double, receiver_deficit_after double")
    assert tuple(I.move_totals(moves).first()) == (3, 8, 75.0)
    assert tuple(I.move_totals(moves.limit(0)).first()) == (0, 0, 0.0)

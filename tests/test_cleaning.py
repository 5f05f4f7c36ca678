from __future__ import annotations

import pandas as pd

from pedalflow.operators import cleaning as CL
from pedalflow.operators import hourly as H


def test_one_reason_per_row(raw_trips):
    raw = raw_trips(
        {},
        {"hora_arribo": "12:00:30"},
        {"hora_arribo": "17:00:00"},
        {"hora_arribo": "11:00:00"},
        {"ciclo_estacion_retiro": ""},
        {"ciclo_estacion_arribo": "null"},
        {"fecha_retiro": "fecha-mala"},
        {"bici": "nan"},
        {"fecha_retiro": "fecha-mala", "bici": ""},
    )
    got = {r["row_pos"]: r["reason"] for r in CL.classify(raw).collect()}
    assert got == {
        0: None,
        1: "duracion_muy_corta",
        2: "duracion_muy_larga",
        3: "arribo_no_posterior",
        4: "estacion_origen_ausente",
        5: "estacion_destino_ausente",
        6: "fecha_hora_invalida",
        7: "bici_ausente",
        8: "fecha_hora_invalida",
    }
    report = CL.rejection_report(raw).first()
    assert (report["total"], report["validas"], report["rechazadas"]) == (9, 1, 8)


def test_duplicates_keep_the_first_row(raw_trips):
    raw = raw_trips({"edad_usuario": "20"}, {"edad_usuario": "50"}, {"bici": "0070"}, {"source_file": "other.csv"})
    reasons = {r["row_pos"]: r["reason"] for r in CL.classify(raw).collect()}
    assert reasons == {0: None, 1: "duplicado", 2: None, 3: None}
    clean = CL.trips_clean(raw, "r").collect()
    assert len(clean) == 3 and {r["edad"] for r in clean if r["source_file"] == "test.csv" and r["bike_id"] == "0069"} == {20}


def test_copies_of_a_rejected_row_are_duplicates(raw_trips):
    raw = raw_trips({"bici": ""}, {"bici": ""}, {"bici": ""})
    rejected = CL.trip_rejections(raw, "r")
    assert sorted(r["reason"] for r in rejected.collect()) == ["bici_ausente", "duplicado", "duplicado"]
    report = CL.rejection_report(raw).first()
    assert (report["total"], report["validas"], report["motivo_duplicado"], report["motivo_bici_ausente"]) == (3, 0, 2, 1)


def test_report_percentage(raw_trips):
    assert CL.rejection_report(raw_trips({}, {"hora_arribo": "12:00:30"})).first()["pct_rechazado"] == 50.0


def test_totals_add_up(raw_trips):
    raw = raw_trips(*[{"bici": str(i)} for i in range(10)], {}, {})
    clean, rejected, report = CL.trips_clean(raw, "r"), CL.trip_rejections(raw, "r"), CL.rejection_report(raw).first()
    assert report["total"] == clean.count() + rejected.count() == 12
    assert report["validas"] == clean.count()
    found = clean.toPandas()
    assert found[["origin_station_id", "dest_station_id", "retiro_ts", "arribo_ts"]].notna().all().all()
    assert found["duration_min"].between(1, 240).all()


def test_age_as_float_text(raw_trips):
    clean = CL.trips_clean(raw_trips({"edad_usuario": "41.0", "bici": "A"}, {"edad_usuario": "", "bici": "B"}), "r")
    assert {r["bike_id"]: r["edad"] for r in clean.collect()} == {"A": 41, "B": None}


def test_limits_are_inclusive(raw_trips):
    raw = raw_trips({"hora_arribo": "12:01:00", "bici": "1"}, {"hora_arribo": "16:00:00", "bici": "2"})
    assert CL.trips_clean(raw, "r").count() == 2


def test_demand_in_one_pass_equals_the_joined_form(spark):
    trips = spark.createDataFrame(
        pd.DataFrame(
            {
                "origin_station_id": ["1", "1", "2", "3"],
                "dest_station_id": ["2", "2", "1", "3"],
                "retiro_ts": pd.to_datetime(["2024-01-01 08:10", "2024-01-01 08:50", "2024-01-01 08:59", "2024-01-07 23:50"]),
                "arribo_ts": pd.to_datetime(["2024-01-01 08:20", "2024-01-01 09:10", "2024-01-01 09:01", "2024-01-08 00:10"]),
            }
        ),
        "origin_station_id string, dest_station_id string, retiro_ts timestamp_ntz, arribo_ts timestamp_ntz",
    )
    out, into = H.departures_hourly(trips), H.arrivals_hourly(trips)
    joined = H.with_flows(H.attach_counts(H.activity_keys(out, into), out, into))
    one_pass = H.demand_hourly(trips)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, one_pass.collect()))
    sunday = one_pass.filter("station_id = '3' AND hour = 23").first()
    assert (sunday["dow"], sunday["salidas"], sunday["flujo_neto"]) == (6, 1, -1)


def test_availability_ignores_unknown_counts(spark):
    rows = [("1", "2024-01-01 08:00:00", None, 5), ("1", "2024-01-01 08:05:00", 0, 5), ("1", "2024-01-01 08:10:00", 3, 0), ("1", "2024-01-01 08:15:00", None, None), ("2", "2024-01-01 08:00:00", None, None)]
    status = spark.createDataFrame(rows, "station_id string, t string, num_bikes_available int, num_docks_available int").selectExpr(
        "station_id", "cast(t as timestamp_ntz) AS captured_at_local", "num_bikes_available", "num_docks_available"
    )
    got = {r["station_id"]: r for r in H.availability_hourly(status).collect()}
    one = got["1"]
    assert (one["bikes_start"], one["bikes_end"], one["bikes_min"], one["bikes_max"]) == (0, 3, 0, 3)
    assert (one["minutes_zero_bikes"], one["minutes_zero_docks"], one["empty_flag"], one["full_flag"], one["n_captures"]) == (5.0, 5.0, True, True, 4)
    assert (got["2"]["bikes_start"], got["2"]["empty_flag"], got["2"]["minutes_zero_bikes"]) == (None, None, 0.0)


def test_a_row_repeated_very_often_is_unfolded_in_slices(raw_trips, monkeypatch):
    monkeypatch.setattr(CL, "_COPIES_PER_TASK", 3)
    for copies in (1, 2, 3, 4, 5, 7, 11):
        rejected = CL.trip_rejections(raw_trips(*[{} for _ in range(copies)]), "r").collect()
        assert len(rejected) == copies - 1 and {r["reason"] for r in rejected} <= {"duplicado"}

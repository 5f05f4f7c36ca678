"""Declared schemas of the stored tables. Counts are LONG; timestamps are naive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Canonical column names of a raw trip file.
CANONICAL_COLUMNS = [
    "genero_usuario",
    "edad_usuario",
    "bici",
    "ciclo_estacion_retiro",
    "fecha_retiro",
    "hora_retiro",
    "ciclo_estacion_arribo",
    "fecha_arribo",
    "hora_arribo",
]

# Hours looked back on.
LAG_HOURS = (1, 2, 24, 168)
ROLLING_HOURS = (3, 24, 168)

_DDL = {
    "ingestion_runs": "run_id string, run_type string, source string, started_at_utc timestamp_ntz, "
    "finished_at_utc timestamp_ntz, status string, rows_ingested bigint, notes string",
    "historical_file_manifest": "url string, file_name string, year int, month int, "
    "discovered_at_utc timestamp_ntz, download_status string, http_status int, size_bytes bigint, "
    "checksum_sha256 string, local_path string, last_downloaded_at_utc timestamp_ntz",
    "trips_raw": "row_hash string, source_file string, run_id string, ingested_at_utc timestamp_ntz, "
    + ", ".join(f"{c} string" for c in CANONICAL_COLUMNS),
    "trips_clean": "trip_id string, bike_id string, origin_station_id string, dest_station_id string, "
    "retiro_ts timestamp_ntz, arribo_ts timestamp_ntz, duration_min double, genero string, edad int, "
    "source_file string, run_id string",
    "trip_rejections": "row_hash string, source_file string, run_id string, reason string, detail string, "
    "retiro_raw string, arribo_raw string, rejected_at_utc timestamp_ntz",
    "station_information": "station_id string, name string, lat double, lon double, capacity int, "
    "region_id string, short_name string, captured_at_utc timestamp_ntz, run_id string",
    "station_status": "capture_id string, station_id string, num_bikes_available int, "
    "num_docks_available int, is_installed boolean, is_renting boolean, is_returning boolean, "
    "last_reported bigint, captured_at_utc timestamp_ntz, captured_at_local timestamp_ntz, "
    "ingested_at_utc timestamp_ntz, run_id string",
    "station_bridge": "historico_id string, gbfs_id string, nombre_historico string, nombre_gbfs string, "
    "lat double, lon double, match_method string, confidence double, distance_m double, "
    "manual_review boolean",
    "demand_hourly": "station_id string, date date, hour int, dow int, salidas bigint, llegadas bigint, "
    "flujo_neto bigint, demanda_atendida bigint",
    "availability_hourly": "station_id string, date date, hour int, bikes_start int, bikes_end int, "
    "bikes_min int, bikes_max int, minutes_zero_bikes double, minutes_zero_docks double, "
    "empty_flag boolean, full_flag boolean, n_captures bigint",
    "model_features": "station_id string, ts timestamp_ntz, hour int, dow int, is_weekend boolean, "
    "month int, week int, is_holiday boolean, quincena boolean, capacity int, lat double, lon double, "
    "salidas double, llegadas double, flujo_neto double, bikes_end_lag_1 double, "
    + ", ".join(f"salidas_lag_{k} double" for k in LAG_HOURS)
    + ", "
    + ", ".join(
        f"salidas_roll_mean_{w} double, salidas_roll_median_{w} double" for w in ROLLING_HOURS
    ),
    "model_predictions": "station_id string, ts timestamp_ntz, target string, y_true double, "
    "y_pred_baseline double, y_pred_model double, split string, model_version string, "
    "created_at_utc timestamp_ntz",
    "rebalance_recommendations": "target_ts timestamp_ntz, donor_station_id string, "
    "receiver_station_id string, bikes_to_move int, distance_m double, donor_inventory_before double, "
    "donor_inventory_after double, receiver_inventory_before double, receiver_inventory_after double, "
    "receiver_deficit_before double, receiver_deficit_after double, confidence double, "
    "model_version string, created_at_utc timestamp_ntz",
}

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(ddl: str) -> T.StructType:
    # built without a session, so that the module can be imported before one exists
    pairs = (column.split() for column in ddl.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {name: _struct(ddl) for name, ddl in _DDL.items()}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select a table's declared columns in order and cast them; absent ones become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[name].fields
        ]
    )

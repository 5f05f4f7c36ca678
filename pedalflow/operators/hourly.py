"""Hourly demand of trips and hourly availability of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalflow.functions.calendar import dow

# Fixed value: minutes that one capture stands for.
CAPTURE_MINUTES = 5.0
_HOUR_KEYS = ["station_id", "date", "hour"]


def _hour_keys(station: str, ts: str) -> list[Column]:
    return [
        F.col(station).alias("station_id"),
        F.col(ts).cast("date").alias("date"),
        F.hour(ts).alias("hour"),
    ]


def departures_hourly(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*_hour_keys("origin_station_id", "retiro_ts")).agg(F.count(F.lit(1)).alias("salidas"))


def arrivals_hourly(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*_hour_keys("dest_station_id", "arribo_ts")).agg(F.count(F.lit(1)).alias("llegadas"))


def activity_keys(departures: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Station hours with a departure or an arrival."""
    return departures.select(*_HOUR_KEYS).union(arrivals.select(*_HOUR_KEYS)).distinct()


def attach_counts(keys: DataFrame, departures: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Given station hours with their departures and arrivals, 0 where there are none."""
    joined = keys.join(departures, _HOUR_KEYS, "left").join(arrivals, _HOUR_KEYS, "left")
    return joined.select(
        *_HOUR_KEYS,
        F.coalesce("salidas", F.lit(0)).cast("bigint").alias("salidas"),
        F.coalesce("llegadas", F.lit(0)).cast("bigint").alias("llegadas"),
    )


def with_flows(counts: DataFrame) -> DataFrame:
    return counts.select(
        *_HOUR_KEYS,
        dow(F.col("date")).alias("dow"),
        "salidas",
        "llegadas",
        (F.col("llegadas") - F.col("salidas")).alias("flujo_neto"),
        F.col("salidas").alias("demanda_atendida"),
    )


def demand_hourly(trips: DataFrame) -> DataFrame:
    """Demand per station hour in one pass: a trip counts once where it starts and once where it ends.

    One scan and one shuffle of pre-aggregated sums, in place of two aggregates, a union and two joins.
    """
    ends = trips.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("origin_station_id").alias("station_id"),
                    F.col("retiro_ts").alias("ts"),
                    F.lit(1).cast("bigint").alias("out"),
                    F.lit(0).cast("bigint").alias("in"),
                ),
                F.struct(
                    F.col("dest_station_id").alias("station_id"),
                    F.col("arribo_ts").alias("ts"),
                    F.lit(0).cast("bigint").alias("out"),
                    F.lit(1).cast("bigint").alias("in"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    counts = ends.groupBy(*_hour_keys("station_id", "ts")).agg(F.sum("out").alias("salidas"), F.sum("in").alias("llegadas"))
    return with_flows(counts)


def availability_aggregates(ts: Column, capture_minutes: float = CAPTURE_MINUTES) -> list[Column]:
    """First/last known stock ignore captures without a count; minutes assume one capture per interval."""
    bikes, docks = F.col("num_bikes_available"), F.col("num_docks_available")
    known_ts = F.when(bikes.isNotNull(), ts)  # min_by/max_by skip rows with a NULL ordering
    minutes = F.lit(float(capture_minutes))
    return [
        F.min_by(bikes, known_ts).alias("bikes_start"),
        F.max_by(bikes, known_ts).alias("bikes_end"),
        F.min(bikes).alias("bikes_min"),
        F.max(bikes).alias("bikes_max"),
        (minutes * F.count_if(bikes == 0)).alias("minutes_zero_bikes"),
        (minutes * F.count_if(docks == 0)).alias("minutes_zero_docks"),
        F.bool_or(bikes == 0).alias("empty_flag"),
        F.bool_or(docks == 0).alias("full_flag"),
        F.count(F.lit(1)).alias("n_captures"),
    ]


def availability_hourly(status: DataFrame, capture_minutes: float = CAPTURE_MINUTES) -> DataFrame:
    ts = F.col("captured_at_local")
    return (
        status.filter(ts.isNotNull())
        .groupBy("station_id", ts.cast("date").alias("date"), F.hour(ts).alias("hour"))
        .agg(*availability_aggregates(ts, capture_minutes))
    )

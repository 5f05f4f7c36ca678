"""Hourly demand and features kept up to date load by load, without reading the history of trips again.

Demand is a sum, so each load stores the sums of its own trips (``demand_parts``, one partition for each run, replaced when
the run is repeated). The days that a load touches are added up anew from the parts of these days alone and replace their
partitions of ``demand_hourly``.

A feature row looks at most 168 hours back. So the features of the touched days and of the 168 hours after them are
computed again, from the demand of these days and the 168 hours before, and replace their partitions of
``model_features``. When the span of the grid grows, the days between its old and its new end belong to them. A station
that is new gets its rows of all other days as partitions of its own (``cohort``, the run that brought it), which a
repeated load replaces. Where capacity or place of a known station has changed, all days are computed.

A repeat replaces partitions, it removes none: a day that only this run had, and of which its repeat has nothing, stays as
it was. Dates are brought to the driver: one for each day of the grid.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S
from pedalflow.operators import features, hourly
from pedalflow.session import scratch_path
from pedalflow.sources.sinks import read_table, replace_partitions, write_table

LOOK_BACK = timedelta(hours=168)
_DAY = timedelta(days=1)
_PART = "station_id string, date date, hour int, salidas bigint, llegadas bigint, run_id string"
_DEMAND = "station_id string, date date, hour int, dow int, salidas bigint, llegadas bigint, flujo_neto bigint, demanda_atendida bigint"
_STATION = "station_id string, capacity int, lat double, lon double, cohort string"


def _stored(spark: SparkSession, path: str, schema: str, by: list[str]) -> DataFrame:
    """The table at ``path``, an empty one before its first write."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def stored_demand(spark: SparkSession, out: str) -> DataFrame:
    return _stored(spark, f"{out}/demand_hourly", _DEMAND, ["date"])


def stored_features(spark: SparkSession, out: str) -> DataFrame:
    """The feature frame, as ``build_feature_frame`` gives it."""
    return spark.read.parquet(f"{out}/model_features").drop("date", "cohort")


def _dates(df: DataFrame) -> set[date]:
    return {r[0] for r in df.select("date").distinct().collect()}


def refresh_demand(spark: SparkSession, out: str, run_id: str, trips: DataFrame) -> set[date]:
    """Bring ``demand_hourly`` up to date with the trips of a run, and give the days that have changed."""
    path = f"{out}/demand_parts"
    earlier = _stored(spark, path, _PART, ["run_id"])
    touched = _dates(earlier.filter(F.col("run_id") == run_id))
    part = hourly.demand_hourly(trips).select("station_id", "date", "hour", "salidas", "llegadas", F.lit(run_id).alias("run_id"))
    replace_partitions(part, path, ["run_id"])
    parts = spark.read.schema(_PART).parquet(path)
    touched |= _dates(parts.filter(F.col("run_id") == run_id))
    if touched:
        of_days = parts.filter(F.col("date").isin(sorted(touched)))
        counts = of_days.groupBy("station_id", "date", "hour").agg(F.sum("salidas").alias("salidas"), F.sum("llegadas").alias("llegadas"))
        stored_demand(spark, out)
        replace_partitions(hourly.with_flows(counts), f"{out}/demand_hourly", ["date"])
    return touched


def refresh_availability(spark: SparkSession, out: str, status: DataFrame, days: Iterable[date]) -> None:
    """Replace the partitions of ``days`` in ``availability_hourly`` by what all captures of these days give."""
    days = sorted(days)
    if days:
        of_days = status.filter(F.col("captured_at_local").cast("date").isin(days))
        replace_partitions(hourly.availability_hourly(of_days), f"{out}/availability_hourly", ["date"])


def _span(rows: DataFrame) -> tuple[datetime, datetime] | None:
    """First and last hour of a table with ``date``; only its first and last day are read for the hours."""
    ends = rows.agg(F.min("date"), F.max("date")).first()
    if ends[0] is None:
        return None
    ts = F.col("ts") if "ts" in rows.columns else S.hour_ts(F.col("date"), F.col("hour"))
    return tuple(rows.filter(F.col("date").isin(list(ends))).agg(F.min(ts), F.max(ts)).first())


def _days(first: datetime, last: datetime) -> set[date]:
    """All days from the hour ``first`` to the hour ``last``."""
    return {first.date() + k * _DAY for k in range((last.date() - first.date()).days + 1)} if first <= last else set()


def days_to_compute(touched: Iterable[date], span: tuple[datetime, datetime], old: tuple[datetime, datetime] | None) -> set[date]:
    """Days whose feature rows may differ after ``touched`` days have changed and the grid has grown from ``old``."""
    lo, hi = span
    if old is None:
        return _days(lo, hi)
    out = {d + k * _DAY for d in touched for k in range(LOOK_BACK.days + 1)}
    if lo < old[0]:
        out |= _days(lo, old[0] + LOOK_BACK)
    if hi > old[1]:
        out |= _days(old[1], hi)
    return out & _days(lo, hi)


def refresh_features(
    spark: SparkSession, out: str, run_id: str, touched: Iterable[date], meta: DataFrame, availability_ts: DataFrame | None = None
) -> set[date]:
    """Bring ``model_features`` up to date after ``touched`` days of demand have changed, and give the days computed.

    ``meta`` holds capacity and coordinates of the stations, ``availability_ts`` their closing stock by hour; where the
    stock of other days than the touched ones has changed, name these days too.
    """
    path, demand = f"{out}/model_features", stored_demand(spark, out)
    span = _span(demand)
    if span is None:
        return set()
    known = _stored(spark, f"{out}/feature_stations", _STATION, ["cohort"])
    first = known.isEmpty()
    old = None if first else _span(spark.read.parquet(path))
    touched = set(touched)
    listed = demand.filter(F.col("date").isin(sorted(touched))) if not first else demand
    places = meta.select("station_id", "capacity", "lat", "lon")
    others = known.filter(F.col("cohort") != run_id)
    then, now = others.alias("then"), places.alias("now")
    same = [F.col(f"now.{c}").eqNullSafe(F.col(f"then.{c}")) for c in ("capacity", "lat", "lon")]
    restated = not then.join(now, "station_id", "left").filter(~(same[0] & same[1] & same[2])).isEmpty()
    fresh = listed.select("station_id").distinct().join(others, "station_id", "left_anti").withColumn("cohort", F.lit(run_id))
    own = known.filter(F.col("cohort") == run_id).select("station_id", "cohort")  # what a run has brought stays its own when it is repeated
    named = others.select("station_id", "cohort").unionByName(fresh.unionByName(own).distinct()).join(places, "station_id", "left")
    scratch = scratch_path(spark, "stations")
    write_table(named.select("station_id", "capacity", "lat", "lon", "cohort"), scratch)
    stations = read_table(spark, scratch, _STATION)
    brought = stations.filter(F.col("cohort") == run_id)
    days = days_to_compute(touched, span, None if restated else old)

    def write(of_stations: DataFrame, of_days: set[date]) -> None:
        """The rows of some stations and days, from the demand of these days and of 168 hours before."""
        if not of_days:
            return
        seen = sorted({d - k * _DAY for d in of_days for k in range(LOOK_BACK.days + 1)} & _days(*span))
        rows = demand.filter(F.col("date").isin(seen)).join(of_stations.select("station_id"), "station_id", "left_semi")
        stock = None if availability_ts is None else availability_ts.filter(F.col("ts").cast("date").isin(seen))
        part = features.Part(of_stations.select("station_id"), span, sorted(of_days))
        frame = features.build_feature_frame(rows, places, stock, part=part)
        frame = frame.join(of_stations.select("station_id", "cohort"), "station_id").withColumn("date", F.col("ts").cast("date"))
        replace_partitions(frame, path, ["date", "cohort"])

    write(stations, days)
    if not brought.isEmpty():
        write(brought, _days(*span) - days)
    replace_partitions(stations if restated else brought, f"{out}/feature_stations", ["cohort"])
    return days

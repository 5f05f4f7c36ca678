"""Read queries over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S
from pedalflow.functions.calendar import dow
from pedalflow.operators.upserts import latest_per_key

_RISK = ("demanda_media", "riesgo_vaciado", "riesgo_saturacion", "min_sin_bicis")


def has_data(table: DataFrame) -> DataFrame:
    return table.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_data"))


def summary(trips: DataFrame, rejections: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: trips, rejections, stations, period and test errors."""
    t = trips.agg(
        F.count(F.lit(1)).alias("n_trips"),
        F.count_distinct("origin_station_id").alias("n_stations"),
        F.min("retiro_ts").alias("period_min"),
        F.max("retiro_ts").alias("period_max"),
    )
    rejected = rejections.agg(F.count(F.lit(1))).scalar()
    errors = (
        predictions.filter(F.col("split") == "test")
        .agg(
            F.struct(
                F.avg(F.abs(F.col("y_true") - F.col("y_pred_baseline"))).alias("base"),
                F.avg(F.abs(F.col("y_true") - F.col("y_pred_model"))).alias("model"),
            )
        )
        .scalar()
    )
    row = t.withColumns({"n_rejected": rejected, "_errors": errors})
    return row.select(
        "n_trips",
        "n_rejected",
        S.pct(F.col("n_rejected"), F.col("n_trips") + F.col("n_rejected"), 2).alias("pct_rejected"),
        "n_stations",
        "period_min",
        "period_max",
        F.col("_errors.base").alias("mae_base"),
        F.col("_errors.model").alias("mae_model"),
    )


# --- risk --------------------------------------------------------------------------------------


def live_demand(demand: DataFrame, bridge: DataFrame) -> DataFrame:
    """Hourly demand under live station ids."""
    ids = bridge.select(F.col("historico_id").alias("station_id"), "gbfs_id")
    return demand.join(ids, "station_id").drop("station_id").withColumnRenamed("gbfs_id", "station_id")


def mean_demand(demand: DataFrame, bridge: DataFrame) -> DataFrame:
    """Mean departures per live station. Hours are summed per historical id before the join."""
    sums = demand.groupBy("station_id").agg(F.sum("salidas").alias("s"), F.count("salidas").alias("n"))
    return live_demand(sums, bridge).groupBy("station_id").agg((F.sum("s") / F.sum("n")).alias("demanda_media"))


def availability_rates(availability: DataFrame) -> DataFrame:
    return availability.groupBy("station_id").agg(*_rates())


def _rate_columns(rows: Column) -> dict[str, Column]:
    """Shares of empty and full hours and minutes without bikes over the hours that ``rows`` selects."""

    def rate(flag: str) -> Column:
        return F.avg(F.when(rows, F.when(F.col(flag), 1.0).otherwise(0.0)))

    return {
        "riesgo_vaciado": rate("empty_flag"),
        "riesgo_saturacion": rate("full_flag"),
        "min_sin_bicis": F.sum(F.when(rows, F.col("minutes_zero_bikes"))),
    }


def _rates() -> list[Column]:
    return [c.alias(name) for name, c in _rate_columns(F.lit(True)).items()]


def _risk(information: DataFrame, demand: DataFrame, availability: DataFrame, bridge: DataFrame) -> DataFrame:
    info = latest_per_key(information.select("station_id", "name", "lat", "lon", "capacity", "captured_at_utc"), "station_id", "captured_at_utc")
    joined = info.join(mean_demand(demand, bridge), "station_id", "left").join(
        availability_rates(availability), "station_id", "left"
    )
    return joined.select(
        "station_id", "name", "lat", "lon", "capacity", *[S.null_default(F.col(c), 0.0).alias(c) for c in _RISK]
    )


def last_bikes(status: DataFrame) -> DataFrame:
    newest = latest_per_key(
        status.select("station_id", "num_bikes_available", "captured_at_utc", "capture_id"), "station_id", "captured_at_utc", "capture_id"
    )
    return newest.select("station_id", F.col("num_bikes_available").alias("bicis_actuales"))


def stations_risk(
    information: DataFrame, demand: DataFrame, availability: DataFrame, status: DataFrame, bridge: DataFrame
) -> DataFrame:
    return _risk(information, demand, availability, bridge).join(last_bikes(status), "station_id", "left")


def day_hour_filter(rows: DataFrame, dows: Sequence[int], hour: int, day: Column | None = None) -> DataFrame:
    weekday = dow(F.col("date")) if day is None else day
    return rows.filter(weekday.isin(*[int(d) for d in dows]) & (F.col("hour") == int(hour)))


def stations_risk_filtered(
    information: DataFrame,
    demand: DataFrame,
    availability: DataFrame,
    bridge: DataFrame,
    dows: Sequence[int],
    hour: int,
) -> DataFrame:
    """Risk for some weekdays at one hour; the overall risk if the choice is empty or holds no demand.

    One pass sums both per station, all hours and the chosen ones; the chosen departures in total decide which to show.
    """
    if not dows:
        return _risk(information, demand, availability, bridge)
    days = [int(x) for x in dows]
    chosen = F.col("dow").isin(*days) & (F.col("hour") == int(hour))
    sums = demand.groupBy("station_id").agg(
        F.sum("salidas").alias("s"),
        F.count("salidas").alias("n"),
        F.coalesce(F.sum(F.when(chosen, F.col("salidas"))), F.lit(0)).alias("cs"),
        F.count(F.when(chosen, F.col("salidas"))).alias("cn"),
    )
    means = live_demand(sums, bridge).groupBy("station_id").agg(*[F.sum(c).alias(c) for c in ("s", "n", "cs", "cn")])
    found = F.coalesce(means.agg(F.sum("cs")).scalar(), F.lit(0)) != 0
    demanded = means.select("station_id", F.when(found, F.try_divide("cs", "cn")).otherwise(F.try_divide("s", "n")).alias("demanda_media"))

    chosen = dow(F.col("date")).isin(*days) & (F.col("hour") == int(hour))
    rates = [
        F.when(found, F.col(f"{name}_chosen")).otherwise(F.col(name)).alias(name) for name in ("riesgo_vaciado", "riesgo_saturacion", "min_sin_bicis")
    ]
    both = availability.groupBy("station_id").agg(*_rates(), *[c.alias(f"{name}_chosen") for name, c in _rate_columns(chosen).items()])
    info = latest_per_key(information.select("station_id", "name", "lat", "lon", "capacity", "captured_at_utc"), "station_id", "captured_at_utc")
    joined = info.join(demanded, "station_id", "left").join(both.select("station_id", *rates), "station_id", "left")
    return joined.select("station_id", "name", "lat", "lon", "capacity", *[S.null_default(F.col(c), 0.0).alias(c) for c in _RISK])


def risk_ranking(risk: DataFrame, n: int | None = 10) -> DataFrame:
    ordered = risk.orderBy(F.col("riesgo_vaciado").desc(), F.col("demanda_media").desc(), "station_id")
    return ordered if n is None else ordered.limit(n)


def min_risk(risk: DataFrame, threshold: float) -> DataFrame:
    """Stations at or above a risk, with the colour and radius they are drawn with."""
    share = F.col("riesgo_vaciado")
    return risk.filter(share >= F.lit(float(threshold))).withColumns(
        {
            "r": S.clip(F.lit(255.0) * share, F.lit(0.0), F.lit(255.0)),
            "g": S.clip(F.lit(200.0) * (1 - share), F.lit(0.0), F.lit(255.0)),
            "radio": F.lit(40.0) + F.col("demanda_media") * F.lit(25.0),
        }
    )


def map_center(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


# --- per station -------------------------------------------------------------------------------


def station_list(demand: DataFrame) -> DataFrame:
    return demand.select("station_id").distinct().orderBy("station_id")


def demand_profile(demand: DataFrame, station_id: str | None = None) -> DataFrame:
    """Mean departures, arrivals and net flow by hour, of one station or of each."""
    keys = ["hour"] if station_id is not None else ["station_id", "hour"]
    rows = demand if station_id is None else demand.filter(F.col("station_id") == station_id)
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("salidas", "llegadas", "flujo_neto")]).orderBy(*keys)


def availability_profile(availability: DataFrame, bridge: DataFrame, station_id: str | None = None) -> DataFrame:
    """Mean opening stock and empty minutes by hour, of one historical station or of each."""
    stock = [F.avg("bikes_start").alias("bicis_promedio"), F.avg("minutes_zero_bikes").alias("min_sin_bicis")]
    if station_id is not None:
        return bridged_availability(availability, bridge, station_id).groupBy("hour").agg(*stock).orderBy("hour")
    per_live = availability.groupBy("station_id", "hour").agg(*stock)
    ids = bridge.filter(F.col("gbfs_id").isNotNull()).select("historico_id", F.col("gbfs_id").alias("station_id"))
    return per_live.join(ids, "station_id").select("historico_id", "hour", "bicis_promedio", "min_sin_bicis")


def bridged_availability(availability: DataFrame, bridge: DataFrame, station_id: str | None = None) -> DataFrame:
    """Availability rows of live stations that some (or one given) historical station is bridged to."""
    ids = bridge if station_id is None else bridge.filter(F.col("historico_id") == station_id)
    return availability.join(ids.select(F.col("gbfs_id").alias("station_id")), "station_id", "left_semi")


def demand_timeseries(predictions: DataFrame, station_id: str | None = None, target: str = "salidas") -> DataFrame:
    rows = predictions.filter(F.col("target") == target)
    keys = ["station_id"] if station_id is None else []
    rows = rows if station_id is None else rows.filter(F.col("station_id") == station_id)
    return rows.select(
        *keys,
        "ts",
        F.col("y_true").alias("observado"),
        F.col("y_pred_baseline").alias("linea_base"),
        F.col("y_pred_model").alias("modelo"),
        "split",
    ).orderBy(*keys, "ts")


def hourly_mean_all(demand: DataFrame) -> DataFrame:
    return demand.groupBy("hour").agg(F.avg("salidas").alias("salidas_prom")).orderBy("hour")


def top_empty_minutes(availability: DataFrame, n: int = 10) -> DataFrame:
    totals = availability.groupBy("station_id").agg(F.sum("minutes_zero_bikes").alias("min_sin_bicis"))
    return totals.orderBy(F.col("min_sin_bicis").desc(), "station_id").limit(n)


def net_pressure(demand: DataFrame) -> DataFrame:
    """Accumulated net flow per station, the most drained first."""
    return demand.groupBy("station_id").agg(F.sum("flujo_neto").alias("flujo_acumulado")).orderBy("flujo_acumulado", "station_id")


# --- moves and coverage ------------------------------------------------------------------------


def moves_by_size(moves: DataFrame) -> DataFrame:
    return moves.orderBy(F.col("bikes_to_move").desc(), "donor_station_id", "receiver_station_id")


def move_map(moves: DataFrame, information: DataFrame) -> DataFrame:
    """Moves with the coordinates of both stations."""
    info = latest_per_key(information.select("station_id", "lat", "lon", "captured_at_utc"), "station_id", "captured_at_utc")
    donors = info.select(F.col("station_id").alias("donor_station_id"), F.col("lat").alias("donor_lat"), F.col("lon").alias("donor_lon"))
    receivers = info.select(F.col("station_id").alias("receiver_station_id"), F.col("lat").alias("recv_lat"), F.col("lon").alias("recv_lon"))
    return (
        moves.select("donor_station_id", "receiver_station_id", "bikes_to_move")
        .join(donors, "donor_station_id", "left")
        .join(receivers, "receiver_station_id", "left")
    )


def move_points(move_map_rows: DataFrame) -> DataFrame:
    """Points of donors and receivers; moves with a missing coordinate are left out."""
    complete = move_map_rows.dropna(subset=["donor_lat", "donor_lon", "recv_lat", "recv_lon"])
    ends = [F.struct(F.col(f"{end}_lon").alias("lon"), F.col(f"{end}_lat").alias("lat")) for end in ("donor", "recv")]
    return complete.select(F.inline(F.array(*ends)))


def move_totals(moves: DataFrame, keys: Sequence[str] = ("target_ts",)) -> DataFrame:
    """One row: moves, bikes and avoided share of the deficit, each receiver counted once per window."""
    receivers = moves.groupBy(*keys, "receiver_station_id").agg(
        F.count(F.lit(1)).alias("moves"),
        F.sum("bikes_to_move").alias("bikes"),
        F.max("receiver_deficit_before").alias("before"),
        F.max("receiver_deficit_after").alias("after"),
    )
    totals = receivers.agg(
        F.coalesce(F.sum("moves"), F.lit(0)).alias("movimientos"),
        F.coalesce(F.sum("bikes"), F.lit(0)).alias("bicis_movidas"),
        F.sum("before").alias("before"),
        F.sum("after").alias("after"),
    )
    return totals.select(
        "movimientos", "bicis_movidas", S.pct(F.col("before") - F.col("after"), F.col("before"), 2).alias("pct_desabasto_evitado")
    )


def feed_coverage(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("capturas"),
        F.count_distinct("station_id").alias("estaciones"),
        F.min("captured_at_local").alias("tmin"),
        F.max("captured_at_local").alias("tmax"),
    )


# Fixed value: log2 of the counters of a sketch; its error is about 1.04 / sqrt(2 ** 12), 1.6 per cent.
SKETCH_BITS = 12


def coverage_sketches(status: DataFrame) -> DataFrame:
    """One row for each day: captures, first and last time, and a sketch of the stations that any period can merge."""
    return status.groupBy(F.col("captured_at_local").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("capturas"),
        F.hll_sketch_agg("station_id", SKETCH_BITS).alias("estaciones"),
        F.min("captured_at_local").alias("tmin"),
        F.max("captured_at_local").alias("tmax"),
    )


def merged_coverage(sketches: DataFrame) -> DataFrame:
    """``feed_coverage`` of the days of ``sketches`` without their captures: the number of stations is an estimate."""
    return sketches.agg(
        F.coalesce(F.sum("capturas"), F.lit(0)).alias("capturas"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("estaciones")), F.lit(0)).alias("estaciones"),
        F.min("tmin").alias("tmin"),
        F.max("tmax").alias("tmax"),
    )

"""Expected inventory, station balance and the donor → receiver plan, for many windows at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S
from pedalflow.functions.calendar import dow
from pedalflow.functions.geo import pairs_within
from pedalflow.operators.upserts import latest_per_key
from pedalflow.schemas import conform
from pedalflow.session import cut_lineage

# Defaults of the plan.
SAFETY_STOCK_FRACTION = 0.15
TARGET_FILL_FRACTION = 0.5
MAX_PAIR_DISTANCE_M = 1500.0
MAX_BIKES_PER_MOVE = 20
TARGET_HOUR = 18
MODEL_VERSION = "rebalanceo_heuristico_v1"

WINDOW_KEYS = ("target_ts",)

# rounds between two writes to the shared folder
_ROUNDS_PER_CUT = 5


# --- expected inventory ------------------------------------------------------------------------


def default_target(status: DataFrame, hour: int = TARGET_HOUR) -> Column:
    """``hour`` o'clock of the last captured day, as a scalar."""
    last = F.max("captured_at_local")
    day = last.cast("date").cast("timestamp_ntz")
    return status.agg((day + F.expr(f"INTERVAL {int(hour)} HOURS")).alias("target")).scalar()


def daily_targets(status: DataFrame, hour: int = TARGET_HOUR) -> Column:
    """``hour`` o'clock of every captured day, as a scalar array."""
    first, last = F.min(F.col("captured_at_local").cast("date")), F.max(F.col("captured_at_local").cast("date"))
    days = F.transform(
        F.sequence(first, last), lambda d: d.cast("timestamp_ntz") + F.expr(f"INTERVAL {int(hour)} HOURS")
    )
    return status.agg(days.alias("targets")).scalar()


def _captures(status: DataFrame) -> DataFrame:
    return status.filter(F.col("captured_at_local").isNotNull()).select(
        "station_id",
        F.col("captured_at_local").alias("ts"),
        F.col("num_bikes_available").cast("double").alias("bikes"),
        "capture_id",
    )


def nearest_ranks(status: DataFrame, target: Column, range_s: int = 3600) -> DataFrame:
    """Rank of every capture of a station by its distance in time from ``target``: of two as close, the earlier first.

    Captures are counted by station and range of the gap; running sums over the counts tell how many captures lie in
    nearer ranges, and only the captures of one range are put in order together. No task holds a whole station.
    """
    near = status.filter(F.col("captured_at_local").isNotNull()).withColumn("gap", S.epoch_diff(F.col("captured_at_local"), target))
    near = near.select("station_id", "capture_id", "captured_at_local", "gap", F.floor(F.col("gap") / range_s).alias("span"))
    nearer = Window.partitionBy("station_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = near.groupBy("station_id", "span").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(F.col("station_id").alias("_station"), F.col("span").alias("_span"), F.coalesce(F.sum("n").over(nearer), F.lit(0)).alias("before"))
    inside = Window.partitionBy("station_id", "span").orderBy("gap", "captured_at_local", "capture_id")
    ranked = near.withColumn("inside", F.row_number().over(inside))
    same = F.col("station_id").eqNullSafe(F.col("_station")) & (F.col("span") == F.col("_span"))
    return ranked.join(offsets, same).select("station_id", "capture_id", "captured_at_local", "gap", (F.col("before") + F.col("inside")).alias("rn"))


def nearest_capture(status: DataFrame, target: Column) -> DataFrame:
    """Per station the capture closest to one target time; of two as close, the earlier.

    A pre-aggregated minimum: no station is sorted, a station with very many captures costs no more.
    """
    seen = _captures(status).withColumn("_target", target)
    order = F.struct(S.epoch_diff(F.col("ts"), F.col("_target")), "ts", "capture_id")
    best = seen.groupBy("station_id").agg(F.min_by(F.struct("ts", "bikes"), order).alias("c"))
    return best.select("station_id", F.col("c.bikes").alias("current_inv"), F.col("c.ts").alias("captured_at_local"))


def nearest_captures(status: DataFrame, targets: Column) -> DataFrame:
    """(station_id, target_ts, current_inv): the closest capture for each of many target times.

    ``targets`` is an array. Captures of a target's own hour are compared directly; from all other hours
    only the first and last capture of the hour can win, so the search runs over station hours.
    """
    seen = _captures(status).withColumn("hour_no", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600))
    times = status.sparkSession.range(1).select(F.explode(targets).alias("target_ts"))
    times = times.withColumn("hour_no", F.floor(F.unix_seconds(F.col("target_ts").cast("timestamp")) / 3600))

    capture = F.struct("ts", "capture_id", "bikes")

    def closeness(c: str) -> Column:
        return F.struct(S.epoch_diff(F.col(f"{c}.ts"), F.col("target_ts")).alias("gap"), F.col(f"{c}.ts"), F.col(f"{c}.capture_id"))

    same_hour = (
        seen.select("station_id", "hour_no", capture.alias("c"))
        .join(times, "hour_no")
        .groupBy("station_id", "target_ts")
        .agg(F.min_by("c", closeness("c")).alias("c"))
    )
    per_hour = seen.groupBy("station_id", "hour_no").agg(
        F.min(capture).alias("first"), F.min_by(capture, F.struct(-S.micros(F.col("ts")), "capture_id")).alias("last")
    )
    marks = seen.select("station_id").distinct().withColumn("target_ts", F.explode(targets))
    marks = marks.withColumn("hour_no", F.floor(F.unix_seconds(F.col("target_ts").cast("timestamp")) / 3600))
    line = per_hour.unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy("station_id").orderBy("hour_no").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("station_id").orderBy(F.col("hour_no").desc()).rangeBetween(Window.unboundedPreceding, -1)
    around = line.select(
        "station_id",
        "target_ts",
        F.last("last", ignorenulls=True).over(back).alias("before"),
        F.last("first", ignorenulls=True).over(ahead).alias("after"),
    ).filter(F.col("target_ts").isNotNull())
    other_hours = around.select(
        "station_id", "target_ts", F.explode(F.array_compact(F.array("before", "after"))).alias("c")
    )
    best = (
        same_hour.unionByName(other_hours).groupBy("station_id", "target_ts").agg(F.min_by("c", closeness("c")).alias("c"))
    )
    return best.select("station_id", "target_ts", F.col("c.bikes").alias("current_inv"))


def slot_medians(demand: DataFrame) -> DataFrame:
    """Median departures and arrivals per station, weekday and hour: all 168 slots in one aggregation."""
    return demand.groupBy("station_id", "dow", "hour").agg(
        F.percentile("salidas", F.lit(0.5)).alias("med_salidas"), F.percentile("llegadas", F.lit(0.5)).alias("med_llegadas")
    )


def slot_flows(demand: DataFrame, bridge: DataFrame) -> DataFrame:
    """Slot medians under live station ids. Historical ids bridged to one live station add up."""
    ids = bridge.filter(F.col("gbfs_id").isNotNull()).select(F.col("historico_id").alias("station_id"), "gbfs_id")
    return (
        slot_medians(demand)
        .join(ids, "station_id")
        .groupBy(F.col("gbfs_id").alias("station_id"), "dow", "hour")
        .agg(F.sum("med_salidas").alias("med_salidas"), F.sum("med_llegadas").alias("med_llegadas"))
    )


def inventory_balance(information: DataFrame, current: DataFrame, flows: DataFrame) -> DataFrame:
    """Stations × windows with the expected stock: current stock, or half the capacity, less the net outflow.

    ``current`` holds one row per station and window; ``information`` one row per station and window.
    """
    slots = information.withColumns({"dow": dow(F.col("target_ts")), "hour": F.hour("target_ts")})
    joined = slots.join(current, ["station_id", "target_ts"], "left").join(flows, ["station_id", "dow", "hour"], "left")
    filled = joined.withColumns(
        {
            "current_inv": F.coalesce("current_inv", F.col("capacity") * 0.5),
            "med_salidas": S.null_default(F.col("med_salidas"), 0.0),
            "med_llegadas": S.null_default(F.col("med_llegadas"), 0.0),
        }
    )
    expected = S.clip(F.col("current_inv") - (F.col("med_salidas") - F.col("med_llegadas")), F.lit(0.0))
    return filled.select(
        "target_ts", "station_id", "capacity", "lat", "lon", "current_inv", "med_salidas", "med_llegadas",
        expected.alias("expected_inventory"),
    )


def expected_inventory(
    information: DataFrame, status: DataFrame, demand: DataFrame, bridge: DataFrame, targets: Column
) -> DataFrame:
    newest = latest_per_key(information.select("station_id", "capacity", "lat", "lon", "captured_at_utc"), "station_id", "captured_at_utc")
    windows = newest.drop("captured_at_utc").withColumn("target_ts", F.explode(targets))
    return inventory_balance(windows, nearest_captures(status, targets), slot_flows(demand, bridge))


# --- balance -----------------------------------------------------------------------------------


def balance_state(
    stations: DataFrame,
    safety_stock_fraction: float = SAFETY_STOCK_FRACTION,
    target_fill_fraction: float = TARGET_FILL_FRACTION,
    keys: Sequence[str] = WINDOW_KEYS,
) -> DataFrame:
    """Stock, safety and target level, deficit, need and surplus. Stations without a capacity are left out."""
    if safety_stock_fraction > target_fill_fraction:
        raise ValueError("the safety level must not exceed the target level")
    capacity = F.col("capacity").cast("double")
    known = stations.filter(capacity.isNotNull() & F.col("expected_inventory").isNotNull())
    stocked = known.select(
        *keys,
        "station_id",
        capacity.alias("capacity"),
        "lat",
        "lon",
        F.least(F.greatest(F.col("expected_inventory").cast("double"), F.lit(0.0)), capacity).alias("inv"),
        S.half_even(F.lit(float(safety_stock_fraction)) * capacity).alias("safety"),
        S.half_even(F.lit(float(target_fill_fraction)) * capacity).alias("target"),
    )
    zero = F.lit(0.0)
    return stocked.withColumns(
        {
            "deficit_before": F.greatest(F.col("safety") - F.col("inv"), zero),
            "need": S.half_even(F.greatest(F.col("target") - F.col("inv"), zero)).cast("int"),
            "avail": F.floor(F.greatest(F.col("inv") - F.col("target"), zero)).cast("int"),
        }
    )


# --- plan --------------------------------------------------------------------------------------


def candidate_pairs(
    state: DataFrame, max_pair_distance_m: float = MAX_PAIR_DISTANCE_M, keys: Sequence[str] = WINDOW_KEYS
) -> DataFrame:
    """Receivers with the donors in reach, joined on grid cells."""
    room = F.floor(F.col("capacity") - F.col("inv")).cast("int")
    receivers = state.filter(F.col("deficit_before") > 0).select(
        *keys, F.col("station_id").alias("receiver"), "lat", "lon", "deficit_before", F.least("need", room).alias("need")
    )
    donors = state.filter(F.col("avail") > 0).select(
        *keys, F.col("station_id").alias("donor"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "avail"
    )
    pairs = pairs_within(receivers.filter(F.col("need") > 0), donors, max_pair_distance_m, on=tuple(keys))
    return pairs.select(*keys, "receiver", "donor", "dist", "deficit_before", "need", "avail")


def allocate(pairs: DataFrame, keys: Sequence[str] = WINDOW_KEYS, on_round: Callable[[int], None] | None = None) -> DataFrame:
    """Bikes per pair, ``qty``, as if receivers chose one after the other, the largest deficit first.

    Every receiver takes from its nearest donors, so all donors rank receivers alike and the sequential
    result is the stable one: in each round receivers ask along their distance order, donors grant along the
    deficit order, and what a donor cannot grant lowers the cap of that pair. Caps only fall, by whole
    bikes, so the rounds end. Groups are the neighbours of one station, windows run side by side. ``on_round`` is told
    how many pairs go on after each cut.
    """
    by_distance = Window.partitionBy(*keys, "receiver").orderBy("dist", "donor")
    by_priority = Window.partitionBy(*keys, "donor").orderBy(F.col("deficit_before").desc(), "receiver")

    def before(w, c: str) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def one_round(state: DataFrame) -> DataFrame:
        asked = state.withColumn(
            "asked", F.greatest(F.least(F.col("cap"), F.col("need") - before(by_distance, "cap")), F.lit(0))
        )
        granted = asked.withColumn(
            "qty", F.greatest(F.least(F.col("asked"), F.col("avail") - before(by_priority, "asked")), F.lit(0))
        )
        refused = F.col("qty") < F.col("asked")
        return granted.withColumns({"cap": F.when(refused, F.col("qty")).otherwise(F.col("cap")), "refused": refused})

    # Only what is still in motion goes on: a window without a refusal is final and is written out once.
    current, settled = cut_lineage(pairs.withColumn("cap", F.col("avail").cast("bigint"))), []
    while True:
        for _ in range(_ROUNDS_PER_CUT):
            current = one_round(current.drop("asked", "qty", "refused"))
        current = cut_lineage(current)
        # the windows are few: cut as well, they are looked up twice, and the pairs are written once a cut
        moving = cut_lineage(current.filter("refused").select(*keys).distinct())
        settled.append(current.filter("qty > 0").join(moving, list(keys), "left_anti"))
        current = current.join(moving, list(keys), "left_semi")
        if on_round is not None:
            on_round(current.count())
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, settled).drop("cap", "asked", "refused")


def moves_of(
    allocation: DataFrame,
    state: DataFrame,
    max_pair_distance_m: float = MAX_PAIR_DISTANCE_M,
    max_bikes_per_move: int = MAX_BIKES_PER_MOVE,
    keys: Sequence[str] = WINDOW_KEYS,
) -> DataFrame:
    """Single moves of bounded size with the inventories before and after, in the order they are decided."""
    limit = F.lit(int(max_bikes_per_move)).cast("bigint")
    parts = allocation.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("qty") - 1) / limit))))
    parts = parts.withColumn("bikes_to_move", F.least(limit, F.col("qty") - F.col("part") * limit))
    donors = state.select(*keys, F.col("station_id").alias("donor"), F.col("inv").alias("donor_inv"))
    receivers = state.select(
        *keys, F.col("station_id").alias("receiver"), F.col("inv").alias("receiver_inv"), F.col("safety").alias("receiver_safety")
    )
    stocked = parts.join(donors, [*keys, "donor"]).join(receivers, [*keys, "receiver"])
    of_donor = Window.partitionBy(*keys, "donor").orderBy(F.col("deficit_before").desc(), "receiver", "part")
    of_receiver = Window.partitionBy(*keys, "receiver").orderBy("dist", "donor", "part")
    up_to = (Window.unboundedPreceding, 0)
    given = F.sum("bikes_to_move").over(of_donor.rowsBetween(*up_to))
    taken = F.sum("bikes_to_move").over(of_receiver.rowsBetween(*up_to))
    received = F.sum("bikes_to_move").over(Window.partitionBy(*keys, "receiver"))
    bikes = F.col("bikes_to_move")
    return stocked.withColumns({"given": given, "taken": taken, "received": received}).select(
        *keys,
        F.col("donor").alias("donor_station_id"),
        F.col("receiver").alias("receiver_station_id"),
        bikes.cast("int").alias("bikes_to_move"),
        S.half_even(F.col("dist"), 1).alias("distance_m"),
        (F.col("donor_inv") - F.col("given") + bikes).alias("donor_inventory_before"),
        (F.col("donor_inv") - F.col("given")).alias("donor_inventory_after"),
        (F.col("receiver_inv") + F.col("taken") - bikes).alias("receiver_inventory_before"),
        (F.col("receiver_inv") + F.col("taken")).alias("receiver_inventory_after"),
        F.col("deficit_before").alias("receiver_deficit_before"),
        F.greatest(F.col("receiver_safety") - F.col("receiver_inv") - F.col("received"), F.lit(0.0)).alias("receiver_deficit_after"),
        S.half_even(F.greatest(F.lit(0.0), 1 - F.col("dist") / F.lit(float(max_pair_distance_m))), 3).alias("confidence"),
    )


def rebalance_summary(state: DataFrame, moves: DataFrame, keys: Sequence[str] = WINDOW_KEYS) -> DataFrame:
    """Per window: receivers, donors, moves, bikes, deficit before and after, and the conservation check."""
    signed = moves.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("donor_station_id").alias("station_id"), (-F.col("bikes_to_move")).alias("delta"), F.lit(1).alias("moves")),
                F.struct(F.col("receiver_station_id").alias("station_id"), F.col("bikes_to_move").alias("delta"), F.lit(0).alias("moves")),
            )
        ),
    )
    changes = signed.groupBy(*keys, "station_id").agg(F.sum("delta").alias("delta"), F.sum("moves").alias("moves"))
    after = state.join(changes, [*keys, "station_id"], "left").withColumn(
        "inv_after", F.col("inv") + F.coalesce("delta", F.lit(0))
    )
    deficit_after = F.greatest(F.col("safety") - F.col("inv_after"), F.lit(0.0))
    totals = after.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("estaciones"),
        F.count_if(F.col("deficit_before") > 0).alias("receptoras"),
        F.count_if(F.col("avail") > 0).alias("donantes_disponibles"),
        F.sum(F.coalesce("moves", F.lit(0))).alias("movimientos"),
        F.sum(F.greatest(F.coalesce("delta", F.lit(0)), F.lit(0))).alias("bicis_movidas"),
        F.sum("deficit_before").alias("deficit_antes"),
        F.sum(deficit_after).alias("deficit_despues"),
        (F.abs(F.sum("inv") - F.sum("inv_after")) < F.lit(1e-6)).alias("inventario_conservado"),
    )
    avoided = S.pct(F.col("deficit_antes") - F.col("deficit_despues"), F.col("deficit_antes"), 2)
    return totals.withColumn("pct_desabasto_evitado", avoided)


def recommend_moves(
    stations: DataFrame,
    safety_stock_fraction: float = SAFETY_STOCK_FRACTION,
    target_fill_fraction: float = TARGET_FILL_FRACTION,
    max_pair_distance_m: float = MAX_PAIR_DISTANCE_M,
    max_bikes_per_move: int = MAX_BIKES_PER_MOVE,
    keys: Sequence[str] = WINDOW_KEYS,
) -> tuple[DataFrame, DataFrame]:
    """(moves, summary) for stations with capacity, expected inventory and coordinates, per window."""
    state = cut_lineage(balance_state(stations, safety_stock_fraction, target_fill_fraction, keys))
    pairs = candidate_pairs(state, max_pair_distance_m, keys)
    moves = moves_of(allocate(pairs, keys), state, max_pair_distance_m, max_bikes_per_move, keys)
    return moves, rebalance_summary(state, moves, keys)


def build_recommendations(
    information: DataFrame,
    status: DataFrame,
    demand: DataFrame,
    bridge: DataFrame,
    targets: Column | None = None,
    created_at: Column | None = None,
    **limits,
) -> tuple[DataFrame, DataFrame]:
    """(recommendations table, summary) for the given windows, by default 18:00 of the last captured day."""
    targets = F.array(default_target(status)) if targets is None else targets
    moves, summary = recommend_moves(expected_inventory(information, status, demand, bridge, targets), **limits)
    stamped = moves.withColumns(
        {"model_version": F.lit(MODEL_VERSION), "created_at_utc": F.localtimestamp() if created_at is None else created_at}
    )
    return conform(stamped, "rebalance_recommendations"), summary

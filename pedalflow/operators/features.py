"""Leak-free features per station hour on a dense grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S
from pedalflow.functions.calendar import calendar_columns
from pedalflow.operators.upserts import latest_per_key
from pedalflow.schemas import LAG_HOURS, ROLLING_HOURS

_FLOWS = ("salidas", "llegadas", "flujo_neto")
_MIN_BLOCK_HOURS = 1344  # eight weeks


def station_meta(bridge: DataFrame, information: DataFrame) -> DataFrame:
    """Capacity and coordinates per historical station, from the newest version of its live station."""
    newest = latest_per_key(information.select("station_id", "capacity", "lat", "lon", "captured_at_utc"), "station_id", "captured_at_utc")
    live = newest.select(F.col("station_id").alias("gbfs_id"), "capacity", "lat", "lon")
    return (
        bridge.select(F.col("historico_id").alias("station_id"), "gbfs_id")
        .join(live, "gbfs_id", "left")
        .select("station_id", "capacity", "lat", "lon")
    )


def recent_availability(availability: DataFrame, bridge: DataFrame | None = None) -> DataFrame:
    """Closing stock per station hour; with a bridge, under the historical ids."""
    rows = availability.select("station_id", S.hour_ts(F.col("date"), F.col("hour")).alias("ts"), F.col("bikes_end").cast("double").alias("bikes_end"))
    if bridge is None:
        return rows
    ids = bridge.filter(F.col("gbfs_id").isNotNull()).select("historico_id", F.col("gbfs_id").alias("station_id"))
    return rows.join(ids, "station_id").select(F.col("historico_id").alias("station_id"), "ts", "bikes_end")


def with_ts(demand: DataFrame) -> DataFrame:
    return demand.select("station_id", S.hour_ts(F.col("date"), F.col("hour")).alias("ts"), *[F.col(c).cast("double").alias(c) for c in _FLOWS])


def _hour_number(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600)


def _hour_at(number: Column) -> Column:
    return F.timestamp_seconds(number * 3600).cast("timestamp_ntz")


def _number_of(ts: datetime) -> int:
    return int((ts - datetime(1970, 1, 1)).total_seconds() // 3600)


def _first_hour(day: date) -> int:
    return (day - date(1970, 1, 1)).days * 24


@dataclass(frozen=True)
class Part:
    """A part of the grid: its stations, the first and last hour of the whole grid, and the days that are asked for."""

    stations: DataFrame
    span: tuple[datetime, datetime]
    days: Sequence[date]

    def blocks(self, block_hours: int) -> list[int]:
        return sorted({(_first_hour(d) + h) // block_hours for d in self.days for h in (0, 23)})

    def runs(self, halo: int) -> list[tuple[int, int]]:
        """Ranges of hours that hold the days and ``halo`` hours before each of them."""
        out: list[tuple[int, int]] = []
        for day in sorted(self.days):
            lo, hi = _first_hour(day) - halo, _first_hour(day) + 23
            if out and lo <= out[-1][1] + 1:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out


def _within(number: Column, runs: Sequence[tuple[int, int]]) -> Column:
    inside = F.lit(False)
    for lo, hi in runs:
        inside = inside | number.between(lo, hi)
    return inside


def _blocks(demand_ts: DataFrame, block_hours: int, halo: int, part: Part | None = None) -> DataFrame:
    """Station × block seeds: the hours each block must hold, its halo of earlier hours included."""
    if part is None:
        span = demand_ts.agg(
            F.struct(F.min(_hour_number(F.col("ts"))).alias("lo"), F.max(_hour_number(F.col("ts"))).alias("hi"))
        ).scalar()
        seeds = demand_ts.select("station_id").distinct().withColumn("_span", span)
        blocks = F.sequence(F.floor(F.col("_span.lo") / block_hours), F.floor(F.col("_span.hi") / block_hours))
    else:
        lo, hi = (F.lit(_number_of(ts)).cast("bigint") for ts in part.span)
        seeds = part.stations.select("station_id").distinct().withColumn("_span", F.struct(lo.alias("lo"), hi.alias("hi")))
        blocks = F.array(*[F.lit(b).cast("bigint") for b in part.blocks(block_hours)])
    return seeds.withColumn("block", F.explode(blocks)).select(
        "station_id",
        "block",
        F.greatest(F.col("_span.lo"), F.col("block") * block_hours - halo).alias("lo"),
        F.least(F.col("_span.hi"), (F.col("block") + 1) * block_hours - 1).alias("hi"),
    )


def _in_blocks(ts_rows: DataFrame, block_hours: int, halo: int) -> DataFrame:
    """Rows stamped with their block, and with the next one when they lie in its halo."""
    number = _hour_number(F.col("ts"))
    first = F.floor(number / block_hours)
    last = F.floor((number + halo) / block_hours)
    return ts_rows.withColumn("block", F.explode(F.sequence(first, last)))


def _grid_blocks(demand_ts: DataFrame, availability_ts: DataFrame | None, block_hours: int, halo: int, part: Part | None = None) -> DataFrame:
    """Dense station hours in blocks, flows filled with 0 and ``bikes_end`` where known.

    Seeds and facts travel in one shuffle by (station, block); the hours are unfolded after it. No
    station is one long task: a block holds a bounded number of hours, halo included.
    """
    none = F.lit(None).cast("double")
    seeds = _blocks(demand_ts, block_hours, halo, part).select(
        "station_id", "block", "lo", "hi", *[F.lit(0.0).alias(c) for c in _FLOWS], none.alias("bikes_end"), F.lit(True).alias("_seed")
    )
    facts = _in_blocks(demand_ts, block_hours, halo).withColumn("bikes_end", none)
    if availability_ts is not None:
        stock = _in_blocks(availability_ts, block_hours, halo).withColumns({c: F.lit(0.0) for c in _FLOWS})
        facts = facts.unionByName(stock)
    number = _hour_number(F.col("ts"))
    facts = facts.select(
        "station_id", "block", number.alias("lo"), number.alias("hi"), *_FLOWS, "bikes_end", F.lit(False).alias("_seed")
    )
    rows = seeds.unionByName(facts).repartition("station_id", "block")
    hours = rows.withColumn("hour_no", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    if part is not None:
        hours = hours.filter(_within(F.col("hour_no"), part.runs(halo)))
    dense = hours.groupBy("station_id", "block", "hour_no").agg(
        *[F.sum(c).alias(c) for c in _FLOWS], F.max("bikes_end").alias("bikes_end"), F.bool_or("_seed").alias("_in_grid")
    )
    return dense.filter("_in_grid").drop("_in_grid")


def dense_grid(demand: DataFrame) -> DataFrame:
    """Every station × every hour from the first to the last hour with demand."""
    demand_ts = with_ts(demand)
    seeds = _blocks(demand_ts, _MIN_BLOCK_HOURS, 0).repartition("station_id", "block")
    hours = seeds.withColumn("hour_no", F.explode(F.sequence("lo", "hi")))
    return hours.select("station_id", _hour_at(F.col("hour_no")).alias("ts"))


def fill_grid(grid: DataFrame, demand: DataFrame) -> DataFrame:
    """Grid rows with the demand of the hour, 0 where there is none."""
    joined = grid.join(with_ts(demand), ["station_id", "ts"], "left")
    return joined.fillna(0.0, subset=list(_FLOWS))


def enrich_grid(grid: DataFrame, meta: DataFrame, availability_ts: DataFrame) -> DataFrame:
    return grid.join(meta, "station_id", "left").join(availability_ts, ["station_id", "ts"], "left")


def lag_columns(w, lags: Sequence[int] = LAG_HOURS, column: str = "salidas") -> list[Column]:
    return [F.lag(column, k).over(w).alias(f"{column}_lag_{k}") for k in lags]


def running_columns(w, column: str = "salidas") -> list[Column]:
    """Sum and number of the rows before the current one, which every rolling mean is taken from."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return [F.sum(column).over(before).alias("_sum"), (F.row_number().over(w) - 1).alias("_seen")]


def rolling_means(w, windows: Sequence[int] = ROLLING_HOURS, column: str = "salidas") -> list[Column]:
    """Mean of up to ``hours`` rows before the current one: the difference of two running sums.

    One step per row whatever the length of the window, where a moving frame adds up every row again.
    """
    return [
        ((F.col("_sum") - F.coalesce(F.lag("_sum", hours).over(w), F.lit(0.0))) / F.nullif(F.least("_seen", F.lit(hours)), F.lit(0)))
        .alias(f"{column}_roll_mean_{hours}")
        for hours in windows
    ]


class _Before(BaseIndexer):
    """The rows from ``start`` to just before the current one."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start, np.arange(num_values)


def _medians(windows: Sequence[int], values: np.ndarray, seen: np.ndarray) -> dict[str, np.ndarray]:
    at = np.arange(len(values))
    rows = pd.Series(values)
    return {f"_{hours}": rows.rolling(_Before(start=at - np.minimum(seen, hours)), min_periods=1).median() for hours in windows}


def rolling_medians(windows: Sequence[int] = ROLLING_HOURS, column: str = "salidas") -> Column:
    """Exact medians of up to ``hours`` rows before the current one, a field ``_<hours>`` for each window.

    A task slides over its rows, which must be in the order of the windows with ``_seen`` rows of the same group before
    each; the longest window is all it keeps from one batch to the next. As the result depends on that order, the
    function is marked so that no filter is moved in front of it.
    """

    def slide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        kept = np.empty(0)
        for values, seen in batches:
            held = np.concatenate((kept, values.to_numpy(np.float64)))
            found = _medians(windows, held, np.concatenate((np.arange(len(kept)), seen.to_numpy(np.int64))))
            yield pd.DataFrame(found).iloc[len(kept) :]
            kept = held[-max(windows) :]

    fields = ", ".join(f"_{hours} double" for hours in windows)
    return F.pandas_udf(slide, fields).asNondeterministic()(F.col(column), F.col("_seen"))


def build_feature_frame(
    demand: DataFrame,
    meta: DataFrame,
    availability_ts: DataFrame | None = None,
    lag_hours: Sequence[int] = LAG_HOURS,
    rolling_windows: Sequence[int] = ROLLING_HOURS,
    part: Part | None = None,
) -> DataFrame:
    """Dense grid, calendar, station data, lags and rolling statistics of past hours only.

    With ``part`` only the rows of its stations and days are made; ``demand`` must then hold its days and the longest
    window before each of them.
    """
    halo = max([1, *lag_hours, *rolling_windows])
    block_hours = max(_MIN_BLOCK_HOURS, 8 * halo)
    blocks = _grid_blocks(with_ts(demand), availability_ts, block_hours, halo, part)
    w = Window.partitionBy("station_id", "block").orderBy("hour_no")
    summed = blocks.select("*", *running_columns(w))
    lagged = summed.select(
        "station_id",
        "block",
        "hour_no",
        *_FLOWS,
        F.lag("bikes_end", 1).over(w).alias("bikes_end_lag_1"),
        *lag_columns(w, lag_hours),
        *rolling_means(w, rolling_windows),
        "_seen",
    )
    if rolling_windows:
        slid = lagged.sortWithinPartitions("station_id", "block", "hour_no").withColumn("_medians", rolling_medians(rolling_windows))
        lagged = slid.withColumns({f"salidas_roll_median_{hours}": F.col(f"_medians._{hours}") for hours in rolling_windows})
    lagged = lagged.filter(F.col("hour_no") >= F.col("block") * block_hours)
    if part is not None:
        lagged = lagged.filter(_within(F.col("hour_no"), part.runs(0)))
    timed = lagged.withColumn("ts", _hour_at(F.col("hour_no")))
    lag_names = [f"salidas_lag_{k}" for k in lag_hours]
    roll_names = [f"salidas_roll_{s}_{h}" for h in rolling_windows for s in ("mean", "median")]
    named = timed.select("station_id", "ts", *calendar_columns(F.col("ts")), *_FLOWS, "bikes_end_lag_1", *lag_names, *roll_names)
    station_columns = [c for c in ("capacity", "lat", "lon") if c in meta.columns]
    joined = named.join(meta.select("station_id", *station_columns), "station_id", "left")
    calendar_names = ["hour", "dow", "is_weekend", "month", "week", "is_holiday", "quincena"]
    return joined.select(
        "station_id", "ts", *calendar_names, *station_columns, *_FLOWS, "bikes_end_lag_1", *lag_names, *roll_names
    )

"""Distances and a lossless grid for joins within a radius."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def _row_height(radius_m: float) -> float:
    # a hair taller than the radius, so float rounding cannot push a partner two rows away
    return math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)


HALF_GLOBE_M = math.pi * EARTH_RADIUS_M


def grid_row(lat: Column, radius_m: float) -> Column:
    """Rows are one radius high: partners sit in the same row or the one above or below."""
    return F.floor(lat / F.lit(_row_height(radius_m)))


def grid_columns(row: Column, radius_m: float) -> Column:
    """Number of columns of a row around the globe.

    Each is at least as wide as the radius at the highest latitude of the row and its neighbours, so partners are at
    most one column apart. Near a pole, or with a radius that spans it, a row is one column.
    """
    north = F.greatest(F.abs(row - 1), F.abs(row + 2)) * F.lit(_row_height(radius_m))
    # sin(d/2R) >= cos(lat)·sin(dlon/2), hence the exact bound on the longitude difference
    sine = F.lit(math.sin(min(radius_m / EARTH_RADIUS_M, math.pi) / 2)) / F.cos(F.radians(north))
    width = F.degrees(2 * F.asin(sine)) * F.lit(1 + 1e-9)
    return F.when((north < 90) & (sine < 1), F.greatest(F.floor(F.lit(360.0) / width), F.lit(1))).otherwise(F.lit(1)).cast("bigint")


def grid_col(lon: Column, columns: Column) -> Column:
    """Column of a longitude in a row of ``columns`` columns; they wrap around at 180 degrees."""
    return F.pmod(F.floor((lon + 180.0) / 360.0 * columns), columns)


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    radius_m: float,
    on: tuple[str, ...] = (),
    left_lat: str = "lat",
    left_lon: str = "lon",
    right_lat: str = "r_lat",
    right_lon: str = "r_lon",
) -> DataFrame:
    """Rows of both sides at most ``radius_m`` apart, with ``dist``; sides share only the ``on`` names.

    Equi join on grid cells: the left row is stamped with the 3×3 cells around it, the right row
    with its own, so every pair meets exactly once. Points without coordinates meet nobody.
    """
    rows = left.filter(F.col(left_lat).isNotNull() & F.col(left_lon).isNotNull()).withColumn(
        "_row", F.explode(F.sequence(grid_row(F.col(left_lat), radius_m) - 1, grid_row(F.col(left_lat), radius_m) + 1))
    )
    # the neighbour row has its own column width, so the column is computed per stamped row
    columns = grid_columns(F.col("_row"), radius_m)
    own_col = grid_col(F.col(left_lon), columns)
    around = F.array_distinct(F.array(*[F.pmod(own_col + step, columns) for step in (-1, 0, 1)]))
    stamped = rows.withColumn("_col", F.explode(around))
    cells = (
        right.filter(F.col(right_lat).isNotNull() & F.col(right_lon).isNotNull())
        .withColumn("_row", grid_row(F.col(right_lat), radius_m))
        .withColumn("_col", grid_col(F.col(right_lon), grid_columns(F.col("_row"), radius_m)))
    )
    dist = haversine_m(F.col(left_lat), F.col(left_lon), F.col(right_lat), F.col(right_lon))
    return (
        stamped.join(cells, [*on, "_row", "_col"])
        .withColumn("dist", dist)
        .filter(F.col("dist") <= F.lit(float(radius_m)))
        .drop("_row", "_col")
    )

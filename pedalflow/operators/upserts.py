"""Idempotent loads: only rows that a stored table does not hold yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S
from pedalflow.schemas import conform

_INFO_STATE = ("name", "lat", "lon", "capacity")


def latest_per_key(versions: DataFrame, key: str, order: Column | str, *ties: Column | str) -> DataFrame:
    """Newest row per key: pre-aggregated, so a key with very many versions is no hot task."""
    picked = versions.groupBy(key).agg(F.max_by(F.struct(*[c for c in versions.columns if c != key]), F.struct(order, *ties)).alias("_row"))
    return picked.select(key, "_row.*")


def new_status_rows(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Captures whose (station, last_reported) is unknown; captures without last_reported always load."""
    # distinct combines copies before the shuffle that the join needs anyway, so no stored key is hot
    known = stored.select("station_id", "last_reported").filter(F.col("last_reported").isNotNull()).distinct()
    dated = incoming.filter(F.col("last_reported").isNotNull())
    undated = incoming.filter(F.col("last_reported").isNull())
    return dated.join(known, ["station_id", "last_reported"], "left_anti").select(*incoming.columns).unionByName(undated)


def new_information_rows(incoming: DataFrame, stored: DataFrame, against: str = "any") -> DataFrame:
    """Station versions that differ from every stored version (``any``) or from the newest one (``latest``)."""
    if against == "latest":
        stored = latest_per_key(stored.select("station_id", *_INFO_STATE, "captured_at_utc"), "station_id", "captured_at_utc")
    elif against != "any":
        raise ValueError(f"unknown comparison {against!r}")
    i, s = incoming.alias("i"), stored.select("station_id", *_INFO_STATE).distinct().alias("s")
    same = F.col("i.station_id") == F.col("s.station_id")
    for c in _INFO_STATE:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}"))
    return i.join(s, same, "left_anti")


def new_trips(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.join(stored.select("trip_id"), "trip_id", "left_anti").select(*incoming.columns)


def status_rows(parsed: DataFrame, run_id: str, captured_at: Column, ingested_at: Column | None = None) -> DataFrame:
    """Parsed status entries as station_status rows."""
    return conform(
        parsed.withColumns(
            {
                "capture_id": S.capture_id(F.col("station_id"), F.col("last_reported")),
                "captured_at_utc": captured_at,
                "captured_at_local": S.utc_to_local(captured_at),
                "ingested_at_utc": F.localtimestamp() if ingested_at is None else ingested_at,
                "run_id": F.lit(run_id),
            }
        ),
        "station_status",
    )


def information_rows(parsed: DataFrame, run_id: str, captured_at: Column) -> DataFrame:
    return conform(parsed.withColumns({"captured_at_utc": captured_at, "run_id": F.lit(run_id)}), "station_information")

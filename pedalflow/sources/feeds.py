"""Station feed documents: discovery, station information and station status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S

# All leaves as text: the feeds write 1, "1" and true for the same thing.
STATUS_DOC = (
    "data struct<stations: array<struct<station_id: string, num_bikes_available: string, "
    "num_docks_available: string, is_installed: string, is_renting: string, is_returning: string, "
    "last_reported: string>>>"
)
INFO_DOC = (
    "data struct<stations: array<struct<station_id: string, name: string, lat: string, lon: string, "
    "capacity: string, region_id: string, short_name: string>>>"
)
_FEEDS = "struct<feeds: array<struct<name: string, url: string>>>"
#: JSON texts of a value that counts as missing.
_EMPTY_JSON = ("", "{}", "[]", "0", "false")


def station_entries(docs: DataFrame, doc_schema: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per entry; a document without entries keeps one row without position."""
    parsed = docs.select(*keep, F.from_json("doc", doc_schema).alias("_d"))
    return parsed.select(*keep, F.posexplode_outer("_d.data.stations").alias("pos", "st"))


def first_in_doc(stations: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """First entry of each station in each document, and how many entries it had there.

    An aggregate rather than a window: repeated entries are combined before the shuffle.
    """
    return (
        stations.filter(F.col("st.station_id").isNotNull())
        .groupBy(*keep, F.col("st.station_id").alias("station_id"))
        .agg(F.min_by("st", "pos").alias("st"), F.count(F.lit(1)).alias("entries"))
    )


def _status_columns() -> dict:
    bikes, docks = S.as_int(F.col("st.num_bikes_available")), S.as_int(F.col("st.num_docks_available"))
    return {
        "num_bikes_available": S.null_negatives(bikes).cast("int"),
        "num_docks_available": S.null_negatives(docks).cast("int"),
        "is_installed": S.as_bool(F.col("st.is_installed")),
        "is_renting": S.as_bool(F.col("st.is_renting")),
        "is_returning": S.as_bool(F.col("st.is_returning")),
        "last_reported": S.as_int(F.col("st.last_reported")),
    }


def parse_station_status(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Status rows of documents (``doc`` holds the JSON text), first entry per station."""
    first = first_in_doc(station_entries(docs, STATUS_DOC, keep), keep)
    return first.select(*keep, "station_id", *[c.alias(n) for n, c in _status_columns().items()])


def status_quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: repeated stations, entries with a negative count, entries without an id."""
    per_station = (
        station_entries(docs, STATUS_DOC, keep)
        .groupBy(*keep, F.col("st.station_id").alias("station_id"))
        .agg(F.min_by("st", "pos").alias("st"), F.count("pos").alias("entries"))
    )
    bikes, docks = S.as_int(F.col("st.num_bikes_available")), S.as_int(F.col("st.num_docks_available"))
    named = F.col("station_id").isNotNull()
    return per_station.groupBy(*keep).agg(
        F.sum(F.when(named, F.col("entries") - 1).otherwise(F.lit(0))).alias("dup_stations"),
        F.count_if(named & ((bikes < 0) | (docks < 0))).alias("negativos"),
        F.sum(F.when(named, F.lit(0)).otherwise(F.col("entries"))).alias("sin_station_id"),
    )


def parse_station_information(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    first = first_in_doc(station_entries(docs, INFO_DOC, keep), keep)
    return first.select(
        *keep,
        "station_id",
        F.col("st.name").alias("name"),
        S.as_float(F.col("st.lat")).alias("lat"),
        S.as_float(F.col("st.lon")).alias("lon"),
        S.as_int(F.col("st.capacity")).cast("int").alias("capacity"),
        F.col("st.region_id").alias("region_id"),
        F.col("st.short_name").alias("short_name"),
    )


def discover_feeds(docs: DataFrame, language: str = "es") -> tuple[DataFrame, DataFrame]:
    """(feeds, rejects): feed name → url per document, flat form first, then the block of the language, then the first block.

    Another block is looked at only where the one of the language is missing or empty. Documents whose block has no feed
    list go to the second frame instead of failing the job.
    """
    parsed = docs.select(
        "doc_id",
        F.from_json("doc", f"data {_FEEDS}").getField("data").getField("feeds").alias("flat"),
        F.from_json("doc", "data map<string, string>").getField("data").alias("by_language"),
        F.array_contains(F.json_object_keys(F.get_json_object("doc", "$.data")), "feeds").alias("is_flat"),
    )
    own = F.try_element_at("by_language", F.lit(language))
    block = F.when(own.isNotNull() & ~own.isin(*_EMPTY_JSON), own).otherwise(F.try_element_at(F.map_values("by_language"), F.lit(1)))
    listed = F.from_json(block, _FEEDS).getField("feeds")
    chosen = F.when(F.coalesce("is_flat", F.lit(False)), F.col("flat")).otherwise(listed)
    listed = parsed.select("doc_id", chosen.alias("feeds"))
    empty = F.coalesce(F.size("feeds"), F.lit(0)) <= 0
    feeds = (
        listed.select("doc_id", F.posexplode("feeds").alias("pos", "feed"))
        .filter(F.col("feed.name").isNotNull() & F.col("feed.url").isNotNull())
        .groupBy("doc_id", F.col("feed.name").alias("name"))
        .agg(F.max_by("feed.url", "pos").alias("url"))
    )
    return feeds, listed.filter(empty).select("doc_id")

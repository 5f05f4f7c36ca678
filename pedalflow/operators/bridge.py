"""Identity of stations across sources: alias, id, name, similar name, distance."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedalflow.functions import scalars as S
from pedalflow.functions.geo import HALF_GLOBE_M, pairs_within
from pedalflow.functions.text import normalize_name
from pedalflow.operators.upserts import latest_per_key
from pedalflow.schemas import conform
from pedalflow.session import cut_lineage

# Thresholds of the name and distance matches.
MIN_NAME_SIMILARITY = 0.82
MAX_MATCH_DISTANCE_M = 120.0
_EPS = 1e-9


# --- inputs ------------------------------------------------------------------------------------


def station_ids(trips: DataFrame) -> DataFrame:
    """Distinct non-null station ids of both trip ends, in one scan."""
    ends = trips.select(F.explode(F.array("origin_station_id", "dest_station_id")).alias("station_id"))
    return ends.filter(F.col("station_id").isNotNull()).distinct()


def historical_stations(trips: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Ids seen in trips, with name and coordinates where a catalogue has them."""
    ids = station_ids(trips).withColumnRenamed("station_id", "historico_id")
    if catalog is not None:
        return ids.join(catalog.select("historico_id", "nombre", "lat", "lon"), "historico_id", "left")
    return ids.select(
        "historico_id",
        F.lit(None).cast("string").alias("nombre"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
    )


def live_stations(information: DataFrame) -> DataFrame:
    newest = latest_per_key(information.select("station_id", "name", "lat", "lon", "captured_at_utc"), "station_id", "captured_at_utc")
    return newest.select(F.col("station_id").alias("gbfs_id"), F.col("name").alias("nombre"), "lat", "lon")


# --- single matchers ---------------------------------------------------------------------------


def alias_matches(hist: DataFrame, live: DataFrame, aliases: DataFrame) -> DataFrame:
    """(historico_id, gbfs_id) where the alias points to a known live station."""
    one = aliases.groupBy("historico_id").agg(F.max("gbfs_id").alias("gbfs_id"))
    known = one.join(live.select("gbfs_id"), "gbfs_id", "left_semi")
    return hist.select("historico_id").join(known, "historico_id").select("historico_id", "gbfs_id")


def exact_id_matches(hist: DataFrame, live: DataFrame) -> DataFrame:
    return hist.select("historico_id").join(
        live.select(F.col("gbfs_id").alias("historico_id"), "gbfs_id"), "historico_id"
    )


def live_names(live: DataFrame) -> DataFrame:
    """One row per normalized live name: the id it stands for (the last one) and its rank (the first one)."""
    keyed = live.select(normalize_name(F.col("nombre")).alias("name"), "gbfs_id").filter(F.col("name") != "")
    return keyed.groupBy("name").agg(F.max("gbfs_id").alias("gbfs_id"), F.min("gbfs_id").alias("first_id"))


def norm_name_matches(hist: DataFrame, live: DataFrame) -> DataFrame:
    keyed = hist.select("historico_id", normalize_name(F.col("nombre")).alias("name")).filter(F.col("name") != "")
    return keyed.join(live_names(live), "name").select("historico_id", "gbfs_id")


@F.pandas_udf(T.DoubleType())
def _similarity(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right, floors in batches:
        scores = []
        for a, b, floor in zip(left, right, floors, strict=True):
            matcher = SequenceMatcher(None, a, b)
            # cheap upper bounds first: both are never below the ratio
            possible = matcher.real_quick_ratio() >= floor and matcher.quick_ratio() >= floor
            scores.append(matcher.ratio() if possible else 0.0)
        yield pd.Series(scores, dtype="float64")


def _letters_needed(total: Column, floor: float) -> Column:
    """Fewest matched letters of two names of ``total`` letters at a similarity of ``floor``."""
    return F.ceil(F.lit(floor) * total / 2 - F.lit(_EPS))


def _tokens_needed(total: Column, floor: float) -> Column:
    """Fewest shared tokens of two such names.

    M matched letters out of T lie in at most 1 + (T - 2M) runs, so besides the M letters the names share
    at least 3M - 1 - T letter pairs.
    """
    matched = _letters_needed(total, floor)
    return matched + F.greatest(3 * matched - 1 - total, F.lit(0))


def _tokens(names: DataFrame) -> DataFrame:
    """Letters and letter pairs of each name, numbered so that repeated ones are different tokens."""
    letters = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, 1))
    pairs = F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring("name", i, 2))
    grams = F.when(F.length("name") > 1, F.concat(letters, pairs)).otherwise(letters)
    ordered = names.withColumn("_grams", F.array_sort(grams))
    numbered = F.transform(
        "_grams", lambda g, i: F.concat(g, F.lit("#"), (i + 1 - F.array_position(F.col("_grams"), g)).cast("string"))
    )
    return ordered.select("name", F.explode(numbered).alias("token"))


def _rarest_tokens(tokens: DataFrame, frequency: DataFrame, floor: float) -> DataFrame:
    """The rarest tokens of each name, as many as needed to share one with every similar-enough name.

    Leaving out fewer tokens than two similar names must share cannot lose a partner. ``left`` counts the
    tokens of the name that are more frequent than this one.
    """
    ranked = (
        tokens.join(frequency, "token", "left")
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("ranked"))
    )
    own = F.length("name")
    shortest = F.greatest(F.ceil(own * F.lit(floor / (2 - floor)) - F.lit(_EPS)), F.lit(1))
    longest = F.floor(own * F.lit((2 - floor) / floor) + F.lit(_EPS))

    def shared(other: Column) -> Column:
        return F.when(_letters_needed(own + other, floor) <= F.least(own, other), _tokens_needed(own + other, floor))

    needed = F.greatest(F.array_min(F.transform(F.sequence(shortest, longest), shared)), F.lit(1))
    size = F.greatest(F.size("ranked") - needed + 1, F.lit(1)).cast("int")
    rarest = F.posexplode(F.slice("ranked", F.lit(1), size)).alias("pos", "t")
    return ranked.select("name", F.size("ranked").alias("total"), rarest).select(
        "name", "t.token", (F.col("total") - F.col("pos") - 1).alias("left")
    )


def similar_names(hist_names: DataFrame, names: DataFrame, floor: float = MIN_NAME_SIMILARITY) -> DataFrame:
    """(name, gbfs_id, sim): best live name per historical name, at least ``floor`` similar.

    An equi join on the rarest tokens of both sides proposes candidates, losing none; only those are scored. Ties go to the live name that comes first.
    """
    left, right = hist_names.select("name").distinct(), names.select("name")
    right_tokens = _tokens(right)
    frequency = right_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    left_keys = _rarest_tokens(_tokens(left), frequency, floor)
    right_keys = _rarest_tokens(right_tokens, frequency, floor).select(
        "token", F.col("name").alias("live_name"), F.col("left").alias("live_left")
    )
    total = F.length("name") + F.length("live_name")
    fits = _letters_needed(total, floor) <= F.least(F.length("name"), F.length("live_name"))
    # At the rarest token two names share, what follows must still hold all they need to share. Frequent
    # tokens rank last, where little follows: a token common to most names proposes next to nothing.
    enough = _tokens_needed(total, floor) <= 1 + F.least("left", "live_left")
    candidates = left_keys.join(right_keys, "token").filter(fits & enough).select("name", "live_name").distinct()
    scored = candidates.withColumn("sim", _similarity(F.col("name"), F.col("live_name"), F.lit(float(floor))))
    close = scored.filter(F.col("sim") >= F.lit(float(floor))).join(
        names.select(F.col("name").alias("live_name"), "gbfs_id", "first_id"), "live_name"
    )
    best = close.groupBy("name").agg(F.min_by(F.struct("gbfs_id", "sim"), F.struct(-F.col("sim"), "first_id")).alias("m"))
    return best.select("name", "m.gbfs_id", "m.sim")


def fuzzy_name_matches(hist: DataFrame, live: DataFrame, floor: float = MIN_NAME_SIMILARITY) -> DataFrame:
    keyed = hist.select("historico_id", normalize_name(F.col("nombre")).alias("name")).filter(F.col("name") != "")
    found = similar_names(keyed, live_names(live), floor)
    return keyed.join(found, "name").select("historico_id", "gbfs_id", S.half_even(F.col("sim"), 3).alias("confidence"))


def nearest_points(points: DataFrame, live: DataFrame, max_dist: float = MAX_MATCH_DISTANCE_M) -> DataFrame:
    """(lat, lon, gbfs_id, dist): nearest live station per distinct point within ``max_dist`` metres.

    Equal coordinates are one point on either side, so copies of a place never multiply.
    """
    left = points.select("lat", "lon").distinct()
    right = (
        live.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
        .agg(F.min("gbfs_id").alias("gbfs_id"))
    )
    near = pairs_within(left, right, max_dist)
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("dist", "gbfs_id")).alias("m"))
    return best.select("lat", "lon", "m.gbfs_id", "m.dist")


def geo_confidence(dist: Column, max_dist: float) -> Column:
    return S.half_even(F.greatest(F.lit(0.0), 1 - dist / F.lit(float(max_dist))), 3)


def geo_matches(hist: DataFrame, live: DataFrame, max_dist: float = MAX_MATCH_DISTANCE_M) -> DataFrame:
    found = nearest_points(hist, live, max_dist)
    return hist.select("historico_id", "lat", "lon").join(found, ["lat", "lon"]).select(
        "historico_id",
        "gbfs_id",
        geo_confidence(F.col("dist"), max_dist).alias("confidence"),
        S.half_even(F.col("dist"), 1).alias("distance_m"),
    )


def nearest_station(points: DataFrame, candidates: DataFrame, first_m: float = 2000.0) -> DataFrame:
    """Closest candidate (``gbfs_id, lat, lon``) of each ``point_id`` with coordinates, however far away it is.

    The search goes outwards: a hit within the radius is final, and only points without one are looked at again
    with four times the radius, until it spans the globe.
    """
    left = cut_lineage(points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct())
    found, radius = None, float(first_m)
    while True:
        hits = cut_lineage(nearest_points(left, candidates, min(radius, HALF_GLOBE_M)))
        found = hits if found is None else found.unionByName(hits)
        left = cut_lineage(left.join(hits, ["lat", "lon"], "left_anti"))
        if radius >= HALF_GLOBE_M or left.isEmpty():
            return points.select("point_id", "lat", "lon").join(found, ["lat", "lon"]).select("point_id", "gbfs_id", "dist")
        radius *= 4


# --- the cascade -------------------------------------------------------------------------------


def _spread(key: Column) -> Column:
    """Join key that spreads rows without a key instead of sending them all to one task."""
    return F.coalesce(key, F.concat(F.lit("\u0001"), F.col("historico_id")))


def match_stations(
    hist: DataFrame,
    live: DataFrame,
    aliases: DataFrame | None = None,
    min_name_similarity: float = MIN_NAME_SIMILARITY,
    max_match_distance_m: float = MAX_MATCH_DISTANCE_M,
) -> DataFrame:
    """The station bridge: every historical row with the first method that matches it.

    Each stage is a lookup joined to the rows. The two costly lookups see only distinct names and points
    of rows that no earlier stage matched.
    """
    none = F.lit(None).cast("string")
    rows = hist.select(
        "historico_id",
        F.col("nombre").alias("nombre_historico"),
        F.col("lat").alias("h_lat"),
        F.col("lon").alias("h_lon"),
        F.nullif(normalize_name(F.col("nombre")), F.lit("")).alias("name"),
    )
    live_ids = live.select(F.col("gbfs_id").alias("historico_id"), F.col("gbfs_id").alias("by_id"))
    rows = rows.join(live_ids, "historico_id", "left")
    if aliases is None:
        rows = rows.withColumn("by_alias", none)
    else:
        rows = rows.join(
            alias_matches(hist, live, aliases).distinct().withColumnRenamed("gbfs_id", "by_alias"), "historico_id", "left"
        )
    names = live_names(live)
    by_name = names.select(F.col("name").alias("_name"), F.col("gbfs_id").alias("by_name"))
    rows = rows.join(by_name, _spread(F.col("name")) == F.col("_name"), "left").drop("_name")

    open_rows = rows.filter(F.coalesce("by_alias", "by_id", "by_name").isNull())
    fuzzy = similar_names(open_rows.filter(F.col("name").isNotNull()), names, min_name_similarity).select(
        F.col("name").alias("_name"), F.col("gbfs_id").alias("by_fuzzy"), "sim"
    )
    rows = rows.join(fuzzy, _spread(F.col("name")) == F.col("_name"), "left").drop("_name")
    points = open_rows.select(F.col("h_lat").alias("lat"), F.col("h_lon").alias("lon"))
    geo = nearest_points(points, live, max_match_distance_m).select(
        F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("gbfs_id").alias("by_geo"), "dist"
    )
    # points as text, so rows without coordinates can be spread too
    place = F.concat_ws("|", "h_lat", "h_lon")
    has_place = F.col("h_lat").isNotNull() & F.col("h_lon").isNotNull()
    geo = geo.select(F.concat_ws("|", "_lat", "_lon").alias("_place"), "by_geo", "dist")
    rows = rows.join(geo, _spread(F.when(has_place, place)) == F.col("_place"), "left").drop("_place")

    known = F.coalesce("by_alias", "by_id", "by_name", "by_fuzzy")
    method = (
        F.when(F.col("by_alias").isNotNull(), "manual_alias")
        .when(F.col("by_id").isNotNull(), "exact_id")
        .when(F.col("by_name").isNotNull(), "norm_name")
        .when(F.col("by_fuzzy").isNotNull(), "fuzzy_name")
        .when(F.col("by_geo").isNotNull(), "geo")
        .otherwise("unmatched")
    )
    matched = rows.withColumns({"gbfs_id": F.coalesce(known, F.col("by_geo")), "match_method": method})
    confidence = (
        F.when(F.col("match_method").isin("manual_alias", "exact_id"), F.lit(1.0))
        .when(F.col("match_method") == "norm_name", F.lit(0.95))
        .when(F.col("match_method") == "fuzzy_name", S.half_even(F.col("sim"), 3))
        .when(F.col("match_method") == "geo", geo_confidence(F.col("dist"), max_match_distance_m))
        .otherwise(F.lit(0.0))
    )
    distance = F.when(F.col("match_method") == "exact_id", F.lit(0.0)).when(
        F.col("match_method") == "geo", S.half_even(F.col("dist"), 1)
    )
    described = live.select(F.col("gbfs_id").alias("_id"), F.col("nombre").alias("nombre_gbfs"), "lat", "lon")
    detailed = matched.join(described, _spread(F.col("gbfs_id")) == F.col("_id"), "left")
    return conform(
        detailed.withColumns(
            {
                "confidence": confidence,
                "distance_m": distance,
                "manual_review": F.col("match_method").isin("fuzzy_name", "geo", "unmatched"),
            }
        ),
        "station_bridge",
    )


# --- coverage ----------------------------------------------------------------------------------


def coverage_by_method(bridge: DataFrame) -> DataFrame:
    return (
        bridge.groupBy(F.col("match_method").alias("metodo"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confianza"))
        .orderBy(F.col("n").desc(), "metodo")
    )


def both_ends(trips: DataFrame, bridge: DataFrame) -> DataFrame:
    """Trips with the live ids of both ends (NULL where unmatched).

    The bridge joins twice; counting trips per pair of ends first keeps the joined rows few.
    """
    flows = trips.groupBy("origin_station_id", "dest_station_id").agg(F.count(F.lit(1)).alias("trips"))
    o = bridge.select(F.col("historico_id").alias("origin_station_id"), F.col("gbfs_id").alias("origin_gbfs_id"))
    d = bridge.select(F.col("historico_id").alias("dest_station_id"), F.col("gbfs_id").alias("dest_gbfs_id"))
    return flows.join(o, "origin_station_id", "left").join(d, "dest_station_id", "left")


def trip_coverage(trips: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row: share of trips with both ends matched."""
    matched = F.col("origin_gbfs_id").isNotNull() & F.col("dest_gbfs_id").isNotNull()
    covered = F.sum(F.when(matched, F.col("trips")).otherwise(F.lit(0)))
    total = F.sum("trips")
    return both_ends(trips, bridge).agg(F.when(total > 0, covered / total).alias("cobertura"))


def bridge_coverage(trips: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row: stations, matched stations, and percentages of stations and trips."""
    stations = bridge.agg(
        F.count(F.lit(1)).alias("estaciones_historicas"), F.count("gbfs_id").alias("estaciones_emparejadas")
    )
    return stations.select(
        "estaciones_historicas",
        "estaciones_emparejadas",
        S.pct(F.col("estaciones_emparejadas"), F.col("estaciones_historicas"), 2).alias("pct_estaciones"),
        F.bround(100 * F.coalesce(trip_coverage(trips, bridge).scalar(), F.lit(0.0)), 2).alias("pct_viajes_cubiertos"),
    )

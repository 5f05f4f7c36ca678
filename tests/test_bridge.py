from __future__ import annotations

import math
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pedalflow.functions.geo import EARTH_RADIUS_M
from pedalflow.operators import bridge as B

HIST = "historico_id string, nombre string, lat double, lon double"
LIVE = "gbfs_id string, nombre string, lat double, lon double"


@pytest.fixture(scope="module")
def live(spark):
    return spark.createDataFrame(
        [("1", "Reforma Insurgentes", 19.427, -99.167), ("2", "Metro Balderas", 19.427, -99.145), ("3", "Parque Mexico", 19.412, -99.170)],
        LIVE,
    )


def one(spark, live, row, **kw):
    return B.match_stations(spark.createDataFrame([row], HIST), live, **kw).first()


def test_each_method(spark, live):
    assert tuple(one(spark, live, ("2", None, None, None)))[:2] == ("2", "2")
    found = one(spark, live, ("99", "MÉTRO  Balderas", None, None))
    assert (found["match_method"], found["gbfs_id"], found["confidence"]) == ("norm_name", "2", 0.95)
    found = one(spark, live, ("98", "Reforma Insurgentez", None, None), min_name_similarity=0.8)
    assert (found["match_method"], found["gbfs_id"], found["manual_review"]) == ("fuzzy_name", "1", True)
    found = one(spark, live, ("97", None, 19.4121, -99.1701), max_match_distance_m=200.0)
    assert (found["match_method"], found["gbfs_id"]) == ("geo", "3") and found["distance_m"] < 200
    found = one(spark, live, ("500", "Estación Fantasma", None, None))
    assert (found["match_method"], found["gbfs_id"], found["confidence"]) == ("unmatched", None, 0.0)


def test_alias_comes_first_and_needs_a_known_target(spark, live):
    aliases = spark.createDataFrame([("1", "3"), ("2", "nowhere")], "historico_id string, gbfs_id string")
    assert one(spark, live, ("1", None, None, None), aliases=aliases)["match_method"] == "manual_alias"
    assert one(spark, live, ("2", None, None, None), aliases=aliases)["match_method"] == "exact_id"


def test_every_row_stays_and_geo_follows_a_failed_name(spark, live):
    hist = spark.createDataFrame([("a", "xyz", 19.412, -99.17), ("a", None, None, None), ("b", None, None, None)], HIST)
    got = sorted((r["historico_id"], r["match_method"]) for r in B.match_stations(hist, live).collect())
    assert got == [("a", "geo"), ("a", "unmatched"), ("b", "unmatched")]


def brute_names(left, right, floor):
    best = {}
    for a in left:
        found, top = None, 0.0
        for b in sorted(right):
            sim = SequenceMatcher(None, a, b).ratio()
            if sim > top:
                found, top = b, sim
        if found is not None and top >= floor:
            best[a] = (found, top)
    return best


words = st.text(alphabet="abc1 ", min_size=1, max_size=14).map(lambda s: " ".join(s.split())).filter(bool)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(words, min_size=1, max_size=25), st.sets(words, min_size=1, max_size=25), st.sampled_from([0.5, 0.66, 0.8, 0.82, 0.9]))
def test_similar_names_lose_nothing(spark, left, right, floor):
    ids = {name: f"{i:04d}" for i, name in enumerate(sorted(right))}
    hist = spark.createDataFrame([(n,) for n in left], "name string")
    names = spark.createDataFrame([(n, i, i) for n, i in ids.items()], "name string, gbfs_id string, first_id string")
    got = {r["name"]: (r["gbfs_id"], r["sim"]) for r in B.similar_names(hist, names, floor).collect()}
    assert got == {a: (ids[b], sim) for a, (b, sim) in brute_names(left, right, floor).items()}


def test_similar_names_on_near_copies(spark):
    rng = random.Random(7)
    base = ["estacion " + "".join(rng.choices("abcdefghij ", k=rng.randint(4, 24))).strip() for _ in range(60)]
    base = sorted({" ".join(b.split()) for b in base})
    noisy = set()
    for name in base:
        letters = list(name)
        for _ in range(rng.randint(0, 4)):
            letters[rng.randrange(len(letters))] = rng.choice("xyz ")
        noisy.add(" ".join("".join(letters).split()))
    ids = {name: f"{i:04d}" for i, name in enumerate(base)}
    hist = spark.createDataFrame([(n,) for n in noisy], "name string")
    names = spark.createDataFrame([(n, i, i) for n, i in ids.items()], "name string, gbfs_id string, first_id string")
    got = {r["name"]: (r["gbfs_id"], r["sim"]) for r in B.similar_names(hist, names).collect()}
    want = {a: (ids[b], sim) for a, (b, sim) in brute_names(noisy, base, 0.82).items()}
    assert got == want and len(want) > 20


def metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(x))


@pytest.mark.parametrize("origin", [(19.4, -99.1), (0.0, 0.0), (-33.4, -70.6), (64.1, -21.9), (-16.5, 180.0), (88.9, 0.0)])
@pytest.mark.parametrize("radius", [120.0, 1500.0])
def test_nearest_points_equal_brute_force(spark, origin, radius):
    rng = random.Random(3)

    def point():
        return origin[0] + rng.uniform(-0.02, 0.02), (origin[1] + rng.uniform(-0.04, 0.04) + 180) % 360 - 180

    points, places = [point() for _ in range(150)], [point() for _ in range(150)]
    got = {
        (r["lat"], r["lon"]): r["gbfs_id"]
        for r in B.nearest_points(
            spark.createDataFrame(points, "lat double, lon double"),
            spark.createDataFrame([(f"{i:04d}", *p) for i, p in enumerate(places)], "gbfs_id string, lat double, lon double"),
            radius,
        ).collect()
    }
    want = {}
    for p in points:
        i = min(range(len(places)), key=lambda i: metres(p, places[i]))
        if metres(p, places[i]) <= radius:
            want[p] = f"{i:04d}"
    assert got == want


def test_nearest_station_has_no_limit(spark):
    rng = random.Random(5)
    points = [(str(i), rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [("near", 10.0, 20.0), ("none", None, 3.0)]
    places = [(f"{i:04d}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(12)] + [("here", 10.001, 20.0)]
    found = B.nearest_station(
        spark.createDataFrame(points, "point_id string, lat double, lon double"),
        spark.createDataFrame(places, "gbfs_id string, lat double, lon double"),
    )
    want = {p[0]: min(places, key=lambda c: metres(p[1:], c[1:]))[0] for p in points if p[1] is not None}
    assert {r["point_id"]: r["gbfs_id"] for r in found.collect()} == want


def test_coverage(spark):
    bridge = spark.createDataFrame([("1", "1", "exact_id", 1.0), ("2", None, "unmatched", 0.0)], "historico_id string, gbfs_id string, match_method string, confidence double")
    trips = spark.createDataFrame([("1", "1"), ("1", "2"), ("1", "1"), ("3", "1")], "origin_station_id string, dest_station_id string")
    row = B.bridge_coverage(trips, bridge).first()
    assert tuple(row) == (2, 1, 50.0, 50.0)

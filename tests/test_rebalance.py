from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pedalflow.operators import rebalance as R
from tests.test_bridge import metres

STATIONS = "target_ts string, station_id string, capacity int, expected_inventory double, lat double, lon double"


def line(stock, cap=20, spread=0.001, window="w"):
    return [(window, f"{i:03d}", cap, float(v), 19.4 + i * spread, -99.1) for i, v in enumerate(stock)]


def plan(spark, rows, **kw):
    moves, summary = R.recommend_moves(spark.createDataFrame(rows, STATIONS), **kw)
    return moves.collect(), {r["target_ts"]: r for r in summary.collect()}


def greedy(rows, safety=0.15, fill=0.5, reach=1500.0, load=20):
    """The sequential rule: the neediest receiver first, always from its nearest donor."""
    s = []
    for _, sid, cap, expected, lat, lon in rows:
        inv = min(max(expected, 0.0), cap)
        low, goal = float(round(safety * cap)), float(round(fill * cap))
        s.append(
            {"id": sid, "cap": cap, "inv": inv, "deficit": max(low - inv, 0.0), "need": round(max(goal - inv, 0.0)), "avail": math.floor(max(inv - goal, 0.0)), "at": (lat, lon)}
        )
    out = []
    for r in sorted((x for x in s if x["deficit"] > 0), key=lambda x: (-x["deficit"], x["id"])):
        while r["need"] > 0:
            near = [(metres(r["at"], d["at"]), d["id"], d) for d in s if d is not r and d["avail"] > 0]
            near = [n for n in near if n[0] <= reach]
            if not near:
                break
            _, _, d = min(near, key=lambda n: n[:2])
            qty = min(r["need"], d["avail"], load, int(r["cap"] - r["inv"]))
            if qty <= 0:
                break
            d["inv"], r["inv"] = d["inv"] - qty, r["inv"] + qty
            d["avail"], r["need"] = d["avail"] - qty, r["need"] - qty
            out.append((d["id"], r["id"], qty, d["inv"] + qty, d["inv"], r["inv"] - qty, r["inv"]))
    return sorted(out)


def shape(moves, window="w"):
    return sorted(
        (
            m["donor_station_id"], m["receiver_station_id"], m["bikes_to_move"], m["donor_inventory_before"], m["donor_inventory_after"],
            m["receiver_inventory_before"], m["receiver_inventory_after"],
        )
        for m in moves
        if m["target_ts"] == window
    )


def test_captures_are_ranked_in_ranges(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), f"c{i}", start + dt.timedelta(minutes=5 * rng.randrange(-400, 400))) for i in range(500)] + [(None, "x", start), ("a", "none", None)]
    table = spark.createDataFrame(rows, "station_id string, capture_id string, captured_at_local timestamp_ntz")
    got = {(r["station_id"], r["capture_id"]): r["rn"] for r in R.nearest_ranks(table, F.lit(start)).collect()}
    want = {}
    for station in ("a", "b", None):
        own = sorted((abs((t - start).total_seconds()), t, c) for s, c, t in rows if s == station and t is not None)
        want.update({(station, c): i for i, (_, _, c) in enumerate(own, 1)})
    assert got == want


def test_settled_windows_leave_the_rounds(spark):
    rng = random.Random(4)
    rows = [r for k in range(6) for r in line([rng.choice([0, 1, 2, 19, 20]) for _ in range(3 + 7 * k)], window=f"w{k}")]
    state = R.balance_state(spark.createDataFrame(rows, STATIONS))
    left = []
    whole = R.allocate(R.candidate_pairs(state), on_round=left.append).collect()
    pairs = R.candidate_pairs(state).count()
    assert left[-1] == 0 and left == sorted(left, reverse=True) and 0 < min(left[:-1]) < pairs
    for k in range(6):
        alone = R.allocate(R.candidate_pairs(state).filter(f"target_ts = 'w{k}'")).collect()
        pick = lambda rs: sorted((r["receiver"], r["donor"], r["qty"]) for r in rs if r["target_ts"] == f"w{k}")  # noqa: E731, B023
        assert pick(whole) == pick(alone)


def test_moves_from_donor_to_receiver(spark):
    moves, summary = plan(spark, line([0, 20]))
    assert [(m["donor_station_id"], m["receiver_station_id"], m["bikes_to_move"]) for m in moves] == [("001", "000", 10)]
    assert moves[0]["receiver_deficit_before"] == 3.0 and moves[0]["receiver_deficit_after"] == 0.0
    s = summary["w"]
    assert (s["movimientos"], s["bicis_movidas"], s["receptoras"], s["donantes_disponibles"]) == (1, 10, 1, 1)
    assert s["inventario_conservado"] and s["pct_desabasto_evitado"] == 100.0


def test_no_donors_no_moves(spark):
    moves, summary = plan(spark, line([0, 1, 2]))
    assert moves == [] and summary["w"]["movimientos"] == 0 and summary["w"]["donantes_disponibles"] == 0


def test_distance_limit(spark):
    moves, _ = plan(spark, line([0, 20], spread=0.5), max_pair_distance_m=1500.0)
    assert moves == []


def test_negative_stock_counts_as_empty(spark):
    moves, _ = plan(spark, line([-5, 20]))
    assert moves[0]["receiver_inventory_before"] == 0.0


def test_safety_must_not_exceed_target(spark):
    with pytest.raises(ValueError):
        R.balance_state(spark.createDataFrame(line([0]), STATIONS), 0.6, 0.5)


def test_stations_without_capacity_or_place_are_left_out(spark):
    rows = [("w", "a", None, 1.0, 19.4, -99.1), ("w", "b", 20, 0.0, None, None), ("w", "c", 20, 20.0, 19.4, -99.1)]
    moves, summary = plan(spark, rows)
    assert moves == [] and summary["w"]["estaciones"] == 2


def test_large_moves_are_split(spark):
    moves, _ = plan(spark, line([0, 100], cap=100), max_bikes_per_move=20)
    assert sorted(m["bikes_to_move"] for m in moves) == [10, 20, 20]
    assert shape(moves) == greedy(line([0, 100], cap=100))


station = st.tuples(st.integers(4, 40), st.floats(-3, 45).map(lambda x: round(x, 1)), st.integers(0, 12), st.integers(0, 12))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(station, min_size=2, max_size=25), min_size=1, max_size=4), st.sampled_from([3, 20]), st.sampled_from([0.5, 0.95]))
def test_rounds_equal_the_sequential_rule(spark, windows, load, fill):
    rng = random.Random(1)
    rows = {}
    for w, stations in enumerate(windows):
        rows[f"w{w}"] = [
            (f"w{w}", f"{i:03d}", cap, stock, 19.4 + y * 0.002 + rng.random() * 1e-4, -99.1 + x * 0.002 + rng.random() * 1e-4)
            for i, (cap, stock, y, x) in enumerate(stations)
        ]
    moves, summary = plan(spark, [r for w in rows.values() for r in w], max_bikes_per_move=load, target_fill_fraction=fill)
    for name, window in rows.items():
        got, want = shape(moves, name), greedy(window, load=load, fill=fill)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[3:] == pytest.approx(w[3:])
        capacity = {r[1]: r[2] for r in window}
        assert all(g[2] > 0 and g[6] <= capacity[g[1]] + 1e-9 for g in got)
        assert summary[name]["inventario_conservado"]
        assert summary[name]["bicis_movidas"] == sum(w[2] for w in want)


def captures(spark, rows):
    return spark.createDataFrame(rows, "station_id string, t string, num_bikes_available int, capture_id string").selectExpr(
        "station_id", "cast(t as timestamp_ntz) AS captured_at_local", "num_bikes_available", "capture_id"
    )


def test_nearest_capture_prefers_the_earlier_of_equals(spark):
    from pyspark.sql import functions as F

    status = captures(
        spark,
        [("1", "2024-01-01 17:50:00", 3, "a"), ("1", "2024-01-01 18:10:00", 9, "b"), ("2", "2024-01-03 00:00:00", 7, "c"), ("2", "2024-01-01 03:00:00", 5, "d")],
    )
    target = F.lit("2024-01-01 18:00:00").cast("timestamp_ntz")
    one = {r["station_id"]: r["current_inv"] for r in R.nearest_capture(status, target).collect()}
    many = {r["station_id"]: r["current_inv"] for r in R.nearest_captures(status, F.array(target)).collect()}
    assert one == many == {"1": 3.0, "2": 5.0}


def test_nearest_captures_equal_one_by_one(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(str(rng.randint(1, 4)), f"2024-01-{rng.randint(1, 9):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00", i, f"{i:04d}") for i in range(150)]
    status = captures(spark, rows)
    times = [f"2024-01-{d:02d} {h:02d}:{m:02d}:00" for d in (1, 4, 5, 12) for h, m in ((0, 0), (9, 37), (18, 0))]
    lits = [F.lit(t).cast("timestamp_ntz") for t in times]
    many = {(r["station_id"], str(r["target_ts"])): r["current_inv"] for r in R.nearest_captures(status, F.array(*lits)).collect()}
    for t, lit in zip(times[:6], lits[:6], strict=True):
        for r in R.nearest_capture(status, lit).collect():
            assert many[r["station_id"], t] == r["current_inv"]
    assert len(many) == 4 * len(times)


def test_pairs_are_written_once_a_cut(spark, monkeypatch):
    cuts, left = [], []

    def cut(df):
        cuts.append(df.columns)
        return cut_lineage(df)

    cut_lineage = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", cut)
    rows = [("w", f"r{i}", f"d{j}", float(abs(i - j)), float(20 - i), 6, 3) for i in range(9) for j in range(9)]
    pairs = spark.createDataFrame(rows, "target_ts string, receiver string, donor string, dist double, deficit_before double, need int, avail int")
    granted = R.allocate(pairs, on_round=left.append)
    assert granted.agg(F.sum("qty")).first()[0] == 27 and left[-1] == 0
    assert sum("cap" in columns for columns in cuts) == 1 + len(left)

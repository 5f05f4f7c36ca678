"""The same questions in plain SQL over the given tables, to check every query against another engine."""

from __future__ import annotations

import re

# Shared derived tables, by name. A query pulls in the ones it mentions, and theirs.
TABLES: dict[str, str] = {}
SQL: dict[str, str] = {}

TABLES["fx_nst"] = "SELECT max(user_id) // 5 + 1 AS n FROM events"

TABLES["fx_events"] = """
SELECT *, user_id // 5 AS num, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS arr_ts,
       CAST((user_id * 7 + event_id) % (SELECT n FROM fx_nst) AS VARCHAR) AS dest
FROM events"""


def _date_text(ts: str) -> str:
    return (
        f"CASE WHEN event_id % 3 = 0 THEN strftime({ts}, '%Y-%m-%d') "
        f"WHEN event_id % 7 = 0 THEN strftime({ts}, '%d-%m-%Y') ELSE strftime({ts}, '%d/%m/%Y') END"
    )


def _time_text(ts: str) -> str:
    return (
        f"CASE WHEN event_id % 4 = 0 THEN strftime({ts}, '%H:%M:%S.%f') "
        f"WHEN event_id % 4 = 1 THEN strftime({ts}, '%H:%M') ELSE strftime({ts}, '%H:%M:%S') END"
    )


TABLES["fx_copies"] = """
SELECT e.*, c.copy_no, CASE WHEN event_id % 107 = 0 THEN ts ELSE arr_ts END AS arr
FROM fx_events e JOIN (SELECT 0 AS copy_no UNION ALL SELECT 1) c ON c.copy_no = 0 OR event_id % 50 = 0"""

TABLES["fx_raw"] = f"""
SELECT event_id, copy_no,
       CASE WHEN copy_no = 1 THEN 'O' WHEN event_id % 2 = 0 THEN 'M' ELSE 'F' END AS genero_usuario,
       CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 11 = 0 THEN (16 + event_id % 60) || '.5'
            ELSE (16 + event_id % 60) || '.0' END AS edad_usuario,
       CASE WHEN event_id % 109 = 0 THEN 'NaN' ELSE CAST(event_id % 9000 AS VARCHAR) END AS bici,
       CASE WHEN event_id % 97 = 0 THEN '' ELSE CAST(num AS VARCHAR) END AS ciclo_estacion_retiro,
       CASE WHEN event_id % 103 = 0 THEN 'fecha-mala' ELSE {_date_text("ts")} END AS fecha_retiro,
       {_time_text("ts")} AS hora_retiro,
       CASE WHEN event_id % 101 = 0 THEN ' ' ELSE dest END AS ciclo_estacion_arribo,
       {_date_text("arr")} AS fecha_arribo,
       {_time_text("arr")} AS hora_arribo,
       strftime(ts, 'viajes_%Y-%m-%d.csv') AS source_file
FROM fx_copies"""

_FORMATS = "[" + ", ".join(
    f"'{d} {t}'" for d in ("%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y") for t in ("%H:%M:%S", "%H:%M", "%H:%M:%S.%f")
) + "]"
_KEYS = "bici, ciclo_estacion_retiro, fecha_retiro, hora_retiro, ciclo_estacion_arribo, fecha_arribo, hora_arribo"


def _clean(c: str) -> str:
    return f"CASE WHEN lower(trim({c}, ' \t\n')) NOT IN ('', 'nan', 'null', 'none') THEN trim({c}, ' \t\n') END"


_HASH = f"sha256(concat_ws(chr(31), {_KEYS}, source_file))"
_AGE = (
    "CASE WHEN isnan(try_cast(edad_usuario AS DOUBLE)) THEN NULL "
    "ELSE CAST(round_even(try_cast(edad_usuario AS DOUBLE), 0) AS INTEGER) END"
)

TABLES["fx_typed"] = f"""
SELECT *, {_HASH} AS trip_id, {_clean("bici")} AS bike_id,
       {_clean("ciclo_estacion_retiro")} AS origin_station_id, {_clean("ciclo_estacion_arribo")} AS dest_station_id,
       try_strptime(fecha_retiro || ' ' || hora_retiro, {_FORMATS}) AS retiro_ts,
       try_strptime(fecha_arribo || ' ' || hora_arribo, {_FORMATS}) AS arribo_ts,
       row_number() OVER (PARTITION BY source_file, {_KEYS} ORDER BY event_id, copy_no) > 1 AS is_duplicate
FROM fx_raw"""

TABLES["fx_classified"] = """
SELECT *, (epoch_us(arribo_ts) - epoch_us(retiro_ts)) / 60e6 AS duration_min,
       CASE WHEN is_duplicate THEN 'duplicado'
            WHEN retiro_ts IS NULL OR arribo_ts IS NULL THEN 'fecha_hora_invalida'
            WHEN origin_station_id IS NULL THEN 'estacion_origen_ausente'
            WHEN dest_station_id IS NULL THEN 'estacion_destino_ausente'
            WHEN arribo_ts <= retiro_ts THEN 'arribo_no_posterior'
            WHEN (epoch_us(arribo_ts) - epoch_us(retiro_ts)) / 60e6 < 1 THEN 'duracion_muy_corta'
            WHEN (epoch_us(arribo_ts) - epoch_us(retiro_ts)) / 60e6 > 240 THEN 'duracion_muy_larga'
            WHEN bike_id IS NULL THEN 'bici_ausente' END AS reason
FROM fx_typed"""

TABLES["fx_clean"] = f"""
SELECT trip_id, bike_id, origin_station_id, dest_station_id, retiro_ts, arribo_ts, duration_min,
       genero_usuario AS genero, {_AGE} AS edad, source_file
FROM fx_classified WHERE reason IS NULL"""

TABLES["fx_trips"] = """
SELECT CAST(event_id AS VARCHAR) AS trip_id, CAST(event_id % 9000 AS VARCHAR) AS bike_id,
       CAST(num AS VARCHAR) AS origin_station_id, dest AS dest_station_id, ts AS retiro_ts, arr_ts AS arribo_ts
FROM fx_events WHERE (epoch_us(arr_ts) - epoch_us(ts)) / 60e6 BETWEEN 1 AND 240"""

TABLES["fx_ends"] = """
SELECT e.station AS station_id, CAST(e.at AS DATE) AS "date", CAST(hour(e.at) AS INTEGER) AS "hour", e.leaves
FROM (SELECT unnest([{'station': origin_station_id, 'at': retiro_ts, 'leaves': true},
                     {'station': dest_station_id, 'at': arribo_ts, 'leaves': false}]) AS e FROM fx_trips)"""
TABLES["fx_out"] = 'SELECT station_id, "date", "hour", count(*) AS salidas FROM fx_ends WHERE leaves GROUP BY ALL'
TABLES["fx_in"] = 'SELECT station_id, "date", "hour", count(*) AS llegadas FROM fx_ends WHERE NOT leaves GROUP BY ALL'
TABLES["fx_keys"] = 'SELECT DISTINCT station_id, "date", "hour" FROM fx_ends'
TABLES["fx_demand"] = """
SELECT station_id, "date", "hour", CAST(isodow("date") - 1 AS INTEGER) AS dow,
       count(*) FILTER (WHERE leaves) AS salidas, count(*) FILTER (WHERE NOT leaves) AS llegadas,
       CAST(sum(CASE WHEN leaves THEN -1 ELSE 1 END) AS BIGINT) AS flujo_neto, count(*) FILTER (WHERE leaves) AS demanda_atendida
FROM fx_ends GROUP BY station_id, "date", "hour\""""

TABLES["fx_info"] = """
SELECT CASE WHEN num % 10 = 7 THEN 'L' || num ELSE CAST(num AS VARCHAR) END AS station_id, 'Estación ' || num AS name,
       19.40::DOUBLE + (num % 8) * 0.004::DOUBLE AS lat, -99.17::DOUBLE + (num // 8) * 0.004::DOUBLE AS lon,
       CAST(15 + num % 25 + CASE WHEN c_custkey % 50 >= 40 THEN 1 ELSE 0 END AS INTEGER) AS capacity,
       CAST(c_nationkey AS VARCHAR) AS region_id, c_name AS short_name,
       TIMESTAMP '2024-01-01' + to_hours(c_custkey) AS captured_at_utc
FROM (SELECT *, c_custkey // 50 AS num FROM customer)"""
TABLES["fx_info_last"] = """
SELECT * FROM fx_info QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY captured_at_utc DESC) = 1"""

TABLES["fx_captures"] = """
SELECT event_id, CASE WHEN num % 10 = 7 THEN 'L' || num ELSE CAST(num AS VARCHAR) END AS station_id,
       CASE WHEN event_id % 211 = 0 THEN -1 ELSE k % 30 END AS num_bikes_available, 29 - k % 30 AS num_docks_available,
       true AS is_installed, event_id % 13 <> 0 AS is_renting, event_id % 17 <> 0 AS is_returning,
       CAST(floor(epoch(ts)) AS BIGINT) AS last_reported, ts AS captured_at_utc,
       ts - INTERVAL 6 HOUR AS captured_at_local, event_id // 10 AS doc_id
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM fx_events)"""
TABLES["fx_status"] = """
SELECT * REPLACE (CASE WHEN num_bikes_available >= 0 THEN num_bikes_available END AS num_bikes_available),
       station_id || '|' || last_reported AS capture_id, 'r' || (event_id % 3) AS run_id
FROM fx_captures"""
TABLES["fx_avail"] = """
SELECT station_id, "date", "hour", bikes[1] AS bikes_start, bikes[-1] AS bikes_end, list_min(bikes) AS bikes_min, list_max(bikes) AS bikes_max,
       5.0::DOUBLE * coalesce(len(list_filter(bikes, lambda n: n = 0)), 0) AS minutes_zero_bikes,
       5.0::DOUBLE * coalesce(len(list_filter(docks, lambda n: n = 0)), 0) AS minutes_zero_docks,
       list_contains(bikes, 0) AS empty_flag, list_contains(docks, 0) AS full_flag, n_captures
FROM (SELECT station_id, captured_at_local::DATE AS "date", CAST(date_part('hour', captured_at_local) AS INTEGER) AS "hour", count(*) AS n_captures,
             list(num_bikes_available ORDER BY captured_at_local) FILTER (WHERE num_bikes_available IS NOT NULL) AS bikes,
             list(num_docks_available) FILTER (WHERE num_docks_available IS NOT NULL) AS docks
      FROM fx_status GROUP BY 1, 2, 3)"""

TABLES["fx_bridge"] = """
SELECT CAST(num AS VARCHAR) AS historico_id,
       CASE num % 10 WHEN 9 THEN NULL WHEN 5 THEN CAST(num - 1 AS VARCHAR) WHEN 7 THEN 'L' || num ELSE CAST(num AS VARCHAR) END AS gbfs_id,
       CASE num % 10 WHEN 9 THEN 'unmatched' WHEN 5 THEN 'manual_alias' WHEN 7 THEN 'norm_name' ELSE 'exact_id' END AS match_method,
       CASE num % 10 WHEN 9 THEN 0.0::DOUBLE WHEN 7 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS confidence
FROM (SELECT DISTINCT c_custkey // 50 AS num FROM customer)"""

# --- identity catalogues

TABLES["fx_live_cat"] = """
SELECT CAST(num AS VARCHAR) AS gbfs_id, p_name AS nombre, 19.40::DOUBLE + (num % 8) * 0.004::DOUBLE AS lat,
       -99.17::DOUBLE + (num // 8) * 0.004::DOUBLE AS lon
FROM (SELECT p_name, min(p_partkey) AS num FROM part GROUP BY p_name)"""
TABLES["fx_hist_cat"] = """
SELECT CAST(p_partkey AS VARCHAR) AS historico_id,
       CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 's' WHEN 2 THEN NULL ELSE 'zz ' || p_brand END AS nombre,
       CASE WHEN p_partkey % 4 = 2 THEN 19.4003::DOUBLE + (p_partkey % 8) * 0.004::DOUBLE END AS lat,
       CASE WHEN p_partkey % 4 = 2 THEN -99.1698::DOUBLE + (p_partkey % 5) * 0.004::DOUBLE END AS lon
FROM part"""
TABLES["fx_aliases"] = """
SELECT CAST(p_partkey AS VARCHAR) AS historico_id, l.gbfs_id
FROM part p JOIN fx_live_cat l ON l.nombre = p.p_name WHERE p_brand = 'Brand#7'"""


def _name_key(c: str) -> str:
    ascii_only = f"regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(lower({ascii_only}), '[^a-z0-9]+', ' ', 'g'))"


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))"
    )


TABLES["fx_near"] = f"""
SELECT h.historico_id, l.gbfs_id, {_haversine("h.lat", "h.lon", "l.lat", "l.lon")} AS dist
FROM fx_hist_cat h JOIN fx_live_cat l ON h.lat IS NOT NULL AND h.lon IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY h.historico_id ORDER BY dist, l.gbfs_id) = 1"""

# --- features and predictions

TABLES["fx_dts"] = """
SELECT station_id, CAST("date" AS TIMESTAMP) + to_hours("hour") AS ts, CAST(salidas AS DOUBLE) AS salidas,
       CAST(llegadas AS DOUBLE) AS llegadas, CAST(flujo_neto AS DOUBLE) AS flujo_neto FROM fx_demand"""
TABLES["fx_grid"] = """
SELECT s.station_id, h.ts FROM (SELECT DISTINCT station_id FROM fx_dts) s,
       (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM fx_dts) h"""
TABLES["fx_dense"] = """
SELECT g.station_id, g.ts, coalesce(d.salidas, 0) AS salidas, coalesce(d.llegadas, 0) AS llegadas,
       coalesce(d.flujo_neto, 0) AS flujo_neto
FROM fx_grid g LEFT JOIN fx_dts d USING (station_id, ts)"""
TABLES["fx_meta"] = """
SELECT b.historico_id AS station_id, i.capacity, i.lat, i.lon
FROM fx_bridge b LEFT JOIN fx_info_last i ON b.gbfs_id = i.station_id"""
TABLES["fx_avail_ts"] = """
SELECT b.historico_id AS station_id, CAST(a."date" AS TIMESTAMP) + to_hours(a."hour") AS ts, CAST(a.bikes_end AS DOUBLE) AS bikes_end
FROM fx_avail a JOIN fx_bridge b ON b.gbfs_id = a.station_id"""
TABLES["fx_lagged"] = """
SELECT d.*, lag(a.bikes_end) OVER w AS bikes_end_lag_1, lag(salidas, 1) OVER w AS salidas_lag_1, lag(salidas, 2) OVER w AS salidas_lag_2,
       lag(salidas, 24) OVER w AS salidas_lag_24, lag(salidas, 168) OVER w AS salidas_lag_168
FROM fx_dense d LEFT JOIN fx_avail_ts a USING (station_id, ts)
WINDOW w AS (PARTITION BY station_id ORDER BY ts)"""
TABLES["fx_rolled"] = "SELECT station_id, ts, " + ", ".join(
    f"{f}(salidas) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS salidas_roll_{n}_{k}"
    for k in (3, 24, 168)
    for n, f in (("mean", "avg"), ("median", "median"))
) + " FROM fx_dense"
TABLES["fx_mean24"] = """
SELECT station_id, ts, avg(salidas) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m
FROM fx_dense"""


def _cut(source: str) -> str:
    def instant(q: float) -> str:
        return f"make_timestamp(CAST(round(quantile_cont(CAST(epoch_us(ts) AS DOUBLE), {q})) AS BIGINT))"

    return f"SELECT {instant(0.6)} AS val_start, {instant(0.8)} AS test_start FROM {source}"


TABLES["fx_bounds"] = _cut("fx_dense")
TABLES["fx_split"] = """
SELECT d.station_id, d.ts, CAST(hour(ts) AS INTEGER) AS "hour", CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS dow, salidas,
       CASE WHEN ts >= test_start THEN 'test' WHEN ts >= val_start THEN 'val' ELSE 'train' END AS split
FROM fx_dense d, fx_bounds"""


def _baseline(train: str) -> str:
    return f"""
SELECT r.*, coalesce(m3.m, m2.m, m1.m, (SELECT median(salidas) FROM ({train}))) AS y_pred_baseline
FROM fx_split r
LEFT JOIN (SELECT station_id, dow, "hour", median(salidas) AS m FROM ({train}) GROUP BY ALL) m3 USING (station_id, dow, "hour")
LEFT JOIN (SELECT station_id, "hour", median(salidas) AS m FROM ({train}) GROUP BY ALL) m2 USING (station_id, "hour")
LEFT JOIN (SELECT "hour", median(salidas) AS m FROM ({train}) GROUP BY ALL) m1 USING ("hour")"""


_TRAIN = "SELECT * FROM fx_split WHERE split = 'train'"
TABLES["fx_based"] = _baseline(_TRAIN)
TABLES["fx_preds"] = """
SELECT b.station_id, b.ts, b.salidas AS y_true, b.y_pred_baseline, coalesce(m.m, 0) AS y_pred_model, b.split
FROM fx_based b JOIN fx_mean24 m USING (station_id, ts)"""
TABLES["fx_test"] = "SELECT *, CAST(hour(ts) AS INTEGER) AS \"hour\" FROM fx_preds WHERE split = 'test'"
TABLES["fx_stacked"] = """
SELECT station_id, ts, "split", 'linea_base' AS modelo, y_true, y_pred_baseline AS y_pred FROM fx_preds
UNION ALL SELECT station_id, ts, "split", 'modelo', y_true, y_pred_model FROM fx_preds"""


def _metrics(pred: str = "y_pred", suffix: str = "", digits: int = 9) -> str:
    return (
        f"round(avg(abs(y_true - {pred})), {digits}) AS mae{suffix}, "
        f"round(sqrt(avg((y_true - {pred}) * (y_true - {pred}))), {digits}) AS rmse{suffix}, "
        f"CASE WHEN sum(abs(y_true)) <> 0 THEN round(sum(abs(y_true - {pred})) / sum(abs(y_true)), {digits}) "
        f"ELSE 'nan'::DOUBLE END AS wape{suffix}, "
        f"round(avg({pred} - y_true), {digits}) AS sesgo_medio{suffix}, count(*) AS n{suffix}"
    )


# --- windows and plan

TABLES["fx_targets"] = """
SELECT CAST(unnest(generate_series(min(captured_at_local)::DATE::TIMESTAMP, max(captured_at_local)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS TIMESTAMP)
       + INTERVAL 18 HOUR AS target_ts FROM fx_status"""
TABLES["fx_last_target"] = (
    "SELECT max(captured_at_local)::DATE::TIMESTAMP + INTERVAL 18 HOUR AS target_ts FROM fx_status"
)
TABLES["fx_gaps"] = """
SELECT s.station_id, t.target_ts, s.num_bikes_available, s.captured_at_local, s.capture_id,
       abs(epoch_us(s.captured_at_local) - epoch_us(t.target_ts)) / 1e6 AS gap
FROM fx_status s, fx_targets t"""
TABLES["fx_nearest"] = """
SELECT station_id, target_ts, CAST(num_bikes_available AS DOUBLE) AS current_inv FROM fx_gaps
QUALIFY row_number() OVER (PARTITION BY station_id, target_ts ORDER BY gap, captured_at_local, capture_id) = 1"""
TABLES["fx_slots"] = """
SELECT station_id, dow, "hour", median(salidas) AS med_salidas, median(llegadas) AS med_llegadas FROM fx_demand GROUP BY ALL"""
TABLES["fx_flows"] = """
SELECT b.gbfs_id AS station_id, s.dow, s."hour", sum(med_salidas) AS med_salidas, sum(med_llegadas) AS med_llegadas
FROM fx_slots s JOIN fx_bridge b ON b.historico_id = s.station_id WHERE b.gbfs_id IS NOT NULL GROUP BY ALL"""


def _inventory(current: str) -> str:
    return f"""
SELECT t.target_ts, i.station_id, i.capacity, i.lat, i.lon, coalesce(c.current_inv, i.capacity * 0.5::DOUBLE) AS current_inv,
       coalesce(f.med_salidas, 0) AS med_salidas, coalesce(f.med_llegadas, 0) AS med_llegadas,
       greatest(coalesce(c.current_inv, i.capacity * 0.5::DOUBLE) - (coalesce(f.med_salidas, 0) - coalesce(f.med_llegadas, 0)), 0) AS expected_inventory
FROM fx_info_last i CROSS JOIN fx_targets t
LEFT JOIN {current} c ON c.station_id = i.station_id AND c.target_ts = t.target_ts
LEFT JOIN fx_flows f ON f.station_id = i.station_id AND f."hour" = hour(t.target_ts) AND f.dow = (dayofweek(t.target_ts) + 6) % 7"""


TABLES["fx_inventory"] = _inventory("fx_nearest")
TABLES["fx_levels"] = """
SELECT target_ts, station_id, CAST(capacity AS DOUBLE) AS capacity, lat, lon, least(greatest(expected_inventory, 0), capacity) AS inv,
       round_even(0.15::DOUBLE * capacity, 0) AS safety, round_even(0.5::DOUBLE * capacity, 0) AS target
FROM fx_inventory"""
TABLES["fx_state"] = """
SELECT *, greatest(safety - inv, 0) AS deficit_before, CAST(round_even(greatest(target - inv, 0), 0) AS INTEGER) AS need,
       CAST(floor(greatest(inv - target, 0)) AS INTEGER) AS avail
FROM fx_levels"""
TABLES["fx_pairs"] = f"""
SELECT r.target_ts, r.station_id AS receiver, d.station_id AS donor, {_haversine("r.lat", "r.lon", "d.lat", "d.lon")} AS dist,
       r.deficit_before, CAST(least(r.need, floor(r.capacity - r.inv)) AS INTEGER) AS need, d.avail
FROM fx_state r JOIN fx_state d USING (target_ts)
WHERE r.deficit_before > 0 AND d.avail > 0 AND least(r.need, floor(r.capacity - r.inv)) > 0
  AND {_haversine("r.lat", "r.lon", "d.lat", "d.lon")} <= 1500"""
# The sequential rule itself: pair by pair, the stock of all donors and the open need of the receiver carried along.
TABLES["fx_granted"] = """
WITH RECURSIVE lined AS (SELECT *, row_number() OVER (PARTITION BY target_ts ORDER BY deficit_before DESC, receiver, dist, donor) AS i FROM fx_pairs),
walk AS (
  SELECT target_ts, CAST(0 AS BIGINT) AS i, map_from_entries(list(DISTINCT {'k': donor, 'v': CAST(avail AS BIGINT)})) AS stock,
         CAST(NULL AS VARCHAR) AS receiver, CAST(0 AS BIGINT) AS missing, CAST(NULL AS VARCHAR) AS donor, CAST(0 AS BIGINT) AS qty
  FROM lined GROUP BY target_ts
  UNION ALL
  SELECT target_ts, i, map_from_entries(list_transform(map_entries(stock), lambda e: CASE WHEN e.key = donor THEN {'k': e.key, 'v': e.value - taken} ELSE {'k': e.key, 'v': e.value} END)),
         receiver, wanted - taken, donor, taken
  FROM (SELECT *, least(wanted, stock[donor]) AS taken
        FROM (SELECT w.target_ts, l.i, w.stock, l.receiver, l.donor, CASE WHEN l.receiver = w.receiver THEN w.missing ELSE CAST(l.need AS BIGINT) END AS wanted
              FROM walk w JOIN lined l ON l.target_ts = w.target_ts AND l.i = w.i + 1)))
SELECT target_ts, receiver, donor, l.dist, l.deficit_before, w.qty FROM walk w JOIN lined l USING (target_ts, receiver, donor) WHERE w.qty > 0"""
TABLES["fx_plan"] = """
WITH parts AS (SELECT *, least(20, qty - part * 20) AS bikes FROM (SELECT *, unnest(range(0, (qty - 1) // 20 + 1)) AS part FROM fx_granted)),
summed AS (
  SELECT p.*, d.inv AS donor_inv, r.inv AS receiver_inv, r.safety,
         CAST(sum(bikes) OVER (PARTITION BY p.target_ts, donor ORDER BY p.deficit_before DESC, receiver, part ROWS UNBOUNDED PRECEDING) AS BIGINT) AS given,
         CAST(sum(bikes) OVER (PARTITION BY p.target_ts, receiver ORDER BY dist, donor, part ROWS UNBOUNDED PRECEDING) AS BIGINT) AS taken,
         CAST(sum(bikes) OVER (PARTITION BY p.target_ts, receiver) AS BIGINT) AS received
  FROM parts p JOIN fx_state d ON d.target_ts = p.target_ts AND d.station_id = donor JOIN fx_state r ON r.target_ts = p.target_ts AND r.station_id = receiver)
SELECT target_ts, donor AS donor_station_id, receiver AS receiver_station_id, CAST(bikes AS INTEGER) AS bikes_to_move, round_even(dist, 1) AS distance_m,
       donor_inv - given + bikes AS donor_inventory_before, donor_inv - given AS donor_inventory_after,
       receiver_inv + taken - bikes AS receiver_inventory_before, receiver_inv + taken AS receiver_inventory_after,
       deficit_before AS receiver_deficit_before, greatest(safety - receiver_inv - received, 0.0::DOUBLE) AS receiver_deficit_after,
       round_even(greatest(0, 1 - dist / 1500.0::DOUBLE), 3) AS confidence
FROM summed"""
TABLES["fx_moves"] = """
SELECT target_ts, donor AS donor_station_id, receiver AS receiver_station_id, least(need, avail, 20) AS bikes_to_move,
       round_even(dist, 1) AS distance_m, deficit_before AS receiver_deficit_before,
       greatest(deficit_before - need, 0) AS receiver_deficit_after
FROM fx_pairs"""
TABLES["fx_move_map"] = """
SELECT m.donor_station_id, m.receiver_station_id, m.bikes_to_move, d.lat AS donor_lat, d.lon AS donor_lon, r.lat AS recv_lat, r.lon AS recv_lon
FROM fx_moves m LEFT JOIN fx_info_last d ON d.station_id = m.donor_station_id
LEFT JOIN fx_info_last r ON r.station_id = m.receiver_station_id"""


def _risk(where_demand: str = "true", where_avail: str = "true") -> str:
    """Stations, their hours of demand and their hours of availability stacked up, then one group for each station."""
    return f"""
SELECT station_id, max(label) AS name, max(y) AS lat, max(x) AS lon, max(docks) AS capacity,
       round(coalesce(sum(departures) / nullif(sum(demand_hours), 0), 0), 9) AS demanda_media,
       round(coalesce(sum(empty) / nullif(sum(seen_hours), 0), 0), 9) AS riesgo_vaciado,
       round(coalesce(sum("full") / nullif(sum(seen_hours), 0), 0), 9) AS riesgo_saturacion, coalesce(sum(minutes), 0) AS min_sin_bicis
FROM (SELECT station_id, name AS label, lat AS y, lon AS x, capacity AS docks FROM fx_info_last
      UNION ALL BY NAME
      SELECT b.gbfs_id AS station_id, d.salidas AS departures, 1 AS demand_hours
      FROM fx_bridge b JOIN fx_demand d ON b.historico_id = d.station_id WHERE {where_demand}
      UNION ALL BY NAME
      SELECT station_id, coalesce(empty_flag, false)::INTEGER AS empty, coalesce(full_flag, false)::INTEGER AS "full", minutes_zero_bikes AS minutes, 1 AS seen_hours
      FROM fx_avail WHERE {where_avail})
GROUP BY station_id HAVING count(label) > 0"""


TABLES["fx_last_bikes"] = """
SELECT station_id, num_bikes_available AS bicis_actuales FROM fx_status
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY captured_at_utc DESC, capture_id DESC) = 1"""
TABLES["fx_risk_plain"] = _risk()
TABLES["fx_risk"] = "SELECT r.*, l.bicis_actuales FROM fx_risk_plain r LEFT JOIN fx_last_bikes l USING (station_id)"

# --- manifest, documents

TABLES["fx_manifest"] = """
SELECT 'https://data.example.org/' || o_orderkey || '.csv' AS url,
       'viajes_' || strftime(o_orderdate, '%Y-%m') || '_' || o_orderkey || '.csv' AS file_name,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS "year",
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS "month",
       o_orderdate AS discovered_at_utc,
       CASE o_orderstatus WHEN 'F' THEN 'downloaded' WHEN 'O' THEN 'pending' ELSE 'error' END AS download_status,
       CASE WHEN o_orderstatus = 'P' THEN 500 ELSE 200 END AS http_status, CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes,
       sha256(CAST(o_orderkey AS VARCHAR)) AS checksum_sha256,
       CASE WHEN o_orderkey % 13 <> 0 THEN 'raw/' || o_orderkey || '.csv' END AS local_path,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS last_downloaded_at_utc
FROM orders"""
TABLES["fx_keyed"] = 'SELECT *, "year" * 100 + "month" AS period_key FROM fx_manifest'
_MANIFEST = (
    'url, file_name, "year", "month", discovered_at_utc, download_status, http_status, size_bytes, checksum_sha256, '
    "local_path, last_downloaded_at_utc"
)

TABLES["fx_entries"] = """
SELECT doc_id, event_id, CASE WHEN event_id % 19 <> 0 THEN station_id END AS station_id,
       CASE WHEN event_id % 23 <> 0 THEN num_bikes_available END AS bikes, CASE WHEN event_id % 23 <> 0 THEN num_docks_available END AS docks,
       is_installed, is_renting, is_returning, last_reported
FROM fx_captures"""
TABLES["fx_first_entries"] = """
SELECT *, count(*) OVER (PARTITION BY doc_id, station_id) AS entries FROM fx_entries WHERE station_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY doc_id, station_id ORDER BY event_id) = 1"""
TABLES["fx_doc_times"] = """
SELECT doc_id, CAST(to_timestamp(max(last_reported)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS captured_at_utc FROM fx_captures GROUP BY doc_id"""
TABLES["fx_quality"] = """
SELECT e.doc_id, CAST(count(*) FILTER (WHERE e.station_id IS NOT NULL) - count(DISTINCT e.station_id) AS BIGINT) AS dup_stations,
       (SELECT count(*) FROM fx_first_entries f WHERE f.doc_id = e.doc_id AND (f.bikes < 0 OR f.docks < 0)) AS negativos,
       count(*) FILTER (WHERE e.station_id IS NULL) AS sin_station_id
FROM fx_entries e GROUP BY e.doc_id"""


# --- queries -----------------------------------------------------------------------------------

_CANONICAL = f"genero_usuario, edad_usuario, {_KEYS}"
_FIXED = "TIMESTAMP '2024-02-01 00:00:00'"

SQL["raw_csv_S1"] = f"SELECT {_CANONICAL} FROM fx_raw"
SQL["raw_union_S2"] = f"""
SELECT genero_usuario, CASE WHEN CAST(substr(source_file, 17, 1) AS INTEGER) % 2 = 1 THEN edad_usuario END AS edad_usuario, {_KEYS}
FROM fx_raw"""
SQL["stage_raw_S3"] = f"""
SELECT {_HASH} AS row_hash, source_file, 'stage_1' AS run_id, {_FIXED} AS ingested_at_utc, {_CANONICAL} FROM fx_raw"""
SQL["json_snapshots_S4"] = """
SELECT doc_id, station_id, CASE WHEN bikes >= 0 THEN bikes END AS num_bikes_available, CASE WHEN docks >= 0 THEN docks END AS num_docks_available,
       is_installed, is_renting, is_returning, last_reported FROM fx_first_entries"""
SQL["json_information_S4"] = (
    "SELECT short_name AS doc_id, station_id, name, lat, lon, capacity, region_id, short_name FROM fx_info"
)
SQL["feed_discovery_S5"] = """
SELECT page_id AS doc_id, name, CASE name WHEN 'station_status' THEN url ELSE url || '/info' END AS url
FROM pages, (SELECT unnest(['station_status', 'station_information']) AS name) WHERE page_id % 4 <> 3"""
SQL["feed_rejects_S5"] = "SELECT page_id AS doc_id FROM pages WHERE page_id % 4 = 3"
SQL["html_links_S6"] = r"""
SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS url, regexp_extract(href, '([^/?#]*)(?:[?#].*)?$', 1) AS file_name
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)"""
SQL["manifest_scan_S7"] = """
SELECT url, file_name, "year", "month", http_status, size_bytes, local_path, last_downloaded_at_utc
FROM fx_manifest WHERE download_status = 'downloaded' AND local_path IS NOT NULL"""
SQL["alias_scan_S8"] = "SELECT historico_id, gbfs_id FROM fx_bridge WHERE gbfs_id IS NOT NULL"
SQL["catalog_scan_S9"] = """
SELECT i.historico_id, s.s_name AS nombre, 19.40::DOUBLE + s_nationkey * 0.004::DOUBLE AS lat,
       CASE WHEN s_suppkey % 3 <> 0 THEN -99.17::DOUBLE END AS lon
FROM (SELECT origin_station_id AS historico_id FROM fx_trips UNION SELECT dest_station_id FROM fx_trips) i
LEFT JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = i.historico_id"""
SQL["table_write_S10"] = 'SELECT * FROM fx_demand UNION ALL SELECT * REPLACE ("hour" + 100 AS "hour") FROM fx_demand'
SQL["report_write_S11"] = """
SELECT source_file, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS validas FROM fx_classified GROUP BY 1"""
SQL["run_ledger_S13"] = """
SELECT 'run_' || user_id AS run_id, arg_min(event_type, event_id) AS run_type,
       max(CASE WHEN event_id = first_id AND event_id % 2 = 0 THEN 'feed' END) AS source,
       min(ts) FILTER (WHERE event_id = first_id) AS started_at_utc, max(ts) FILTER (WHERE event_id > 0) AS finished_at_utc,
       arg_max(event_type, event_id) AS status, max(event_id) AS rows_ingested, arg_max(props, event_id) AS notes
FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first_id FROM events) GROUP BY user_id"""
SQL["replace_run_S14"] = """
SELECT capture_id, CASE WHEN run_id = 'r1' THEN 5 ELSE num_bikes_available END AS num_bikes_available, run_id FROM fx_status"""

SQL["normalize_columns_P1"] = f"SELECT {_CANONICAL} FROM fx_raw"
SQL["trip_facts_P2"] = """
SELECT *, CAST(date_trunc('hour', retiro_ts) AS TIMESTAMP) AS retiro_hour, CAST(date_trunc('hour', arribo_ts) AS TIMESTAMP) AS arribo_hour
FROM fx_trips"""
SQL["reject_classify_P3"] = "SELECT source_file, event_id, CAST(copy_no AS INTEGER) AS copy_no, reason FROM fx_classified"
SQL["trips_clean_P4"] = "SELECT * REPLACE (round(duration_min, 6) AS duration_min), 'run_1' AS run_id FROM fx_clean"
SQL["trip_rejections_P5"] = f"""
SELECT trip_id AS row_hash, source_file, 'run_1' AS run_id, reason, CAST(NULL AS VARCHAR) AS detail,
       fecha_retiro || ' ' || hora_retiro AS retiro_raw, fecha_arribo || ' ' || hora_arribo AS arribo_raw, {_FIXED} AS rejected_at_utc
FROM fx_classified WHERE reason IS NOT NULL"""
SQL["period_select_months_P6"] = "SELECT url, period_key FROM fx_keyed WHERE period_key IN (199602, 199711)"
SQL["period_select_range_P6"] = "SELECT url, period_key FROM fx_keyed WHERE period_key BETWEEN 199602 AND 199711"
SQL["skip_unchanged_P7"] = """
SELECT url, period_key FROM fx_keyed
WHERE period_key >= 199602 AND NOT (download_status = 'downloaded' AND local_path IS NOT NULL AND size_bytes <= 20000000)"""
SQL["dow_hour_filter_P8"] = 'SELECT * FROM fx_avail WHERE (dayofweek("date") + 6) % 7 IN (0, 1, 2, 3, 4) AND "hour" = 18'
SQL["min_risk_filter_P9"] = """
SELECT station_id, round(least(greatest(255.0::DOUBLE * riesgo_vaciado, 0), 255), 4) AS r,
       round(least(greatest(200.0::DOUBLE * (1 - riesgo_vaciado), 0), 255), 4) AS g, round(40.0::DOUBLE + demanda_media * 25, 4) AS radio
FROM fx_risk_plain WHERE riesgo_vaciado >= 0.02::DOUBLE"""
SQL["peak_hours_P10"] = """
SELECT station_id, ts, y_true, y_pred_baseline FROM fx_test WHERE "hour" IN (7, 8, 9, 17, 18, 19, 20)"""
SQL["latest_ts_rows_P11"] = """
SELECT station_id, ts, salidas, salidas_lag_1, salidas_lag_168 FROM fx_lagged WHERE ts = (SELECT max(ts) FROM fx_dense)"""

SQL["left_using_J1"] = 'SELECT station_id, "date", "hour", salidas, llegadas FROM fx_demand'
SQL["latest_version_join_J2"] = "SELECT * FROM fx_meta"
SQL["double_dim_join_J3"] = """
SELECT t.origin_station_id, t.dest_station_id, count(*) AS trips, any_value(o.gbfs_id) AS origin_gbfs_id, any_value(d.gbfs_id) AS dest_gbfs_id
FROM fx_trips t LEFT JOIN fx_bridge o ON o.historico_id = t.origin_station_id LEFT JOIN fx_bridge d ON d.historico_id = t.dest_station_id
GROUP BY 1, 2"""
SQL["inner_bridge_J4"] = """
SELECT b.gbfs_id AS station_id, d."date", d."hour", d.salidas, d.llegadas FROM fx_demand d JOIN fx_bridge b ON b.historico_id = d.station_id"""
SQL["multi_left_J5"] = "SELECT * FROM fx_risk"
SQL["two_role_lookup_J6"] = "SELECT * FROM fx_move_map"
SQL["semi_in_J7"] = "SELECT * FROM fx_avail WHERE station_id IN (SELECT gbfs_id FROM fx_bridge WHERE gbfs_id IS NOT NULL)"
SQL["anti_not_exists_J8"] = """
WITH polled AS (SELECT * REPLACE (CASE WHEN event_id % 29 <> 0 THEN last_reported END AS last_reported) FROM fx_status),
     kept AS (SELECT * FROM polled WHERE num_docks_available < 20)
SELECT event_id, station_id, last_reported FROM polled t
WHERE t.last_reported IS NULL
   OR NOT EXISTS (SELECT 1 FROM kept s WHERE s.station_id = t.station_id AND s.last_reported = t.last_reported)"""
_INFO_BATCH = """
WITH polled AS (SELECT * REPLACE (CASE WHEN region_id <> '3' THEN capacity END AS capacity, CASE WHEN region_id <> '7' THEN name END AS name) FROM fx_info),
     kept AS (SELECT * FROM polled WHERE hour(captured_at_utc) < 3 {latest})
SELECT short_name, station_id, name, capacity FROM polled t
WHERE NOT EXISTS (SELECT 1 FROM kept s WHERE s.station_id = t.station_id AND s.name IS NOT DISTINCT FROM t.name
  AND s.lat IS NOT DISTINCT FROM t.lat AND s.lon IS NOT DISTINCT FROM t.lon AND s.capacity IS NOT DISTINCT FROM t.capacity)"""
SQL["anti_null_safe_J9"] = _INFO_BATCH.format(latest="")
SQL["anti_null_safe_latest_J9"] = _INFO_BATCH.format(
    latest="QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY captured_at_utc DESC) = 1"
)
SQL["anti_not_in_J10"] = """
SELECT trip_id, genero, edad FROM fx_clean WHERE trip_id NOT IN (SELECT trip_id FROM fx_clean WHERE genero = 'M')"""
SQL["anti_insert_manifest_J11"] = f"""
WITH polled AS (SELECT * REPLACE (CASE WHEN "month" % 5 = 0 THEN 'n/a' ELSE CAST(http_status AS VARCHAR) END AS http_status,
                                  CASE WHEN "month" % 7 = 0 THEN 'ayer' ELSE CAST(discovered_at_utc AS VARCHAR) END AS discovered_at_utc) FROM fx_manifest)
SELECT {_MANIFEST.replace("http_status", "try_cast(http_status AS INTEGER) AS http_status").replace("discovered_at_utc", "try_cast(discovered_at_utc AS TIMESTAMP) AS discovered_at_utc")}
FROM polled t WHERE NOT EXISTS (SELECT 1 FROM fx_manifest m WHERE m.download_status = 'error' AND m.url = t.url)"""
SQL["manifest_merge_J12"] = f"""
WITH e AS (SELECT * FROM fx_manifest WHERE download_status <> 'error'),
     d AS (SELECT url, upper(file_name) AS file_name, "year" + 1 AS "year", "month" FROM fx_manifest WHERE "month" IS NULL OR "month" <> 6)
SELECT coalesce(e.url, d.url) AS url, CASE WHEN d.url IS NOT NULL THEN d.file_name ELSE e.file_name END AS file_name,
       CASE WHEN d.url IS NOT NULL THEN d."year" ELSE e."year" END AS "year", CASE WHEN d.url IS NOT NULL THEN d."month" ELSE e."month" END AS "month",
       CASE WHEN e.url IS NULL THEN {_FIXED} ELSE e.discovered_at_utc END AS discovered_at_utc,
       CASE WHEN e.url IS NULL THEN 'pending' ELSE e.download_status END AS download_status,
       e.http_status, e.size_bytes, e.checksum_sha256, e.local_path, e.last_downloaded_at_utc
FROM e FULL OUTER JOIN d ON e.url = d.url"""
SQL["manifest_status_update_J13"] = """
WITH last AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC, l_returnflag DESC) = 1),
u AS (SELECT 'https://data.example.org/' || l_orderkey || '.csv' AS url, * FROM last)
SELECT m.url, file_name, "year", "month", discovered_at_utc,
       CASE WHEN u.url IS NULL THEN download_status WHEN l_returnflag = 'R' THEN 'error' ELSE 'downloaded' END AS download_status,
       CASE WHEN u.url IS NULL THEN http_status WHEN l_returnflag = 'R' THEN 500 ELSE 200 END AS http_status,
       CASE WHEN u.url IS NULL THEN size_bytes ELSE CAST(trunc(l_extendedprice) AS BIGINT) END AS size_bytes,
       CASE WHEN u.url IS NULL THEN checksum_sha256 ELSE sha256(CAST(l_partkey AS VARCHAR)) END AS checksum_sha256,
       CASE WHEN u.url IS NULL THEN local_path ELSE 'raw/' || l_partkey END AS local_path,
       CASE WHEN u.url IS NULL THEN last_downloaded_at_utc ELSE l_shipdate END AS last_downloaded_at_utc
FROM fx_manifest m LEFT JOIN u ON u.url = m.url"""
SQL["grid_fill_join_J14"] = "SELECT * FROM fx_dense"
SQL["meta_avail_join_J15"] = """
SELECT g.station_id, g.ts, m.capacity, m.lat, m.lon, a.bikes_end
FROM fx_grid g LEFT JOIN fx_meta m USING (station_id) LEFT JOIN fx_avail_ts a USING (station_id, ts)"""
TABLES["fx_holes"] = _baseline(
    "SELECT * FROM fx_split WHERE split = 'train' AND \"hour\" <> 4 AND dow < 5 AND length(station_id) > 1"
)
SQL["fallback_lookup_J16"] = "SELECT station_id, ts, y_pred_baseline FROM fx_holes"
SQL["nearest_capture_J17"] = """
SELECT station_id, CAST(num_bikes_available AS DOUBLE) AS current_inv, captured_at_local FROM fx_gaps
WHERE target_ts = (SELECT target_ts FROM fx_last_target)
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY gap, captured_at_local, capture_id) = 1"""
SQL["nearest_captures_J17"] = "SELECT station_id, target_ts, current_inv FROM fx_nearest"
TABLES["fx_known_inv"] = "SELECT * FROM fx_nearest WHERE current_inv >= 10"
SQL["inventory_join_J18"] = _inventory("fx_known_inv")
SQL["alias_match_J19"] = "SELECT historico_id, gbfs_id FROM fx_aliases"
SQL["exact_id_match_J20"] = "SELECT h.historico_id, l.gbfs_id FROM fx_hist_cat h JOIN fx_live_cat l ON l.gbfs_id = h.historico_id"
SQL["norm_name_match_J21"] = f"""
SELECT h.historico_id, l.gbfs_id FROM fx_hist_cat h
JOIN (SELECT {_name_key("nombre")} AS k, max(gbfs_id) AS gbfs_id FROM fx_live_cat GROUP BY 1) l ON l.k = {_name_key("h.nombre")} WHERE l.k <> ''"""
SQL["geo_match_J23"] = """
SELECT historico_id, gbfs_id, round_even(greatest(0, 1 - dist / 120.0::DOUBLE), 3) AS confidence, round_even(dist, 1) AS distance_m
FROM fx_near WHERE dist <= 120"""
SQL["pair_range_join_J25"] = "SELECT * REPLACE (round(dist, 3) AS dist) FROM fx_pairs"
SQL["compare_merge_J26"] = (
    f"SELECT station_id, {_metrics('y_pred_baseline', '_base')}, {_metrics('y_pred_model', '_modelo')} FROM fx_test GROUP BY 1"
)

SQL["departures_hourly_A1"] = "SELECT * FROM fx_out"
SQL["arrivals_hourly_A2"] = "SELECT * FROM fx_in"
SQL["demand_hourly_A3"] = "SELECT * FROM fx_demand"
SQL["availability_hourly_A4"] = "SELECT * FROM fx_avail"
_REASONS = (
    "duplicado fecha_hora_invalida estacion_origen_ausente estacion_destino_ausente arribo_no_posterior duracion_muy_corta "
    "duracion_muy_larga bici_ausente"
).split()
SQL["rejection_report_A5"] = f"""
SELECT source_file, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS validas, count(reason) AS rechazadas,
       round_even(100.0::DOUBLE * count(reason) / count(*), 3) AS pct_rechazado,
       {", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS motivo_{r}" for r in _REASONS)}
FROM fx_classified GROUP BY 1"""
SQL["rejection_breakdown_A6"] = "SELECT reason AS motivo, count(*) AS n FROM fx_classified WHERE reason IS NOT NULL GROUP BY 1"
SQL["bridge_coverage_by_method_A7"] = (
    "SELECT match_method AS metodo, count(*) AS n, round(avg(confidence), 3) AS confianza FROM fx_bridge GROUP BY 1"
)
SQL["bridge_trip_coverage_A8"] = """
SELECT (SELECT count(*) FROM fx_bridge) AS estaciones_historicas, (SELECT count(gbfs_id) FROM fx_bridge) AS estaciones_emparejadas,
       round_even(100.0::DOUBLE * (SELECT count(gbfs_id) / count(*) FROM fx_bridge), 2) AS pct_estaciones,
       round_even(100.0::DOUBLE * avg(CASE WHEN o.gbfs_id IS NOT NULL AND d.gbfs_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 2) AS pct_viajes_cubiertos
FROM fx_trips t LEFT JOIN fx_bridge o ON o.historico_id = t.origin_station_id LEFT JOIN fx_bridge d ON d.historico_id = t.dest_station_id"""
SQL["feed_coverage_A9"] = """
SELECT count(*) AS capturas, count(DISTINCT station_id) AS estaciones, min(captured_at_local) AS tmin, max(captured_at_local) AS tmax FROM fx_status"""
SQL["merged_coverage_A9"] = """
SELECT count(*) AS capturas, true AS within_bound, min(captured_at_local) AS tmin, max(captured_at_local) AS tmax
FROM fx_status WHERE CAST(captured_at_local AS DATE) >= (SELECT CAST(max(captured_at_local) AS DATE) - 9 FROM fx_status)"""
SQL["summary_A10"] = """
SELECT count(*) AS n_trips, (SELECT count(reason) FROM fx_classified) AS n_rejected,
       round_even(100.0::DOUBLE * (SELECT count(reason) FROM fx_classified) / (SELECT count(*) FROM fx_classified), 2) AS pct_rejected,
       count(DISTINCT origin_station_id) AS n_stations, min(retiro_ts) AS period_min, max(retiro_ts) AS period_max,
       (SELECT round(avg(abs(y_true - y_pred_baseline)), 6) FROM fx_test) AS mae_base,
       (SELECT round(avg(abs(y_true - y_pred_model)), 6) FROM fx_test) AS mae_model
FROM fx_clean"""
for _id, _grain in {"median_sdh_A11": 'station_id, dow, "hour",', "median_sh_A11": 'station_id, "hour",', "median_h_A11": '"hour",', "median_all_A11": ""}.items():
    SQL[_id] = f"SELECT {_grain} median(salidas) AS median FROM fx_split WHERE split = 'train' GROUP BY ALL"
SQL["median_flow_A12"] = "SELECT * FROM fx_slots"
SQL["median_flow_live_A12"] = "SELECT * FROM fx_flows"
SQL["forecast_metrics_A13"] = f"SELECT {_metrics('y_pred_baseline')} FROM fx_preds"
SQL["metrics_by_station_A14"] = f"SELECT station_id, {_metrics('y_pred_baseline')} FROM fx_test GROUP BY 1"
SQL["metrics_by_hour_A14"] = (
    f"SELECT \"hour\", {_metrics('y_pred_baseline', '_base')}, {_metrics('y_pred_model', '_modelo')} FROM fx_test GROUP BY 1"
)
SQL["metrics_overall_A15"] = (
    f"SELECT \"split\", modelo, {_metrics()} FROM fx_stacked WHERE \"split\" IN ('val', 'test') GROUP BY 1, 2"
)
SQL["metrics_peak_A16"] = f"""
SELECT 'horas_pico' AS segmento, modelo, {_metrics()} FROM fx_stacked
WHERE "split" = 'test' AND hour(ts) IN (7, 8, 9, 17, 18, 19, 20) GROUP BY 2"""
_TOP = "SELECT station_id, sum(y_true) AS total FROM fx_test GROUP BY 1 ORDER BY total DESC, station_id LIMIT 10"
SQL["metrics_top_A16"] = f"""
SELECT 'top_10_estaciones' AS segmento, modelo, {_metrics()} FROM fx_stacked
WHERE "split" = 'test' AND station_id IN (SELECT station_id FROM ({_TOP})) GROUP BY 2"""
SQL["evaluation_verdict_A17"] = """
SELECT round(b, 6) AS mae_base, round(m, 6) AS mae_modelo, CASE WHEN b <> 0 THEN round_even(100 * (b - m) / b, 2) ELSE 0 END AS mejora_pct,
       CASE WHEN m < b THEN 'el modelo SUPERA a la línea base' ELSE 'el modelo NO supera a la línea base' END AS veredicto
FROM (SELECT avg(abs(y_true - y_pred_baseline)) AS b, avg(abs(y_true - y_pred_model)) AS m FROM fx_test)"""
_PROFILE = "round(avg(salidas), 9) AS salidas, round(avg(llegadas), 9) AS llegadas, round(avg(flujo_neto), 9) AS flujo_neto"
SQL["demand_profile_A18"] = f'SELECT station_id, "hour", {_PROFILE} FROM fx_demand GROUP BY 1, 2'
SQL["demand_profile_station_A18"] = f"SELECT \"hour\", {_PROFILE} FROM fx_demand WHERE station_id = '2' GROUP BY 1"
_STOCK = "round(avg(bikes_start), 9) AS bicis_promedio, round(avg(minutes_zero_bikes), 9) AS min_sin_bicis"
SQL["availability_profile_A19"] = f"""
SELECT b.historico_id, a."hour", {_STOCK} FROM fx_avail a JOIN fx_bridge b ON b.gbfs_id = a.station_id GROUP BY 1, 2"""
SQL["availability_profile_station_A19"] = f"""
SELECT "hour", {_STOCK} FROM fx_avail WHERE station_id IN (SELECT gbfs_id FROM fx_bridge WHERE historico_id = '2') GROUP BY 1"""
SQL["stations_risk_A20"] = "SELECT * FROM fx_risk"
SQL["stations_risk_filtered_A21"] = _risk(
    'd.dow IN (0, 1, 2, 3, 4) AND d."hour" = 18', '(dayofweek("date") + 6) % 7 IN (0, 1, 2, 3, 4) AND "hour" = 18'
)
SQL["stations_risk_fallback_A21"] = "SELECT * FROM fx_risk_plain"
SQL["hourly_mean_all_A22"] = 'SELECT "hour", round(avg(salidas), 9) AS salidas_prom FROM fx_demand GROUP BY 1'
SQL["move_totals_A23"] = """
SELECT CAST(sum(moves) AS BIGINT) AS movimientos, CAST(sum(bikes) AS BIGINT) AS bicis_movidas,
       round_even(100.0::DOUBLE * (sum(before) - sum(after)) / sum(before), 2) AS pct_desabasto_evitado
FROM (SELECT target_ts, receiver_station_id, count(*) AS moves, sum(bikes_to_move) AS bikes, max(receiver_deficit_before) AS before,
             max(receiver_deficit_after) AS after FROM fx_moves GROUP BY 1, 2)"""
SQL["quality_counters_A24"] = "SELECT * FROM fx_quality"
SQL["net_pressure_A25"] = "SELECT station_id, CAST(sum(flujo_neto) AS BIGINT) AS flujo_acumulado FROM fx_demand GROUP BY 1"
SQL["temporal_quantiles_A26"] = "SELECT * FROM fx_bounds"
SQL["temporal_quantiles_rows_A26"] = _cut("events")
SQL["has_data_A27"] = "SELECT count(*) > 0 AS has_data FROM fx_trips"
SQL["map_center_A28"] = "SELECT round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM fx_info_last"
SQL["run_counts_A29"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n FROM {source}"
    for name, source in {
        "trips_clean": "fx_trips",
        "demand_hourly": "fx_demand",
        "availability_hourly": "fx_avail",
        "station_status": "fx_status",
        "station_information": "fx_info",
        "station_bridge": "fx_bridge",
    }.items()
)

SQL["latest_per_key_W1"] = "SELECT station_id, name, capacity, short_name, captured_at_utc FROM fx_info_last"
SQL["latest_status_W1"] = "SELECT * FROM fx_last_bikes"
SQL["nearest_rank_W2"] = """
SELECT station_id, capture_id, row_number() OVER (PARTITION BY station_id ORDER BY gap, captured_at_local, capture_id) AS rn
FROM fx_gaps WHERE target_ts = (SELECT target_ts FROM fx_last_target)"""
SQL["dup_flag_W3"] = "SELECT event_id, CAST(copy_no AS INTEGER) AS copy_no, is_duplicate FROM fx_typed"
SQL["lags_W4"] = "SELECT station_id, ts, salidas_lag_1, salidas_lag_2, salidas_lag_24, salidas_lag_168 FROM fx_lagged"
SQL["roll_mean_W5"] = "SELECT station_id, ts, " + ", ".join(
    f"round(salidas_roll_mean_{k}, 9) AS mean_{k}" for k in (3, 24, 168)
) + " FROM fx_rolled"
SQL["roll_median_W6"] = (
    "SELECT station_id, ts, salidas_roll_median_3, salidas_roll_median_24, salidas_roll_median_168 FROM fx_rolled"
)
SQL["avail_lag_W7"] = "SELECT station_id, ts, bikes_end_lag_1 FROM fx_lagged"
SQL["first_in_doc_W8"] = (
    "SELECT doc_id, station_id, CAST(last_reported AS VARCHAR) AS last_reported, entries FROM fx_first_entries"
)

SQL["top_empty_minutes_T1"] = """
SELECT station_id, sum(minutes_zero_bikes) AS min_sin_bicis FROM fx_avail GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
SQL["risk_ranking_T2"] = """
SELECT station_id, demanda_media, riesgo_vaciado, min_sin_bicis FROM fx_risk
ORDER BY riesgo_vaciado DESC, demanda_media DESC, station_id LIMIT 10"""
SQL["top_demand_stations_T3"] = _TOP
SQL["latest_n_files_T4"] = """
SELECT url, period_key FROM fx_keyed WHERE period_key <= 199912 ORDER BY period_key DESC, url DESC LIMIT 25"""
SQL["moves_by_size_T5"] = "SELECT * FROM fx_moves"
SQL["station_list_T5"] = "SELECT DISTINCT station_id FROM fx_demand"
SQL["demand_timeseries_T5"] = """
SELECT station_id, ts, "split", round(y_true, 9) AS observado, round(y_pred_baseline, 9) AS linea_base, round(y_pred_model, 9) AS modelo FROM fx_preds"""
SQL["predict_ranking_T6"] = "SELECT station_id, ts, round(y_pred_model, 9) AS y_pred FROM fx_preds"

SQL["union_distinct_grid_U1"] = "SELECT * FROM fx_keys"
SQL["union_station_ids_U2"] = "SELECT origin_station_id AS station_id FROM fx_trips UNION SELECT dest_station_id FROM fx_trips"
SQL["union_points_U3"] = """
SELECT donor_lon AS lon, donor_lat AS lat FROM fx_move_map WHERE donor_lat IS NOT NULL AND recv_lat IS NOT NULL
UNION ALL SELECT recv_lon, recv_lat FROM fx_move_map WHERE donor_lat IS NOT NULL AND recv_lat IS NOT NULL"""
SQL["dense_grid_U4"] = "SELECT * FROM fx_grid"

SQL["parse_datetime_F1"] = "SELECT event_id, CAST(copy_no AS INTEGER) AS copy_no, retiro_ts, arribo_ts FROM fx_typed"
SQL["clean_id_F2"] = """
SELECT event_id, CAST(copy_no AS INTEGER) AS copy_no, bike_id, '0' || ciclo_estacion_retiro AS origin, dest_station_id AS dest FROM fx_typed"""
SQL["coerce_age_F3"] = f"SELECT event_id, CAST(copy_no AS INTEGER) AS copy_no, {_AGE} AS edad FROM fx_raw"
SQL["duration_min_F4"] = "SELECT event_id, round((epoch_us(arr_ts) - epoch_us(ts)) / 60e6, 9) AS duration_min FROM fx_events"
SQL["row_hash_F5"] = f"SELECT event_id, CAST(copy_no AS INTEGER) AS copy_no, {_HASH} AS row_hash FROM fx_raw"
SQL["loose_casts_F6"] = """
SELECT event_id, CAST(trunc(try_cast(trim(v) AS DOUBLE)) AS BIGINT) AS as_int, try_cast(trim(v) AS DOUBLE) AS as_float,
       CASE WHEN v IS NOT NULL THEN lower(trim(v)) IN ('true', '1', 'yes', 'si', 'sí') OR coalesce(try_cast(trim(v) AS DOUBLE) <> 0, false) END AS as_bool,
       v AS as_str
FROM (SELECT event_id, CASE event_id % 11 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN 'true'
        WHEN 3 THEN 'Sí' WHEN 4 THEN event_type WHEN 5 THEN '' WHEN 6 THEN '-' || user_id || '.0' WHEN 7 THEN 'FALSE'
        WHEN 8 THEN '1' WHEN 9 THEN '0' ELSE NULL END AS v FROM events)"""
SQL["null_negatives_F7"] = """
SELECT event_id, CASE WHEN num_bikes_available >= 0 THEN num_bikes_available END AS bikes,
       CASE WHEN num_docks_available - 10 >= 0 THEN num_docks_available - 10 END AS docks FROM fx_captures"""
SQL["capture_id_F8"] = "SELECT event_id, capture_id FROM fx_status"
SQL["calendar_F9"] = """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS "hour", CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS dow, dayofweek(ts) IN (0, 6) AS is_weekend,
       CAST(month(ts) AS INTEGER) AS "month", CAST(weekofyear(ts) AS INTEGER) AS week FROM events"""


def _holiday(d: str) -> str:
    def monday(month: int, n: int) -> str:
        first = f"make_date(year({d}), {month}, 1)"
        return f"{d} = {first} + CAST((8 - isodow({first})) % 7 + {7 * (n - 1)} AS INTEGER)"

    fixed = f"(month({d}), day({d})) IN ((1, 1), (5, 1), (9, 16), (12, 25))"
    return f"({fixed} OR {monday(2, 1)} OR {monday(3, 3)} OR {monday(11, 3)})"


def _quincena(ts: str) -> str:
    return f"(day({ts}) = 15 OR CAST({ts} AS DATE) = last_day({ts}))"


SQL["is_holiday_F10"] = f"""
SELECT "day", n, {_holiday('"day"')} AS is_holiday FROM (SELECT CAST(l_shipdate AS DATE) AS "day", count(*) AS n FROM lineitem GROUP BY 1)"""
SQL["quincena_F11"] = f"SELECT o_orderkey, {_quincena('o_orderdate')} AS quincena FROM orders"
SQL["haversine_F12"] = (
    f"SELECT short_name, round({_haversine('lat', 'lon', 'lat + capacity * 0.01::DOUBLE', '-99.0::DOUBLE')}, 3) AS dist FROM fx_info"
)
SQL["nearest_point_F13"] = f"""
SELECT historico_id AS point_id, gbfs_id, round(dist, 3) AS dist FROM fx_near
UNION ALL
SELECT point_id, gbfs_id, round(dist, 3) AS dist FROM (
  SELECT 'far' || c_custkey AS point_id, l.gbfs_id, {_haversine("c_custkey % 180 - 89.5::DOUBLE", "c_custkey * 7 % 360 - 180.0::DOUBLE", "l.lat", "l.lon")} AS dist
  FROM customer JOIN fx_live_cat l ON true
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, l.gbfs_id) = 1)"""
SQL["normalize_name_F14"] = f"SELECT doc_id, {_name_key('text')} AS name FROM documents"
TABLES["fx_names"] = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'datos_' || (year(ts) - event_id % 14) || '-' || lpad(CAST(1 + event_id % 12 AS VARCHAR), 2, '0') || '.csv'
  WHEN 1 THEN (year(ts) - event_id % 14) || '_' || lpad(CAST(1 + event_id % 14 AS VARCHAR), 2, '0') || '.zip'
  WHEN 2 THEN 'viajes_' || (['Enero','feb','MARZO','abril','mayo','jun','julio','ago','sept','octubre','Nov','diciembre'])[1 + event_id % 12] || '_' || year(ts) || '.csv'
  WHEN 3 THEN 'septiembre' || event_id || '.csv' WHEN 4 THEN 'ecos-' || year(ts) || '.csv' ELSE event_type || '_' || user_id || '.csv' END AS file_name
FROM events"""
SQL["infer_period_F15"] = """
WITH parts AS (
  SELECT *, nullif(regexp_extract(file_name, '(20[0-9]{2})[-_](0[1-9]|1[0-2])', 1), '') AS y1,
         nullif(regexp_extract(file_name, '(20[0-9]{2})[-_](0[1-9]|1[0-2])', 2), '') AS m1,
         nullif(regexp_extract(file_name, '(20[0-9]{2})', 1), '') AS y2,
         lower(nullif(regexp_extract(file_name, '(?i)(septiembre|diciembre|noviembre|octubre|febrero|agosto|enero|marzo|abril|junio|julio|sept|mayo|ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)', 1), '')) AS word
  FROM fx_names)
SELECT event_id, file_name,
       CASE WHEN y1 IS NOT NULL THEN CAST(y1 AS INTEGER) WHEN y2 IS NOT NULL AND word IS NOT NULL THEN CAST(y2 AS INTEGER) END AS "year",
       CASE WHEN y1 IS NOT NULL THEN CAST(m1 AS INTEGER) WHEN y2 IS NOT NULL AND word IS NOT NULL
            THEN CAST(list_position(['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'], substr(word, 1, 3)) AS INTEGER) END AS "month"
FROM parts"""
SQL["zone_conversion_F16"] = """
SELECT event_id, ts - INTERVAL 6 HOUR AS local_ts, CAST(date_trunc('second', ts) AS TIMESTAMP) AS utc_ts,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events"""
SQL["hour_ts_F17"] = "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour_ts FROM events"
SQL["clip_round_F18"] = """
SELECT p_partkey, CAST(least(greatest(p_size, 5), 40) AS DOUBLE) AS clipped, CAST(floor(p_size * 0.15::DOUBLE) AS BIGINT) AS floored,
       round_even(p_size * 0.5::DOUBLE, 0) AS rounded FROM part"""
SQL["null_default_pct_F19"] = """
SELECT l_suppkey, coalesce(max(l_quantity) FILTER (WHERE l_quantity > 49), 0) AS top,
       CASE WHEN count(*) FILTER (WHERE l_quantity > 45) > 0
            THEN round(100.0::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'R') / count(*) FILTER (WHERE l_quantity > 45), 6) ELSE 0 END AS pct
FROM lineitem GROUP BY 1"""
SQL["epoch_diff_F20"] = """
SELECT event_id, abs(epoch_us(captured_at_local) - epoch_us(t.target_ts)) / 1e6 AS gap FROM fx_status, fx_last_target t"""

SQL["feature_frame_M1"] = f"""
SELECT d.station_id, d.ts, CAST(hour(d.ts) AS INTEGER) AS "hour", CAST((dayofweek(d.ts) + 6) % 7 AS INTEGER) AS dow,
       dayofweek(d.ts) IN (0, 6) AS is_weekend, CAST(month(d.ts) AS INTEGER) AS "month", CAST(weekofyear(d.ts) AS INTEGER) AS week,
       {_holiday("CAST(d.ts AS DATE)")} AS is_holiday, {_quincena("d.ts")} AS quincena, m.capacity, m.lat, m.lon,
       d.salidas, d.llegadas, d.flujo_neto, d.bikes_end_lag_1, d.salidas_lag_1, d.salidas_lag_2, d.salidas_lag_24, d.salidas_lag_168,
       {", ".join(f"round(r.salidas_roll_mean_{k}, 9) AS salidas_roll_mean_{k}, r.salidas_roll_median_{k}" for k in (3, 24, 168))}
FROM fx_lagged d JOIN fx_rolled r USING (station_id, ts) LEFT JOIN fx_meta m USING (station_id)"""
SQL["temporal_split_M2"] = "SELECT station_id, ts, split FROM fx_split"
SQL["baseline_predict_M3"] = "SELECT station_id, ts, split, y_pred_baseline FROM fx_based"
SQL["model_predictions_M7"] = f"""
SELECT station_id, ts, 'salidas' AS target, y_true, y_pred_baseline, "split", 'naive_v1' AS model_version, {_FIXED} AS created_at_utc FROM fx_preds"""
SQL["expected_inventory_M8"] = "SELECT * FROM fx_inventory"
SQL["balance_state_M9"] = "SELECT * FROM fx_state"

SQL["recommend_moves_M10"] = "SELECT target_ts, receiver, donor, qty FROM fx_granted"
SQL["move_enrichment_M11"] = "SELECT * FROM fx_plan"
SQL["rebalance_summary_M12"] = """
WITH changes AS (
  SELECT target_ts, station_id, sum(delta) AS delta, sum(moves) AS moves FROM (
    SELECT target_ts, donor_station_id AS station_id, -bikes_to_move AS delta, 1 AS moves FROM fx_plan
    UNION ALL SELECT target_ts, receiver_station_id, bikes_to_move, 0 FROM fx_plan) GROUP BY ALL),
totals AS (
  SELECT s.target_ts, count(*) AS estaciones, count(*) FILTER (deficit_before > 0) AS receptoras, count(*) FILTER (avail > 0) AS donantes_disponibles,
         CAST(sum(coalesce(moves, 0)) AS BIGINT) AS movimientos, CAST(sum(greatest(coalesce(delta, 0), 0)) AS BIGINT) AS bicis_movidas,
         sum(deficit_before) AS deficit_antes, sum(greatest(safety - inv - coalesce(CAST(delta AS DOUBLE), 0), 0)) AS deficit_despues,
         abs(sum(inv) - sum(inv + coalesce(CAST(delta AS DOUBLE), 0))) < 1e-6 AS inventario_conservado
  FROM fx_state s LEFT JOIN changes c ON c.target_ts = s.target_ts AND c.station_id = s.station_id GROUP BY s.target_ts)
SELECT *, CASE WHEN deficit_antes > 0 THEN round(100.0::DOUBLE * (deficit_antes - deficit_despues) / deficit_antes, 2) ELSE 0 END AS pct_desabasto_evitado FROM totals"""
SQL["recommendations_table_M13"] = f"""
SELECT *, 'rebalanceo_heuristico_v1' AS model_version, {_FIXED} AS created_at_utc FROM fx_plan WHERE target_ts = (SELECT target_ts FROM fx_last_target)"""
SQL["incremental_load_M14"] = """
WITH loads AS (SELECT *, CASE WHEN CAST(substr(source_file, 16, 2) AS INTEGER) <= 20 THEN 'run_1' ELSE 'run_2' END AS run_id FROM fx_classified)
SELECT 'trips_raw' AS table_name, run_id, count(*) AS n FROM loads GROUP BY run_id
UNION ALL SELECT 'trips_clean', run_id, count(*) FROM loads WHERE reason IS NULL GROUP BY run_id
UNION ALL SELECT 'trip_rejections', run_id, count(*) FROM loads WHERE reason IS NOT NULL GROUP BY run_id
UNION ALL SELECT 'loaded_files', run_id, count(DISTINCT source_file) FROM loads GROUP BY run_id
UNION ALL SELECT 'ledger', r, (SELECT count(*) FROM loads WHERE reason IS NULL AND run_id = r) FROM (VALUES ('run_1'), ('run_2'), ('run_3')) v(r)"""
SQL["incremental_hourly_M14"] = """
WITH ends AS (
  SELECT origin_station_id AS station_id, retiro_ts AS ts, 1 AS out, 0 AS inn FROM fx_clean
  UNION ALL SELECT dest_station_id, arribo_ts, 0, 1 FROM fx_clean),
counts AS (SELECT station_id, CAST(ts AS DATE) AS "date", CAST(hour(ts) AS INTEGER) AS "hour", CAST(sum(out) AS BIGINT) AS salidas, CAST(sum(inn) AS BIGINT) AS llegadas FROM ends GROUP BY ALL)
SELECT station_id, "date", "hour", CAST((dayofweek("date") + 6) % 7 AS INTEGER) AS dow, salidas, llegadas, llegadas - salidas AS flujo_neto, salidas AS demanda_atendida
FROM counts"""
SQL["incremental_features_M14"] = SQL["feature_frame_M1"]
SQL["snapshot_stream_X1"] = """
SELECT f.station_id || '|' || f.last_reported AS capture_id, f.station_id, CASE WHEN bikes >= 0 THEN bikes END AS num_bikes_available,
       CASE WHEN docks >= 0 THEN docks END AS num_docks_available, f.last_reported, t.captured_at_utc
FROM fx_first_entries f JOIN fx_doc_times t USING (doc_id)"""
SQL["stream_dedupe_X2"] = "SELECT DISTINCT station_id, last_reported FROM fx_first_entries"
SQL["stream_scd_X3"] = "SELECT DISTINCT station_id, name, lat, lon, capacity FROM fx_info"
SQL["stream_availability_X4"] = "SELECT * FROM fx_avail"
SQL["stream_demand_X5"] = "SELECT * FROM fx_demand"
_DEFECT_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("dup_stations", "negativos", "sin_station_id"))
SQL["stream_quality_X6"] = f"""
SELECT 'gbfs' AS run_type, 'ok' AS status, count(*) AS "rows", {_DEFECT_SUMS} FROM fx_quality"""
SQL["stream_collection_X6"] = f"""
SELECT 'gbfs' AS run_type, 'ok' AS status, s.n AS "rows", q.*, s.n AS stored
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT station_id, last_reported FROM fx_first_entries)) s,
     (SELECT {_DEFECT_SUMS} FROM (SELECT * FROM fx_quality UNION ALL SELECT * FROM fx_quality)) q"""


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in re.findall(r"\bfx_\w+", sql):
        if name not in found:
            _needed(TABLES[name], found)
            found[name] = None


def oracle(name: str) -> str:
    """A self-contained statement: the derived tables a query mentions, then the query."""
    sql = SQL[name].strip()
    found: dict[str, None] = {}
    _needed(sql, found)
    if not found:
        return sql
    prelude = ",\n".join(f"{table} AS MATERIALIZED ({TABLES[table].strip()})" for table in found)
    if sql.startswith("WITH "):
        return f"WITH {prelude},\n{sql.removeprefix('WITH ')}"
    return f"WITH {prelude}\n{sql}"

"""Registry: one callable (spark, sf_dir) → DataFrame per operator, on tables derived from the given ones."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pedalflow.functions import calendar as C
from pedalflow.functions import geo as G
from pedalflow.functions import scalars as S
from pedalflow.functions import text as T
from pedalflow.operators import bridge as B
from pedalflow.operators import cleaning as CL
from pedalflow.operators import features as FE
from pedalflow.operators import forecast as FC
from pedalflow.operators import hourly as H
from pedalflow.operators import insights as I
from pedalflow.operators import metrics as M
from pedalflow.operators import rebalance as R
from pedalflow.operators import upserts as U
from pedalflow.plans.domain import Domain, bridge_rows
from pedalflow.schemas import CANONICAL_COLUMNS
from pedalflow.session import scratch_path
from pedalflow.sources import csv_files, feeds, ledger, manifest, pages, sinks
from pedalflow.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIXED_TIME = "2024-02-01 00:00:00"


def query(name: str):
    def register(build: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
        return build

    return register


def fixed_time():
    return F.lit(FIXED_TIME).cast("timestamp_ntz")


# --- sources and sinks -------------------------------------------------------------------------

_HEADERS = {"ciclo_estacion_arribo": "Ciclo_EstacionArribo", "genero_usuario": "Género_Usuario", "bici": "Bici"}


def _write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    writer = df.write.option("header", True).option("encoding", encoding).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _raw_files(d: Domain) -> list[str]:
    """Raw trips as files of two vintages: other headers, other encoding, and no age in the older one."""
    rows = d.trips_raw.withColumn("_day", F.substring("source_file", 17, 1).cast("int") % 2)
    old = rows.filter("_day = 0").select(*[F.col(c).alias(_HEADERS.get(c, c)) for c in CANONICAL_COLUMNS if c != "edad_usuario"])
    new = rows.filter("_day = 1").select(*CANONICAL_COLUMNS)
    return [
        _write_csv(old, scratch_path(d.spark, "raw-old"), "ISO-8859-1"),
        _write_csv(new, scratch_path(d.spark, "raw-new")),
    ]


@query("raw_csv_S1")
def raw_csv(d):
    path = _write_csv(d.trips_raw.select(*CANONICAL_COLUMNS), scratch_path(d.spark, "raw"), "ISO-8859-1")
    return csv_files.read_raw_files(d.spark, [path]).select(*CANONICAL_COLUMNS)


@query("raw_union_S2")
def raw_union(d):
    return csv_files.read_raw_files(d.spark, _raw_files(d)).select(*CANONICAL_COLUMNS)


@query("stage_raw_S3")
def stage_raw(d):
    path = scratch_path(d.spark, "trips_raw")
    sinks.write_table(csv_files.stage_raw(d.trips_raw, "stage_1", fixed_time()), path, "append", ["source_file"])
    return sinks.read_table(d.spark, path)


@query("json_snapshots_S4")
def json_snapshots(d):
    return feeds.parse_station_status(d.status_docs)


@query("json_information_S4")
def json_information(d):
    return feeds.parse_station_information(d.information_docs)


def _discovery_docs(d: Domain) -> DataFrame:
    listed = F.expr(
        "array(named_struct('name', 'station_status', 'url', url), "
        "named_struct('name', 'station_information', 'url', concat(url, '/info')))"
    )
    flat = F.to_json(F.struct(F.struct(listed.alias("feeds")).alias("data")))

    def by_language(*languages: str):
        blocks = F.struct(*[F.struct(listed.alias("feeds")).alias(x) for x in languages])
        return F.to_json(F.struct(blocks.alias("data")))

    doc = (
        F.when(F.expr("page_id % 4 = 0"), flat)
        .when(F.expr("page_id % 4 = 1"), by_language("en", "es"))
        .when(F.expr("page_id % 4 = 2"), by_language("fr"))
        .otherwise(F.lit('{"data": {}}'))
    )
    return d.table("pages").select(F.col("page_id").alias("doc_id"), doc.alias("doc"))


@query("feed_discovery_S5")
def feed_discovery(d):
    return feeds.discover_feeds(_discovery_docs(d))[0]


@query("feed_rejects_S5")
def feed_rejects(d):
    return feeds.discover_feeds(_discovery_docs(d))[1]


@query("html_links_S6")
def html_links(d):
    return pages.extract_links(d.table("pages"), pattern=".*").select("page_id", "url", "file_name")


@query("manifest_scan_S7")
def manifest_scan(d):
    path = _write_csv(d.manifest, scratch_path(d.spark, "manifest"))
    return manifest.downloaded(manifest.load_manifest(d.spark, path)).select(
        "url", "file_name", "year", "month", "http_status", "size_bytes", "local_path", "last_downloaded_at_utc"
    )


@query("alias_scan_S8")
def alias_scan(d):
    rows = d.bridge.selectExpr("historico_id", "gbfs_id", "match_method AS nombre_referencia", "'x' AS nota")
    comment = rows.limit(1).selectExpr("'# nota' AS historico_id", "'x' AS gbfs_id", "'x' AS nombre_referencia", "'x' AS nota")
    path = scratch_path(d.spark, "aliases")
    rows.union(comment).write.option("header", True).option("comment", "~").csv(path)  # '#' is written unquoted
    return csv_files.read_aliases(d.spark, path)


def _station_catalog(d: Domain) -> DataFrame:
    return d.table("supplier").selectExpr(
        "cast(s_suppkey as string) AS historico_id",
        "s_name AS nombre",
        "19.40D + s_nationkey * 0.004D AS lat",
        "IF(s_suppkey % 3 = 0, NULL, -99.17D) AS lon",
    )


@query("catalog_scan_S9")
def catalog_scan(d):
    path = _write_csv(_station_catalog(d), scratch_path(d.spark, "catalog"))
    return B.historical_stations(d.trips, csv_files.read_station_catalog(d.spark, path))


@query("table_write_S10")
def table_write(d):
    path = scratch_path(d.spark, "demand")
    sinks.write_table(d.demand.limit(0), path)
    sinks.write_table(d.demand, path, partition_by=["date"])
    sinks.write_table(d.demand.withColumn("hour", F.col("hour") + 100), path, "append", ["date"])
    return sinks.read_table(d.spark, path)


@query("report_write_S11")
def report_write(d):
    path = scratch_path(d.spark, "report")
    sinks.write_report(CL.rejection_report(d.trips_raw), path)
    return d.spark.read.option("header", True).csv(path).select(
        "source_file", F.col("total").cast("bigint").alias("total"), F.col("validas").cast("bigint").alias("validas")
    )


@query("file_audit_S12")
def file_audit(d):
    return manifest.file_audit(d.spark, f"{d.sf_dir}/*.parquet")


def _ledger_events(d: Domain) -> DataFrame:
    return d.table("events").selectExpr(
        "concat('run_', user_id) AS run_id",
        "cast(event_id as int) AS seq",
        "event_type AS run_type",
        "IF(event_id % 2 = 0, 'feed', NULL) AS source",
        "ts AS at_utc",
        "event_type AS status",
        "event_id AS rows_ingested",
        "props AS notes",
    )


@query("run_ledger_S13")
def run_ledger(d):
    return ledger.current_runs(_ledger_events(d))


@query("replace_run_S14")
def replace_run(d):
    path = scratch_path(d.spark, "status_runs")
    rows = d.status.select("capture_id", "num_bikes_available", "run_id")
    sinks.write_table(rows, path, partition_by=["run_id"])
    redone = rows.filter("run_id = 'r1'").withColumn("num_bikes_available", F.lit(5))
    sinks.replace_partitions(redone, path, ["run_id"])
    return sinks.read_table(d.spark, path, "capture_id string, num_bikes_available int, run_id string")


# --- projections, filters ----------------------------------------------------------------------


@query("normalize_columns_P1")
def normalize_columns(d):
    messy = ["Sexo", "Edad Usuario", "Id_Bici", "EstacionRetiro", "Fecha_Retiro", "HoraRetiro", "Ciclo_EstacionArribo", "Fecha-Arribo", "Hora__Arribo"]
    raw = d.trips_raw.select(*CANONICAL_COLUMNS).toDF(*messy).withColumn("bike_id", F.lit("second"))
    return csv_files.normalize_columns(raw)


@query("trip_facts_P2")
def trip_facts(d):
    return CL.trip_facts(d.trips).drop("duration_min")


@query("reject_classify_P3")
def reject_classify(d):
    return CL.classify(d.trips_raw).select(
        "source_file", F.col("row_pos.event_id").alias("event_id"), F.col("row_pos.copy_no").alias("copy_no"), "reason"
    )


@query("trips_clean_P4")
def trips_clean(d):
    return CL.trips_clean(d.trips_raw, "run_1").withColumn("duration_min", F.round("duration_min", 6))


@query("trip_rejections_P5")
def trip_rejections(d):
    return CL.trip_rejections(d.trips_raw, "run_1", rejected_at=fixed_time())


@query("period_select_months_P6")
def period_select_months(d):
    return manifest.select_files(d.manifest, months=["1996-02", "1997-11"]).select("url", "period_key")


@query("period_select_range_P6")
def period_select_range(d):
    return manifest.select_files(d.manifest, from_period="1996-02", to_period="1997-11").select("url", "period_key")


@query("skip_unchanged_P7")
def skip_unchanged(d):
    chosen = manifest.select_files(d.manifest, from_period="1996-02")
    loaded = manifest.downloaded(d.manifest).withColumn(
        "checksum_sha256", F.when(F.col("size_bytes") > 20_000_000, F.lit("changed")).otherwise(F.col("checksum_sha256"))
    )
    return manifest.skip_unchanged(chosen, loaded).select("url", "period_key")


@query("dow_hour_filter_P8")
def dow_hour_filter(d):
    return I.day_hour_filter(d.availability, [0, 1, 2, 3, 4], 18)


def _risk(d: Domain) -> DataFrame:
    return I.stations_risk(d.information, d.demand, d.availability, d.status, d.bridge)


def _risk_columns(df: DataFrame) -> DataFrame:
    rounded = ("demanda_media", "riesgo_vaciado", "riesgo_saturacion")
    return df.withColumns({c: F.round(c, 9) for c in rounded})


@query("min_risk_filter_P9")
def min_risk_filter(d):
    shown = I.min_risk(_risk(d), 0.02)
    return shown.select("station_id", *[F.round(c, 4).alias(c) for c in ("r", "g", "radio")])


@query("peak_hours_P10")
def peak_hours(d):
    return M.peak_hours(d.test_predictions).select("station_id", "ts", "y_true", "y_pred_baseline")


@query("latest_ts_rows_P11")
def latest_ts_rows(d):
    return FC.latest_rows(d.stored_features).select("station_id", "ts", "salidas", "salidas_lag_1", "salidas_lag_168")


# --- joins -------------------------------------------------------------------------------------


@query("left_using_J1")
def left_using(d):
    out, into = H.departures_hourly(d.trips), H.arrivals_hourly(d.trips)
    return H.attach_counts(H.activity_keys(out, into), out, into)


@query("latest_version_join_J2")
def latest_version_join(d):
    return FE.station_meta(d.bridge, d.information)


@query("double_dim_join_J3")
def double_dim_join(d):
    return B.both_ends(d.trips, d.bridge)


@query("inner_bridge_J4")
def inner_bridge(d):
    return I.live_demand(d.demand, d.bridge).select("station_id", "date", "hour", "salidas", "llegadas")


@query("multi_left_J5")
def multi_left(d):
    return _risk_columns(_risk(d))


@query("two_role_lookup_J6")
def two_role_lookup(d):
    return I.move_map(d.moves, d.information)


@query("semi_in_J7")
def semi_in(d):
    return I.bridged_availability(d.availability, d.bridge)


def _status_batches(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Stored captures and a poll that repeats some of them; a few have no report time."""
    rows = d.status.withColumn("last_reported", F.expr("IF(event_id % 29 = 0, NULL, last_reported)"))
    return rows, rows.filter("num_docks_available < 20")


@query("anti_not_exists_J8")
def anti_not_exists(d):
    incoming, stored = _status_batches(d)
    return U.new_status_rows(incoming, stored).select("event_id", "station_id", "last_reported")


def _information_batches(d: Domain) -> tuple[DataFrame, DataFrame]:
    """The first versions are stored; all versions come in, some without a capacity or a name."""
    rows = d.information.withColumns(
        {
            "capacity": F.expr("IF(region_id = '3', NULL, capacity)"),
            "name": F.expr("IF(region_id = '7', NULL, name)"),
        }
    )
    return rows, rows.filter("hour(captured_at_utc) < 3")


@query("anti_null_safe_J9")
def anti_null_safe(d):
    incoming, stored = _information_batches(d)
    return U.new_information_rows(incoming, stored).select("short_name", "station_id", "name", "capacity")


@query("anti_null_safe_latest_J9")
def anti_null_safe_latest(d):
    incoming, stored = _information_batches(d)
    return U.new_information_rows(incoming, stored, against="latest").select("short_name", "station_id", "name", "capacity")


@query("anti_not_in_J10")
def anti_not_in(d):
    rows = CL.trips_clean(d.trips_raw, "run_2")
    return U.new_trips(rows, rows.filter("genero = 'M'")).select("trip_id", "genero", "edad")


def _manifest_text(d: Domain) -> DataFrame:
    text = d.manifest.select(*[F.col(c).cast("string").alias(c) for c in d.manifest.columns])
    return text.withColumns(
        {
            "http_status": F.expr("IF(month % 5 = 0, 'n/a', http_status)"),
            "discovered_at_utc": F.expr("IF(month % 7 = 0, 'ayer', discovered_at_utc)"),
        }
    )


@query("anti_insert_manifest_J11")
def anti_insert_manifest(d):
    return manifest.new_manifest_rows(_manifest_text(d), d.manifest.filter("download_status = 'error'"))


@query("manifest_merge_J12")
def manifest_merge(d):
    existing = d.manifest.filter("download_status <> 'error'")
    found = d.manifest.filter("month IS NULL OR month <> 6").selectExpr(
        "url", "upper(file_name) AS file_name", "year + 1 AS year", "month"
    )
    return manifest.merge_manifest(existing, found, fixed_time())


@query("manifest_status_update_J13")
def manifest_status_update(d):
    loads = d.table("lineitem").selectExpr(
        "concat('https://data.example.org/', l_orderkey, '.csv') AS url",
        "IF(l_returnflag = 'R', 'error', 'downloaded') AS download_status",
        "IF(l_returnflag = 'R', 500, 200) AS http_status",
        "cast(l_extendedprice as bigint) AS size_bytes",
        "sha2(cast(l_partkey as string), 256) AS checksum_sha256",
        "concat('raw/', l_partkey) AS local_path",
        "l_shipdate AS last_downloaded_at_utc",
        "struct(l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag) AS at",
    )
    return manifest.apply_status(d.manifest, loads)


@query("grid_fill_join_J14")
def grid_fill_join(d):
    return FE.fill_grid(FE.dense_grid(d.demand), d.demand)


@query("meta_avail_join_J15")
def meta_avail_join(d):
    return FE.enrich_grid(
        FE.dense_grid(d.demand), FE.station_meta(d.bridge, d.information), FE.recent_availability(d.availability, d.bridge)
    )


def _split(d: Domain) -> DataFrame:
    return FC.temporal_split(d.observed.drop("salidas_roll_mean_24"))


@query("fallback_lookup_J16")
def fallback_lookup(d):
    """Medians of a training part that lacks slots and stations, so that every fallback is taken."""
    rows = _split(d)
    holes = rows.filter("split = 'train' AND hour <> 4 AND dow < 5 AND length(station_id) > 1")
    return FC.predict_baseline(FC.fit_baseline(holes), rows).select("station_id", "ts", "y_pred_baseline")


@query("nearest_capture_J17")
def nearest_capture(d):
    return R.nearest_capture(d.status, R.default_target(d.status))


@query("nearest_captures_J17")
def nearest_captures(d):
    return R.nearest_captures(d.status, R.daily_targets(d.status))


def _current_inventory(d: Domain) -> DataFrame:
    targets = R.daily_targets(d.status)
    info = U.latest_per_key(d.information.select("station_id", "capacity", "lat", "lon", "captured_at_utc"), "station_id", "captured_at_utc")
    # stock known only for some windows: the others fall back on half the capacity
    known = R.nearest_captures(d.status, targets).filter("current_inv >= 10")
    return R.inventory_balance(info.withColumn("target_ts", F.explode(targets)), known, R.slot_flows(d.demand, d.bridge))


@query("inventory_join_J18")
def inventory_join(d):
    return _current_inventory(d)


@query("alias_match_J19")
def alias_match(d):
    return B.alias_matches(d.hist_catalog, d.live_catalog, d.aliases)


@query("exact_id_match_J20")
def exact_id_match(d):
    return B.exact_id_matches(d.hist_catalog, d.live_catalog)


@query("norm_name_match_J21")
def norm_name_match(d):
    return B.norm_name_matches(d.hist_catalog, d.live_catalog)


@query("fuzzy_name_match_J22")
def fuzzy_name_match(d):
    return B.fuzzy_name_matches(d.hist_catalog, d.live_catalog)


@query("geo_match_J23")
def geo_match(d):
    return B.geo_matches(d.hist_catalog, d.live_catalog)


@query("bridge_cascade_J24")
def bridge_cascade(d):
    return bridge_rows(d)


@query("pair_range_join_J25")
def pair_range_join(d):
    return R.candidate_pairs(d.state).withColumn("dist", F.round("dist", 3))


def _rounded_metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[(c if kind == "bigint" else F.round(c, 9).alias(c)) for c, kind in df.dtypes if c not in keys])


@query("compare_merge_J26")
def compare_merge(d):
    return _rounded_metrics(M.compare_by_group(d.test_predictions, "station_id"), "station_id")


# --- aggregations ------------------------------------------------------------------------------


@query("departures_hourly_A1")
def departures_hourly(d):
    return H.departures_hourly(d.trips)


@query("arrivals_hourly_A2")
def arrivals_hourly(d):
    return H.arrivals_hourly(d.trips)


@query("demand_hourly_A3")
def demand_hourly(d):
    return d.demand


@query("availability_hourly_A4")
def availability_hourly(d):
    return d.availability


@query("rejection_report_A5")
def rejection_report(d):
    return CL.rejection_report(d.trips_raw)


@query("rejection_breakdown_A6")
def rejection_breakdown(d):
    return CL.rejection_breakdown(CL.trip_rejections(d.trips_raw, "run_1", rejected_at=fixed_time()))


@query("bridge_coverage_by_method_A7")
def bridge_coverage_by_method(d):
    return B.coverage_by_method(d.bridge)


@query("bridge_trip_coverage_A8")
def bridge_trip_coverage(d):
    return B.bridge_coverage(d.trips, d.bridge)


@query("feed_coverage_A9")
def feed_coverage(d):
    return I.feed_coverage(d.status)


@query("merged_coverage_A9")
def merged_coverage(d):
    """Coverage of the last days from the stored sketches of each day, and whether it is as near the exact one as it must be."""
    days = d.stored(I.coverage_sketches(d.status), "sketches")
    since = days.agg(F.date_add(F.max("date"), -9)).scalar()
    merged = I.merged_coverage(days.filter(F.col("date") >= since))
    exact = d.status.filter(F.col("captured_at_local").cast("date") >= since).agg(F.count_distinct("station_id")).scalar()
    off = F.abs(F.col("estaciones") - exact) <= 3 * 1.04 / 2 ** (I.SKETCH_BITS / 2) * exact
    return merged.select("capturas", off.alias("within_bound"), "tmin", "tmax")


@query("summary_A10")
def summary(d):
    path = scratch_path(d.spark, "classified")
    CL.classify_distinct(d.trips_raw).write.parquet(path)  # read, shuffled and parsed once for both
    classified = d.spark.read.parquet(path)
    row = I.summary(CL.clean_of(classified, "run_1"), CL.rejections_of(classified, "run_1", fixed_time()), d.predictions)
    return row.withColumns({c: F.round(c, 6) for c in ("mae_base", "mae_model")})


def _training(d: Domain) -> DataFrame:
    return FC.training_rows(d.observed, FC.temporal_quantiles(d.observed))


def _median_table(name: str):
    def build(d: Domain) -> DataFrame:
        return FC.medians_at(FC.fit_baseline(_training(d)), name)

    return build


for _id, _name in {
    "median_sdh_A11": "station_dow_hour",
    "median_sh_A11": "station_hour",
    "median_h_A11": "hour",
    "median_all_A11": "all",
}.items():
    query(_id)(_median_table(_name))


@query("median_flow_A12")
def median_flow(d):
    return R.slot_medians(d.demand)


@query("median_flow_live_A12")
def median_flow_live(d):
    return R.slot_flows(d.demand, d.bridge)


@query("forecast_metrics_A13")
def forecast_metrics(d):
    return _rounded_metrics(d.predictions.agg(*M.compute_all("y_true", "y_pred_baseline")))


@query("metrics_by_station_A14")
def metrics_by_station(d):
    return _rounded_metrics(M.metrics_by_group(d.test_predictions, "y_true", "y_pred_baseline", "station_id"), "station_id")


@query("metrics_by_hour_A14")
def metrics_by_hour(d):
    return _rounded_metrics(M.compare_by_group(d.test_predictions.withColumn("hour", F.hour("ts")), "hour"), "hour")


@query("metrics_overall_A15")
def metrics_overall(d):
    return _rounded_metrics(M.metrics_overall(d.predictions), "split", "modelo")


@query("metrics_peak_A16")
def metrics_peak(d):
    return _rounded_metrics(M.metrics_peak(d.test_predictions), "segmento", "modelo")


@query("metrics_top_A16")
def metrics_top(d):
    return _rounded_metrics(M.metrics_top(d.test_predictions), "segmento", "modelo")


@query("evaluation_verdict_A17")
def evaluation_verdict(d):
    verdict = M.evaluation_verdict(M.metrics_overall(d.predictions))
    return verdict.withColumns({c: F.round(c, 6) for c in ("mae_base", "mae_modelo")})


@query("demand_profile_A18")
def demand_profile(d):
    return _rounded_metrics(I.demand_profile(d.demand), "station_id", "hour")


@query("demand_profile_station_A18")
def demand_profile_station(d):
    return _rounded_metrics(I.demand_profile(d.demand, "2"), "hour")


@query("availability_profile_A19")
def availability_profile(d):
    return _rounded_metrics(I.availability_profile(d.availability, d.bridge), "historico_id", "hour")


@query("availability_profile_station_A19")
def availability_profile_station(d):
    return _rounded_metrics(I.availability_profile(d.availability, d.bridge, "2"), "hour")


@query("stations_risk_A20")
def stations_risk(d):
    return _risk_columns(I.risk_ranking(_risk(d), None))


@query("stations_risk_filtered_A21")
def stations_risk_filtered(d):
    return _risk_columns(I.stations_risk_filtered(d.information, d.demand, d.availability, d.bridge, [0, 1, 2, 3, 4], 18))


@query("stations_risk_fallback_A21")
def stations_risk_fallback(d):
    """A choice without any demand falls back on the overall risk."""
    return _risk_columns(I.stations_risk_filtered(d.information, d.demand, d.availability, d.bridge, [7], 18))


@query("hourly_mean_all_A22")
def hourly_mean_all(d):
    return _rounded_metrics(I.hourly_mean_all(d.demand), "hour")


@query("move_totals_A23")
def move_totals(d):
    return I.move_totals(d.moves)


@query("quality_counters_A24")
def quality_counters(d):
    return feeds.status_quality(d.status_docs)


@query("net_pressure_A25")
def net_pressure(d):
    return I.net_pressure(d.demand)


@query("temporal_quantiles_A26")
def temporal_quantiles(d):
    return FC.temporal_quantiles(d.features.select("ts"))


@query("temporal_quantiles_rows_A26")
def temporal_quantiles_rows(d):
    """Rows of unequal density: the cut follows the rows, not the calendar."""
    return FC.temporal_quantiles(d.table("events").select("ts"))


@query("has_data_A27")
def has_data(d):
    return I.has_data(d.trips)


@query("map_center_A28")
def map_center(d):
    return _rounded_metrics(I.map_center(_risk(d)))


@query("run_counts_A29")
def run_counts(d):
    return ledger.table_counts(
        {
            "trips_clean": d.trips,
            "demand_hourly": d.demand,
            "availability_hourly": d.availability,
            "station_status": d.status,
            "station_information": d.information,
            "station_bridge": d.bridge,
        }
    )


# --- windows -----------------------------------------------------------------------------------


@query("latest_per_key_W1")
def latest_per_key(d):
    return U.latest_per_key(d.information, "station_id", "captured_at_utc").select(
        "station_id", "name", "capacity", "short_name", "captured_at_utc"
    )


@query("latest_status_W1")
def latest_status(d):
    return I.last_bikes(d.status)


@query("nearest_rank_W2")
def nearest_rank(d):
    return R.nearest_ranks(d.status, R.default_target(d.status)).select("station_id", "capture_id", "rn")


@query("dup_flag_W3")
def dup_flag(d):
    return CL.duplicate_flags(d.trips_raw).select(
        F.col("row_pos.event_id").alias("event_id"), F.col("row_pos.copy_no").alias("copy_no"), "is_duplicate"
    )


@query("lags_W4")
def lags(d):
    return d.features.select("station_id", "ts", *[f"salidas_lag_{k}" for k in (1, 2, 24, 168)])


@query("roll_mean_W5")
def roll_mean(d):
    return d.features.select("station_id", "ts", *[F.round(f"salidas_roll_mean_{k}", 9).alias(f"mean_{k}") for k in (3, 24, 168)])


@query("roll_median_W6")
def roll_median(d):
    return d.features.select("station_id", "ts", *[f"salidas_roll_median_{k}" for k in (3, 24, 168)])


@query("avail_lag_W7")
def avail_lag(d):
    return d.features.select("station_id", "ts", "bikes_end_lag_1")


@query("first_in_doc_W8")
def first_in_doc(d):
    parsed = feeds.station_entries(d.status_docs, feeds.STATUS_DOC, ("doc_id",))
    return feeds.first_in_doc(parsed, ("doc_id",)).select("doc_id", "station_id", F.col("st.last_reported").alias("last_reported"), "entries")


# --- top-k and sorted reads --------------------------------------------------------------------


@query("top_empty_minutes_T1")
def top_empty_minutes(d):
    return I.top_empty_minutes(d.availability)


@query("risk_ranking_T2")
def risk_ranking(d):
    return _risk_columns(I.risk_ranking(_risk(d), 10)).select("station_id", "demanda_media", "riesgo_vaciado", "min_sin_bicis")


@query("top_demand_stations_T3")
def top_demand_stations(d):
    return M.top_demand_stations(d.test_predictions)


@query("latest_n_files_T4")
def latest_n_files(d):
    return manifest.select_files(d.manifest, to_period="1999-12", latest=25).select("url", "period_key")


@query("moves_by_size_T5")
def moves_by_size(d):
    return I.moves_by_size(d.moves)


@query("station_list_T5")
def station_list(d):
    return I.station_list(d.demand)


@query("demand_timeseries_T5")
def demand_timeseries(d):
    return _rounded_metrics(I.demand_timeseries(d.predictions), "station_id", "ts", "split")


_forecasts: dict[tuple[str, str], FC.TrainedForecast] = {}


def _trained(d: Domain) -> FC.TrainedForecast:
    """The forecast of a data set, trained once in a session: the queries about it look at one model."""
    key = (d.spark.sparkContext.applicationId, d.sf_dir)
    if key not in _forecasts:
        _forecasts[key] = FC.train(d.stored_features)
    return _forecasts[key]


@query("predict_ranking_T6")
def predict_ranking(d):
    return FC.predict_ranking(d.predictions.select("station_id", "ts", F.round("y_pred_model", 9).alias("y_pred")))


# --- set operations ----------------------------------------------------------------------------


@query("union_distinct_grid_U1")
def union_distinct_grid(d):
    return H.activity_keys(H.departures_hourly(d.trips), H.arrivals_hourly(d.trips))


@query("union_station_ids_U2")
def union_station_ids(d):
    return B.station_ids(d.trips)


@query("union_points_U3")
def union_points(d):
    return I.move_points(I.move_map(d.moves, d.information))


@query("dense_grid_U4")
def dense_grid(d):
    return FE.dense_grid(d.demand)


# --- scalar functions --------------------------------------------------------------------------


@query("parse_datetime_F1")
def parse_datetime(d):
    return d.trips_raw.select(
        "row_pos.event_id",
        "row_pos.copy_no",
        S.parse_datetime(F.col("fecha_retiro"), F.col("hora_retiro")).alias("retiro_ts"),
        S.parse_datetime(F.col("fecha_arribo"), F.col("hora_arribo")).alias("arribo_ts"),
    )


@query("clean_id_F2")
def clean_id(d):
    return d.trips_raw.select(
        "row_pos.event_id",
        "row_pos.copy_no",
        S.clean_id(F.col("bici")).alias("bike_id"),
        S.clean_id(F.concat(F.lit("  0"), F.col("ciclo_estacion_retiro"), F.lit("\t"))).alias("origin"),
        S.clean_id(F.col("ciclo_estacion_arribo")).alias("dest"),
    )


@query("coerce_age_F3")
def coerce_age(d):
    return d.trips_raw.select("row_pos.event_id", "row_pos.copy_no", S.coerce_age(F.col("edad_usuario")).alias("edad"))


@query("duration_min_F4")
def duration_min(d):
    return d.table("events").select("event_id", F.round(S.duration_min(F.col("ts"), d.arrival()), 9).alias("duration_min"))


@query("row_hash_F5")
def row_hash(d):
    return d.trips_raw.select(
        "row_pos.event_id", "row_pos.copy_no", S.row_hash([F.col(c) for c in CL.KEY_COLUMNS], F.col("source_file")).alias("row_hash")
    )


_LOOSE_TEXT = (
    "CASE event_id % 11 WHEN 0 THEN concat(' ', user_id, ' ') WHEN 1 THEN cast(value as string) WHEN 2 THEN 'true' "
    "WHEN 3 THEN 'Sí' WHEN 4 THEN event_type WHEN 5 THEN '' WHEN 6 THEN concat('-', user_id, '.0') WHEN 7 THEN 'FALSE' "
    "WHEN 8 THEN '1' WHEN 9 THEN '0' ELSE NULL END"
)


@query("loose_casts_F6")
def loose_casts(d):
    text = d.table("events").select("event_id", F.expr(_LOOSE_TEXT).alias("v"))
    v = F.col("v")
    return text.select(
        "event_id", S.as_int(v).alias("as_int"), S.as_float(v).alias("as_float"), S.as_bool(v).alias("as_bool"), S.as_str(v).alias("as_str")
    )


@query("null_negatives_F7")
def null_negatives(d):
    return d.captures.select(
        "event_id",
        S.null_negatives(F.col("num_bikes_available")).alias("bikes"),
        S.null_negatives(F.col("num_docks_available") - 10).alias("docks"),
    )


@query("capture_id_F8")
def capture_id(d):
    return d.captures.select("event_id", S.capture_id(F.col("station_id"), F.col("last_reported")).alias("capture_id"))


@query("calendar_F9")
def calendar(d):
    ts = F.col("ts")
    return d.table("events").select(
        "event_id",
        F.hour(ts).alias("hour"),
        C.dow(ts).alias("dow"),
        C.is_weekend(ts).alias("is_weekend"),
        F.month(ts).alias("month"),
        C.iso_week(ts).alias("week"),
    )


@query("is_holiday_F10")
def is_holiday(d):
    return d.table("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    ).select("day", "n", C.is_holiday(F.col("day")).alias("is_holiday"))


@query("quincena_F11")
def quincena(d):
    return d.table("orders").select("o_orderkey", C.quincena(F.col("o_orderdate")).alias("quincena"))


@query("haversine_F12")
def haversine(d):
    dist = G.haversine_m(F.col("lat"), F.col("lon"), F.col("lat") + F.col("capacity") * 0.01, F.lit(-99.0))
    return d.information.select("short_name", F.round(dist, 3).alias("dist"))


@query("nearest_point_F13")
def nearest_point(d):
    points = d.hist_catalog.filter("lat IS NOT NULL").withColumnRenamed("historico_id", "point_id")
    far = d.table("customer").select(
        F.concat(F.lit("far"), "c_custkey").alias("point_id"),
        (F.col("c_custkey") % 180 - 89.5).alias("lat"),
        (F.col("c_custkey") * 7 % 360 - 180.0).alias("lon"),
    )
    points = points.select("point_id", "lat", "lon").unionByName(far)
    found = B.nearest_station(points, d.live_catalog)
    return found.select("point_id", "gbfs_id", F.round("dist", 3).alias("dist"))


@query("normalize_name_F14")
def normalize_name(d):
    return d.table("documents").select("doc_id", T.normalize_name(F.col("text")).alias("name"))


@query("infer_period_F15")
def infer_period(d):
    year, month = T.infer_period(F.col("file_name"))
    return d.file_names.select("event_id", "file_name", year.alias("year"), month.alias("month"))


@query("zone_conversion_F16")
def zone_conversion(d):
    ts = F.col("ts")
    return d.table("events").select(
        "event_id",
        S.utc_to_local(ts).alias("local_ts"),
        S.epoch_to_utc(F.unix_seconds(ts.cast("timestamp"))).alias("utc_ts"),
        S.iso_utc(ts).alias("iso"),
    )


@query("hour_ts_F17")
def hour_ts(d):
    ts = F.col("ts")
    return d.table("events").select("event_id", S.hour_ts(ts.cast("date"), F.hour(ts)).alias("hour_ts"))


@query("clip_round_F18")
def clip_round(d):
    size = F.col("p_size").cast("double")
    return d.table("part").select(
        "p_partkey",
        S.clip(size, F.lit(5.0), F.lit(40.0)).alias("clipped"),
        F.floor(size * 0.15).alias("floored"),
        S.half_even(size * 0.5).alias("rounded"),
    )


@query("null_default_pct_F19")
def null_default_pct(d):
    return d.table("lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("part"),
        F.count_if(F.col("l_quantity") > 45).alias("total"),
        F.max(F.when(F.col("l_quantity") > 49, F.col("l_quantity"))).alias("top"),
    ).select(
        "l_suppkey",
        S.null_default(F.col("top"), 0.0).alias("top"),
        F.round(S.pct(F.col("part"), F.col("total")), 6).alias("pct"),
    )


@query("epoch_diff_F20")
def epoch_diff(d):
    return d.status.select("event_id", S.epoch_diff(F.col("captured_at_local"), R.default_target(d.status)).alias("gap"))


# --- features, forecast, plan ------------------------------------------------------------------


@query("feature_frame_M1")
def feature_frame(d):
    means = [c for c in d.features.columns if "roll_mean" in c]
    return d.features.withColumns({c: F.round(c, 9) for c in means})


@query("temporal_split_M2")
def temporal_split(d):
    return _split(d).select("station_id", "ts", "split")


@query("baseline_predict_M3")
def baseline_predict(d):
    baseline = d.stored(FC.fit_baseline(_training(d)), "baseline")
    return FC.predict_baseline(baseline, _split(d)).select("station_id", "ts", "split", "y_pred_baseline")


@query("train_model_M4")
def train_model(d):
    return _trained(d).scored.select("station_id", "ts", "split", "y_pred_model")


@query("model_artifact_M5")
def model_artifact(d):
    path = scratch_path(d.spark, "model")
    FC.save_model(d.spark, _trained(d), path)
    model, meta = FC.load_model(d.spark, path)
    return FC.predict_frame(model, d.stored_features, meta["feature_cols"]).select("station_id", "ts", "y_pred")


@query("predict_latest_M6")
def predict_latest(d):
    trained = _trained(d)
    return FC.predict_latest(trained.model, d.stored_features, trained.columns)


@query("model_predictions_M7")
def model_predictions(d):
    path = scratch_path(d.spark, "predictions")
    sinks.replace_partitions(d.predictions.withColumn("y_true", F.lit(-1.0)), path, ["target"])
    sinks.replace_partitions(d.predictions, path, ["target"])
    stored = sinks.read_table(d.spark, path)
    return stored.select("station_id", "ts", "target", "y_true", "y_pred_baseline", "split", "model_version", "created_at_utc")


@query("expected_inventory_M8")
def expected_inventory(d):
    return d.inventory


@query("balance_state_M9")
def balance_state(d):
    return d.state


def _plan(d: Domain) -> tuple[DataFrame, DataFrame]:
    return R.recommend_moves(d.inventory)


@query("recommend_moves_M10")
def recommend_moves(d):
    state = R.cut_lineage(R.balance_state(d.inventory))
    return R.allocate(R.candidate_pairs(state)).select("target_ts", "receiver", "donor", "qty")


@query("move_enrichment_M11")
def move_enrichment(d):
    return _plan(d)[0]


@query("rebalance_summary_M12")
def rebalance_summary(d):
    return _plan(d)[1]


@query("recommendations_table_M13")
def recommendations_table(d):
    table, _ = R.build_recommendations(d.information, d.status, d.demand, d.bridge, created_at=fixed_time())
    return table


@query("full_run_M14")
def full_run(d):
    from pedalflow.plans.full_run import RunInputs, run, run_counts

    inputs = RunInputs(d.trips_raw, d.information, d.status, _station_catalog(d))
    return run_counts(run(d.spark, inputs, scratch_path(d.spark, "run"), "run_1"))


def _raw_manifest(d: Domain) -> DataFrame:
    """A manifest of the raw files: each with an address and the checksum of its name."""
    name = F.col("source_file")
    return d.trips_raw.select(name).distinct().select(
        F.concat(F.lit("https://data.example.org/"), name).alias("url"), name.alias("file_name"), F.sha2(name, 256).alias("checksum_sha256")
    )


@query("incremental_load_M14")
def incremental_load(d):
    """Two loads of overlapping files and one of nothing new: rows of each table by run."""
    from pedalflow.plans import monthly

    out, files = scratch_path(d.spark, "monthly"), d.stored(_raw_manifest(d), "files")
    day = F.substring("file_name", 16, 2).cast("int")
    for run_id, chosen in (("run_1", day <= 20), ("run_2", day >= 11), ("run_3", day == 15)):
        monthly.load_month(d.spark, d.trips_raw, files.filter(chosen), out, run_id, at=fixed_time())
    tables = monthly.stored_tables(d.spark, out)
    counts = [
        tables[name].groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "run_id", "n")
        for name in ("trips_raw", "trips_clean", "trip_rejections", "loaded_files")
    ]
    ended = monthly.runs(d.spark, out).select(F.lit("ledger").alias("table_name"), "run_id", F.col("rows_ingested").alias("n"))
    return functools.reduce(DataFrame.unionByName, counts, ended.filter("status = 'ok'"))


_PARTS_OF_MONTH = ("run_1", "{day} <= 10"), ("run_2", "{day} >= 21"), ("run_3", "{day} BETWEEN 11 AND 20")


@query("incremental_hourly_M14")
def incremental_hourly(d):
    """Hourly demand after three loads of files, the first days, the last ones and those between: that of all trips."""
    from pedalflow.plans import incremental, monthly

    out, files = scratch_path(d.spark, "monthly"), d.stored(_raw_manifest(d), "files")
    for run_id, chosen in _PARTS_OF_MONTH:
        days = files.filter(chosen.format(day="cast(substring(file_name, 16, 2) AS int)"))
        monthly.load_month(d.spark, d.trips_raw, days, out, run_id, at=fixed_time())
    return incremental.stored_demand(d.spark, out)


@query("incremental_features_M14")
def incremental_features(d):
    """Features after three loads of trips: those of all trips."""
    from pedalflow.plans import incremental

    out = scratch_path(d.spark, "monthly")
    stations = d.stored(FE.station_meta(d.bridge, d.information), "meta")
    stock = d.stored(FE.recent_availability(d.availability, d.bridge), "stock")
    for run_id, chosen in _PARTS_OF_MONTH:
        touched = incremental.refresh_demand(d.spark, out, run_id, d.trips.filter(chosen.format(day="day(retiro_ts)")))
        incremental.refresh_features(d.spark, out, run_id, touched, stations, stock)
    rows = incremental.stored_features(d.spark, out)
    return rows.withColumns({c: F.round(c, 9) for c in rows.columns if "roll_mean" in c})


# --- streaming ---------------------------------------------------------------------------------


def _landed(d: Domain, docs: DataFrame) -> str:
    """Documents as landed files, one per line."""
    path = scratch_path(d.spark, "landing")
    docs.select("doc").write.text(path)
    return path


def _drain(d: Domain, docs: DataFrame, start) -> str:
    path, checkpoint = scratch_path(d.spark, "streamed"), scratch_path(d.spark, "offsets")
    stream = streams.document_stream(d.spark, _landed(d, docs), one_per_line=True, files_per_trigger=8)
    start(stream, path, checkpoint).awaitTermination()
    return path


@query("snapshot_stream_X1")
def snapshot_stream(d):
    path = _drain(d, d.status_docs, streams.snapshot_stream)
    rows = streams.read_stored(d.spark, path, "station_status")
    return rows.select("capture_id", "station_id", "num_bikes_available", "num_docks_available", "last_reported", "captured_at_utc")


@query("stream_dedupe_X2")
def stream_dedupe(d):
    path = _drain(d, d.status_docs.union(d.status_docs), streams.stream_dedupe)  # every document comes twice
    return streams.read_stored(d.spark, path, "station_status").select("station_id", "last_reported")


@query("stream_scd_X3")
def stream_scd(d):
    path = _drain(d, d.information_docs.union(d.information_docs), streams.stream_scd)
    return streams.read_stored(d.spark, path, "station_information").select("station_id", "name", "lat", "lon", "capacity")


def _event_stream(d: Domain) -> Domain:
    """The same domain with its events table read as a stream."""
    live = Domain(d.spark, d.sf_dir)
    schema = d.table("events").schema
    streamed = d.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d.sf_dir)
    batch = live.table
    live.table = lambda name: streamed if name == "events" else batch(name)
    live.__dict__["stations_total"] = d.stations_total
    return live


def _all_windows(d: Domain, hourly: DataFrame, name: str) -> DataFrame:
    path = scratch_path(d.spark, name)
    streams.replace_windows(hourly, path, scratch_path(d.spark, "offsets")).awaitTermination()
    return streams.read_windows(d.spark, path, hourly)


@query("stream_availability_X4")
def stream_availability(d):
    return _all_windows(d, streams.stream_availability(_event_stream(d).status), "availability")


@query("stream_demand_X5")
def stream_demand(d):
    return _all_windows(d, streams.stream_demand(_event_stream(d).trips), "demand")


@query("stream_late_captures_X4")
def stream_late_captures(d):
    """Hourly availability kept from stored captures: the files land in any order, none is too late."""
    hours = scratch_path(d.spark, "hours")
    _drain(d, d.status_docs, lambda docs, path, checkpoint: streams.stream_captured_hours(docs, path, hours, checkpoint))
    rows = d.spark.read.parquet(hours)
    return rows.select(*H.availability_hourly(d.status).columns)


@query("stream_quality_X6")
def stream_quality(d):
    """The ledger of a stream: its runs by status, with all rows and defect counters."""
    path = _drain(d, d.status_docs, streams.stream_quality)
    return _ledger_totals(streams.collection_runs(d.spark, path))


def _ledger_totals(runs: DataFrame) -> DataFrame:
    counters = ("dup_stations", "negativos", "sin_station_id")
    notes = F.from_json("notes", ", ".join(f"{c} bigint" for c in counters))
    summed = runs.withColumn("n", notes).groupBy("run_type", "status").agg(F.sum("rows_ingested").alias("rows"), *[F.sum(f"n.{c}").alias(c) for c in counters])
    return summed.select("run_type", "status", "rows", *counters)


@query("stream_collection_X6")
def stream_collection(d):
    """Captures stored once although every document comes twice, and the ledger of the runs that stored them."""
    events = scratch_path(d.spark, "events")
    path = _drain(d, d.status_docs.union(d.status_docs), lambda docs, path, checkpoint: streams.stream_collection(docs, path, events, checkpoint))
    stored = streams.read_stored(d.spark, path, "station_status").agg(F.count(F.lit(1)).alias("stored"))
    return _ledger_totals(streams.collection_runs(d.spark, events)).join(stored, F.lit(True))

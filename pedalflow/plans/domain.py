"""Bike-share tables derived from the generic test tables, row by row over the whole of each table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S
from pedalflow.operators import bridge as B
from pedalflow.operators import features as FE
from pedalflow.operators import forecast as FC
from pedalflow.operators import hourly as H
from pedalflow.operators import rebalance as R
from pedalflow.session import prepare, scratch_path
from pedalflow.sources.sinks import read_table, write_table


class Domain:
    """Lazy tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- trips -----------------------------------------------------------------------------

    @cached_property
    def stations_total(self) -> Column:
        return self.table("events").agg(F.expr("max(user_id) div 5 + 1")).scalar()

    def arrival(self) -> Column:
        return F.expr("timestampadd(MICROSECOND, cast(round(value * 60000000) as bigint), ts)")

    def destination(self) -> Column:
        return ((F.col("user_id") * 7 + F.col("event_id")) % self.stations_total).cast("string")

    @cached_property
    def trips_raw(self) -> DataFrame:
        """Raw text rows with every defect; every 50th row occurs twice, the second copy with other riders' data."""
        events = self.table("events").withColumn(
            "copy_no", F.explode(F.expr("IF(event_id % 50 = 0, array(0, 1), array(0))"))
        )
        timed = events.withColumn("arr", F.when(F.expr("event_id % 107 = 0"), F.col("ts")).otherwise(self.arrival()))

        def date_text(ts: str) -> Column:
            return F.expr(
                f"CASE WHEN event_id % 3 = 0 THEN date_format({ts}, 'yyyy-MM-dd') "
                f"WHEN event_id % 7 = 0 THEN date_format({ts}, 'dd-MM-yyyy') ELSE date_format({ts}, 'dd/MM/yyyy') END"
            )

        def time_text(ts: str) -> Column:
            return F.expr(
                f"CASE WHEN event_id % 4 = 0 THEN date_format({ts}, 'HH:mm:ss.SSSSSS') "
                f"WHEN event_id % 4 = 1 THEN date_format({ts}, 'HH:mm') ELSE date_format({ts}, 'HH:mm:ss') END"
            )

        return timed.select(
            F.expr("IF(copy_no = 1, 'O', IF(event_id % 2 = 0, 'M', 'F'))").alias("genero_usuario"),
            F.expr(
                "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 11 = 0 THEN concat(16 + event_id % 60, '.5') "
                "ELSE concat(16 + event_id % 60, '.0') END"
            ).alias("edad_usuario"),
            F.expr("IF(event_id % 109 = 0, 'NaN', cast(event_id % 9000 as string))").alias("bici"),
            F.expr("IF(event_id % 97 = 0, '', cast(user_id div 5 as string))").alias("ciclo_estacion_retiro"),
            F.when(F.expr("event_id % 103 = 0"), F.lit("fecha-mala")).otherwise(date_text("ts")).alias("fecha_retiro"),
            time_text("ts").alias("hora_retiro"),
            F.when(F.expr("event_id % 101 = 0"), F.lit(" ")).otherwise(self.destination()).alias("ciclo_estacion_arribo"),
            date_text("arr").alias("fecha_arribo"),
            time_text("arr").alias("hora_arribo"),
            F.expr("date_format(ts, \"'viajes_'yyyy-MM-dd'.csv'\")").alias("source_file"),
            F.struct("event_id", "copy_no").alias("row_pos"),
        )

    @cached_property
    def trips(self) -> DataFrame:
        """Valid trips straight from events."""
        timed = self.table("events").withColumn("arr", self.arrival())
        minutes = S.duration_min(F.col("ts"), F.col("arr"))
        return timed.select(
            F.col("event_id").cast("string").alias("trip_id"),
            F.expr("cast(event_id % 9000 as string)").alias("bike_id"),
            F.expr("cast(user_id div 5 as string)").alias("origin_station_id"),
            self.destination().alias("dest_station_id"),
            F.col("ts").alias("retiro_ts"),
            F.col("arr").alias("arribo_ts"),
            minutes.alias("duration_min"),
        ).filter(F.col("duration_min").between(1.0, 240.0))

    @cached_property
    def demand(self) -> DataFrame:
        return H.demand_hourly(self.trips)

    # --- stations --------------------------------------------------------------------------

    @cached_property
    def information(self) -> DataFrame:
        """Fifty versions per station; the last ten have one more dock."""
        return self.table("customer").selectExpr("*", "c_custkey div 50 AS num").selectExpr(
            "IF(num % 10 = 7, concat('L', num), cast(num as string)) AS station_id",
            "concat('Estación ', num) AS name",
            "19.40D + (num % 8) * 0.004D AS lat",
            "-99.17D + (num div 8) * 0.004D AS lon",
            "cast(15 + num % 25 + IF(c_custkey % 50 >= 40, 1, 0) as int) AS capacity",
            "cast(c_nationkey as string) AS region_id",
            "c_name AS short_name",
            "timestampadd(HOUR, c_custkey, timestamp_ntz'2024-01-01 00:00:00') AS captured_at_utc",
            "'info' AS run_id",
        )

    @cached_property
    def captures(self) -> DataFrame:
        """Status entries as the feed reports them: negative counts are still there."""
        rows = self.table("events").selectExpr(
            "*", "user_id div 5 AS num", "cast(get_json_object(props, '$.k') as int) AS k"
        )
        return rows.selectExpr(
            "event_id",
            "IF(num % 10 = 7, concat('L', num), cast(num as string)) AS station_id",
            "IF(event_id % 211 = 0, -1, k % 30) AS num_bikes_available",
            "29 - k % 30 AS num_docks_available",
            "true AS is_installed",
            "event_id % 13 <> 0 AS is_renting",
            "event_id % 17 <> 0 AS is_returning",
            "unix_seconds(cast(ts as timestamp)) AS last_reported",
            "ts AS captured_at_utc",
            "ts - INTERVAL 6 HOURS AS captured_at_local",
        )

    @cached_property
    def status(self) -> DataFrame:
        counts = {c: S.null_negatives(F.col(c)) for c in ("num_bikes_available", "num_docks_available")}
        return self.captures.withColumns(
            {
                **counts,
                "capture_id": S.capture_id(F.col("station_id"), F.col("last_reported")),
                "ingested_at_utc": F.col("captured_at_utc"),
                "run_id": F.expr("concat('r', event_id % 3)"),
            }
        )

    @cached_property
    def status_docs(self) -> DataFrame:
        """Feed documents of ten consecutive captures; every 19th entry has no id, every 23rd lacks its counts."""
        entry = F.struct(
            F.expr("IF(event_id % 19 = 0, NULL, station_id)").alias("station_id"),
            F.expr("IF(event_id % 23 = 0, NULL, num_bikes_available)").alias("num_bikes_available"),
            F.expr("IF(event_id % 23 = 0, NULL, num_docks_available)").alias("num_docks_available"),
            F.expr("IF(is_installed, 1, 0)").alias("is_installed"),
            "is_renting",
            F.expr("IF(is_returning, 'yes', 'no')").alias("is_returning"),
            "last_reported",
        )
        docs = self.captures.groupBy(F.expr("event_id div 10").alias("doc_id")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("entry")))), lambda e: e["entry"]).alias(
                "stations"
            ),
            F.max("last_reported").alias("last_updated"),
        )
        return docs.select(
            "doc_id", F.to_json(F.struct("last_updated", F.struct("stations").alias("data"))).alias("doc")
        )

    @cached_property
    def information_docs(self) -> DataFrame:
        """One document per captured version of a station."""
        entry = F.struct("station_id", "name", "lat", "lon", "capacity", "region_id", "short_name")
        return self.information.select(
            F.col("short_name").alias("doc_id"),
            F.to_json(
                F.struct(
                    F.unix_seconds(F.col("captured_at_utc").cast("timestamp")).alias("last_updated"),
                    F.struct(F.array(entry).alias("stations")).alias("data"),
                )
            ).alias("doc"),
        )

    @cached_property
    def availability(self) -> DataFrame:
        return H.availability_hourly(self.status)

    @cached_property
    def bridge(self) -> DataFrame:
        """A stored bridge: some stations unmatched, some pairs of old stations merged into one live station."""
        nums = self.table("customer").selectExpr("c_custkey div 50 AS num").distinct()
        return nums.selectExpr(
            "cast(num as string) AS historico_id",
            "CASE num % 10 WHEN 9 THEN NULL WHEN 5 THEN cast(num - 1 as string) WHEN 7 THEN concat('L', num) "
            "ELSE cast(num as string) END AS gbfs_id",
            "CASE num % 10 WHEN 9 THEN 'unmatched' WHEN 5 THEN 'manual_alias' WHEN 7 THEN 'norm_name' "
            "ELSE 'exact_id' END AS match_method",
            "CASE num % 10 WHEN 9 THEN 0.0D WHEN 7 THEN 0.95D ELSE 1.0D END AS confidence",
        )

    # --- identity catalogues ---------------------------------------------------------------

    @cached_property
    def live_catalog(self) -> DataFrame:
        """One live station per distinct part name."""
        named = self.table("part").groupBy("p_name").agg(F.min("p_partkey").alias("num"))
        return named.selectExpr(
            "cast(num as string) AS gbfs_id",
            "p_name AS nombre",
            "19.40D + (num % 8) * 0.004D AS lat",
            "-99.17D + (num div 8) * 0.004D AS lon",
        )

    @cached_property
    def hist_catalog(self) -> DataFrame:
        """One old station per part: same name in capitals, a similar name, only coordinates, or neither."""
        return self.table("part").selectExpr(
            "cast(p_partkey as string) AS historico_id",
            "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, 's') WHEN 2 THEN NULL "
            "ELSE concat('zz ', p_brand) END AS nombre",
            "CASE WHEN p_partkey % 4 = 2 THEN 19.4003D + (p_partkey % 8) * 0.004D END AS lat",
            "CASE WHEN p_partkey % 4 = 2 THEN -99.1698D + (p_partkey % 5) * 0.004D END AS lon",
        )

    @cached_property
    def aliases(self) -> DataFrame:
        """Old stations of one brand are forced to the live station of their part name."""
        live = self.live_catalog.select(F.col("nombre").alias("p_name"), "gbfs_id")
        forced = self.table("part").filter("p_brand = 'Brand#7'").selectExpr("cast(p_partkey as string) AS historico_id", "p_name")
        return forced.join(live, "p_name").select("historico_id", "gbfs_id")

    # --- features and predictions ----------------------------------------------------------

    @cached_property
    def features(self) -> DataFrame:
        return FE.build_feature_frame(
            self.demand,
            FE.station_meta(self.bridge, self.information),
            FE.recent_availability(self.availability, self.bridge),
        )

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Written and read back, as between the stages of a run: later steps read it several times."""
        path = scratch_path(self.spark, name)
        write_table(df, path)
        return read_table(self.spark, path)

    @cached_property
    def stored_features(self) -> DataFrame:
        return self.stored(self.features, "features")

    @cached_property
    def observed(self) -> DataFrame:
        """The columns of the features that the split and the baseline look at."""
        columns = ("station_id", "ts", "hour", "dow", "salidas", "salidas_roll_mean_24")
        return self.stored(self.features.select(*columns), "observed")

    @cached_property
    def predictions(self) -> DataFrame:
        """Baseline predictions next to a naive forecast, the mean of the day before."""
        bounds = FC.temporal_quantiles(self.observed)
        fitted = self.stored(FC.fit_baseline(FC.training_rows(self.observed, bounds)), "baseline")
        scored = FC.predict_baseline(fitted, FC.assign_split(self.observed, bounds)).withColumn("y_pred_model", F.coalesce("salidas_roll_mean_24", F.lit(0.0)))
        rows = FC.model_predictions(scored, "salidas", "naive_v1", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
        return self.stored(rows, "predictions")

    @cached_property
    def test_predictions(self) -> DataFrame:
        return self.predictions.filter(F.col("split") == "test")

    # --- windows ---------------------------------------------------------------------------

    @cached_property
    def inventory(self) -> DataFrame:
        """Expected inventory at 18:00 of every captured day."""
        return R.expected_inventory(self.information, self.status, self.demand, self.bridge, R.daily_targets(self.status))

    @cached_property
    def state(self) -> DataFrame:
        return self.stored(R.balance_state(self.inventory), "state")

    @cached_property
    def moves(self) -> DataFrame:
        """A stored plan: every reachable pair moves what both sides allow, at most one truck load."""
        pairs = R.candidate_pairs(self.state)
        received = F.least("need", "avail", F.lit(R.MAX_BIKES_PER_MOVE))
        planned = pairs.select(
            "target_ts",
            F.col("donor").alias("donor_station_id"),
            F.col("receiver").alias("receiver_station_id"),
            received.alias("bikes_to_move"),
            S.half_even(F.col("dist"), 1).alias("distance_m"),
            F.col("deficit_before").alias("receiver_deficit_before"),
            F.greatest(F.col("deficit_before") - F.col("need"), F.lit(0.0)).alias("receiver_deficit_after"),
        )
        return self.stored(planned, "moves")

    # --- manifest --------------------------------------------------------------------------

    @cached_property
    def manifest(self) -> DataFrame:
        """One published file per order; every 17th has no period."""
        return self.table("orders").selectExpr(
            "concat('https://data.example.org/', o_orderkey, '.csv') AS url",
            "concat('viajes_', date_format(o_orderdate, 'yyyy-MM'), '_', o_orderkey, '.csv') AS file_name",
            "IF(o_orderkey % 17 = 0, NULL, year(o_orderdate)) AS year",
            "IF(o_orderkey % 17 = 0, NULL, month(o_orderdate)) AS month",
            "o_orderdate AS discovered_at_utc",
            "CASE o_orderstatus WHEN 'F' THEN 'downloaded' WHEN 'O' THEN 'pending' ELSE 'error' END AS download_status",
            "IF(o_orderstatus = 'P', 500, 200) AS http_status",
            "cast(round(o_totalprice * 100) as bigint) AS size_bytes",
            "sha2(cast(o_orderkey as string), 256) AS checksum_sha256",
            "IF(o_orderkey % 13 = 0, NULL, concat('raw/', o_orderkey, '.csv')) AS local_path",
            "IF(o_orderstatus = 'F', o_orderdate + INTERVAL 1 DAY, NULL) AS last_downloaded_at_utc",
        )

    @cached_property
    def file_names(self) -> DataFrame:
        """Names as they were published over the years, one per event."""
        return self.table("events").selectExpr(
            "event_id",
            "CASE event_id % 6 WHEN 0 THEN concat('datos_', year(ts) - event_id % 14, '-', lpad(1 + event_id % 12, 2, '0'), '.csv') "
            "WHEN 1 THEN concat(year(ts) - event_id % 14, '_', lpad(1 + event_id % 14, 2, '0'), '.zip') "
            "WHEN 2 THEN concat('viajes_', element_at(array('Enero','feb','MARZO','abril','mayo','jun','julio','ago','sept','octubre','Nov','diciembre'), "
            "cast(1 + event_id % 12 as int)), '_', year(ts), '.csv') "
            "WHEN 3 THEN concat('septiembre', event_id, '.csv') "
            "WHEN 4 THEN concat('ecos-', year(ts), '.csv') "
            "ELSE concat(event_type, '_', user_id, '.csv') END AS file_name",
        )


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(spark, sf_dir)


def bridge_rows(d: Domain) -> DataFrame:
    """The full cascade on the catalogues, each of which it reads several times."""
    return B.match_stations(d.stored(d.hist_catalog, "hist"), d.stored(d.live_catalog, "live"), d.stored(d.aliases, "aliases"))

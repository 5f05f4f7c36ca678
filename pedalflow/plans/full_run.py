"""The whole run: raw trips and captures to hourly tables, bridge, features, forecast and plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalflow.operators import bridge, cleaning, features, forecast, hourly, metrics, rebalance
from pedalflow.sources.ledger import table_counts
from pedalflow.sources.sinks import read_table, replace_partitions, write_report, write_table


@dataclass(frozen=True)
class RunInputs:
    """Raw trips (canonical text, ``source_file``, ``row_pos``) and the captured station tables."""

    raw_trips: DataFrame
    station_information: DataFrame
    station_status: DataFrame
    catalog: DataFrame | None = None
    aliases: DataFrame | None = None


def run(spark: SparkSession, inputs: RunInputs, out: str, run_id: str, iterations: int = 300) -> dict[str, DataFrame]:
    """Run every stage, cutting the plan at stored tables, and return the tables read back.

    ``out`` must lie on storage shared by all executors: a lost executor costs one stage, not the run.
    """

    def stored(df: DataFrame, name: str, day: str | None = None) -> DataFrame:
        """Write and read back; a table that grows is partitioned by the date of its column ``day``."""
        path = f"{out}/{name}"
        if day is None:
            write_table(df, path)
        else:
            write_table(df.withColumn("date", F.col(day).cast("date")), path, partition_by=["date"])
        return read_table(spark, path).select(*df.columns)

    # the raw rows are read, shuffled and parsed once; trips, rejections and report come from the result
    classified = stored(cleaning.classify_distinct(inputs.raw_trips), "classified")
    tables = {
        "trips_clean": stored(cleaning.clean_of(classified, run_id), "trips_clean", "retiro_ts"),
        "trip_rejections": stored(cleaning.rejections_of(classified, run_id), "trip_rejections"),
    }
    write_report(cleaning.report_of(classified), f"{out}/reports/rejection_report")
    trips = tables["trips_clean"]
    demand = tables["demand_hourly"] = stored(hourly.demand_hourly(trips), "demand_hourly", "date")
    availability = tables["availability_hourly"] = stored(
        hourly.availability_hourly(inputs.station_status), "availability_hourly", "date"
    )
    live = bridge.live_stations(inputs.station_information)
    matched = bridge.match_stations(bridge.historical_stations(trips, inputs.catalog), live, inputs.aliases)
    ids = tables["station_bridge"] = stored(matched, "station_bridge")
    frame = features.build_feature_frame(
        demand,
        features.station_meta(ids, inputs.station_information),
        features.recent_availability(availability, ids),
    )
    model_features = tables["model_features"] = stored(frame, "model_features", "ts")
    trained = forecast.train(model_features, iterations=iterations)
    forecast.save_model(spark, trained, f"{out}/model")
    replace_partitions(trained.predictions(), f"{out}/model_predictions", ["target"])
    predictions = tables["model_predictions"] = read_table(spark, f"{out}/model_predictions")
    write_evaluation(predictions, f"{out}/reports")
    moves, summary = rebalance.build_recommendations(
        inputs.station_information, inputs.station_status, demand, ids
    )
    write_table(moves, f"{out}/rebalance_recommendations")
    tables["rebalance_recommendations"] = spark.read.schema(moves.schema).parquet(f"{out}/rebalance_recommendations")
    tables["rebalance_summary"] = stored(summary, "rebalance_summary")
    return tables


def write_evaluation(predictions: DataFrame, reports: str, target: str = "salidas") -> None:
    """Metric reports of the stored predictions of one target."""
    rows = predictions.filter(predictions["target"] == target)
    test = rows.filter(rows["split"] == "test")
    overall = metrics.metrics_overall(rows)
    write_report(overall, f"{reports}/metrics_overall")
    write_report(metrics.compare_by_group(test, "station_id"), f"{reports}/metrics_by_station")
    by_hour = test.selectExpr("*", "hour(ts) AS hour")
    write_report(metrics.compare_by_group(by_hour, "hour"), f"{reports}/metrics_by_hour")
    write_report(metrics.metrics_peak(test), f"{reports}/metrics_peak_hours")
    write_report(metrics.metrics_top(test), f"{reports}/metrics_top_stations")
    write_report(metrics.evaluation_verdict(overall), f"{reports}/evaluation_summary", "json")


def run_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return table_counts(tables)

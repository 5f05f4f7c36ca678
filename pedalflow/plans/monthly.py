"""The monthly load: new and changed files into the stored tables, with its row in the run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalflow.operators import cleaning
from pedalflow.operators.upserts import new_trips
from pedalflow.plans import incremental
from pedalflow.schemas import SCHEMAS
from pedalflow.session import scratch_path
from pedalflow.sources import ledger, manifest
from pedalflow.sources.csv_files import stage_raw
from pedalflow.sources.sinks import read_table, replace_partitions, write_table

_LOADED = "url string, file_name string, checksum_sha256 string, run_id string"
_EVENTS = "seq int, run_type string, source string, at_utc timestamp_ntz, status string, rows_ingested bigint, notes string, run_id string"
_TABLES = ("trips_raw", "trips_clean", "trip_rejections")


def _ddl(table: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[table].fields)


def stored_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of all loads so far, empty ones before the first."""
    kinds = {**{t: _ddl(t) for t in _TABLES}, "loaded_files": _LOADED, "run_events": _EVENTS}
    tables = {}
    for name, schema in kinds.items():
        spark.createDataFrame([], schema).write.mode("append").partitionBy("run_id").parquet(f"{out}/{name}")
        tables[name] = spark.read.schema(schema).parquet(f"{out}/{name}")
    return tables


def load_month(
    spark: SparkSession,
    raw: DataFrame,
    files: DataFrame,
    out: str,
    run_id: str,
    force: bool = False,
    at: Column | None = None,
    stations: DataFrame | None = None,
    availability_ts: DataFrame | None = None,
) -> None:
    """Load the rows of ``raw`` that belong to ``files`` (manifest rows) and have not been loaded with their checksum.

    Every table is partitioned by run: a load that is repeated under its run id replaces what it wrote before. Hourly
    demand follows the trips, and with ``stations`` (capacity and coordinates) the features follow the demand: only the
    days that the load touches are computed again. A load that fails leaves an ``error`` event in the ledger and the error
    goes on to the caller.
    """
    tables = stored_tables(spark, out)
    earlier = {name: df.filter(F.col("run_id") != run_id) for name, df in tables.items()}
    replace_partitions(ledger.start_run(spark, run_id, "historical_load", "manifest"), f"{out}/run_events", ["run_id"])
    try:
        # every table below needs the list of files: stored once, and small enough to be broadcast to the raw rows
        listed = scratch_path(spark, "todo")
        write_table(manifest.skip_unchanged(files, earlier["loaded_files"], force), listed)
        todo = read_table(spark, listed)
        rows = raw.join(todo.select(F.col("file_name").alias("source_file")).distinct(), "source_file", "left_semi")
        replace_partitions(stage_raw(rows, run_id, at), f"{out}/trips_raw", ["run_id"])
        scratch = scratch_path(spark, "classified")
        cleaning.classify_distinct(rows).write.parquet(scratch)
        classified = spark.read.parquet(scratch)
        # the id of a trip contains its file: only trips of the same files can be there already
        names = todo.select(F.col("file_name").alias("source_file")).distinct()
        fresh = new_trips(cleaning.clean_of(classified, run_id), earlier["trips_clean"].join(names, "source_file", "left_semi"))
        replace_partitions(fresh, f"{out}/trips_clean", ["run_id"])
        replace_partitions(cleaning.rejections_of(classified, run_id, at), f"{out}/trip_rejections", ["run_id"])
        done = todo.select("url", "file_name", "checksum_sha256", F.lit(run_id).alias("run_id"))
        replace_partitions(done, f"{out}/loaded_files", ["run_id"])
        own = spark.read.schema(_ddl("trips_clean")).parquet(f"{out}/trips_clean").filter(F.col("run_id") == run_id)
        touched = incremental.refresh_demand(spark, out, run_id, own)
        if stations is not None:
            incremental.refresh_features(spark, out, run_id, touched, stations, availability_ts)
        loaded = own.count()
        end = ledger.finish_run(spark, run_id, "ok", loaded)
    except Exception as error:
        failed = ledger.finish_run(spark, run_id, "error", 0, f"{type(error).__name__}: {error}"[:1000])
        failed.write.mode("append").partitionBy("run_id").parquet(f"{out}/run_events")
        raise
    end.write.mode("append").partitionBy("run_id").parquet(f"{out}/run_events")


def runs(spark: SparkSession, out: str) -> DataFrame:
    """The ledger: one row for each load."""
    return ledger.current_runs(stored_tables(spark, out)["run_events"])

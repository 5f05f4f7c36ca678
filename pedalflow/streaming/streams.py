"""Structured Streaming jobs over landed feed documents, captures and trips."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pedalflow.functions import scalars as S
from pedalflow.functions.calendar import dow
from pedalflow.operators.hourly import CAPTURE_MINUTES, availability_aggregates, availability_hourly
from pedalflow.operators.upserts import information_rows, new_information_rows, new_status_rows, status_rows
from pedalflow.schemas import SCHEMAS
from pedalflow.session import cut_lineage
from pedalflow.sources import ledger
from pedalflow.sources.feeds import parse_station_information, parse_station_status, status_quality
from pedalflow.sources.sinks import replace_partitions

_DOC_KEYS = ("doc_id", "captured_at_utc")


def document_stream(spark: SparkSession, landing: str, one_per_line: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Landed feed documents as ``doc_id, captured_at_utc, doc``.

    A document is a text of a landed file: equal ones of one file are one document, those of two files are two, in
    whatever batches the files come. The capture time is the document's own ``last_updated``, else the time its file landed.
    """
    lines = (
        spark.readStream.format("text")
        .option("wholetext", not one_per_line)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(landing)
        .select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed"))
    )
    updated = F.get_json_object("doc", "$.last_updated").try_cast("bigint")
    return lines.select(
        F.sha2(F.concat_ws("\n", "file", "doc"), 256).alias("doc_id"),
        F.coalesce(S.epoch_to_utc(updated), F.col("landed").cast("timestamp_ntz")).alias("captured_at_utc"),
        "doc",
    )


# --- stored tables written batch by batch ------------------------------------------------------


def _stored_ddl(table: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[table].fields)


#: What a batch has to read back of a stored table: captures by day, station versions by the hash of the station.
_PARTS = {"station_status": "day date", "station_information": "bucket int"}
_BUCKETS = 256


def read_stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table written by the streams below, with its partition columns: ``day`` or ``bucket``, and ``batch_key``."""
    return spark.read.schema(f"{_stored_ddl(table)}, {_PARTS[table]}, batch_key string").parquet(path)


def _ensure_table(spark: SparkSession, path: str, table: str) -> None:
    """Create the folder on the first run, so that the first batch can read an empty table."""
    empty = spark.createDataFrame([], f"{_stored_ddl(table)}, {_PARTS[table]}, batch_key string")
    empty.write.mode("append").partitionBy(_PARTS[table].split()[0], "batch_key").parquet(path)


def _batch_key(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Stream and batch: equal for a replay, new for a stream that starts over with another checkpoint.

    Batch numbers alone begin at 0 again then, and would overwrite what the earlier stream stored.
    """
    stream = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
    return f"{stream}-{batch_id}"


def _write_batch(rows: DataFrame, path: str, part: str, value: Column, batch_key: str) -> int:
    """Write the rows of a batch and give their number; a replayed batch replaces exactly the partitions it wrote before."""
    seen = Observation(f"written-{batch_key}")
    stamped = rows.withColumns({part: value, "batch_key": F.lit(batch_key)})
    replace_partitions(stamped, path, [part, "batch_key"], seen, [F.count(F.lit(1)).alias("rows")])
    return seen.get["rows"]


def first_captures(rows: DataFrame) -> DataFrame:
    """Of captures with equal (station, last_reported) the earliest; captures without a time all stay."""
    undated = rows.filter(F.col("last_reported").isNull())
    dated = (
        rows.filter(F.col("last_reported").isNotNull())
        .groupBy("station_id", "last_reported")
        .agg(F.min_by(F.struct(*rows.columns), F.struct("captured_at_utc", F.hash(*rows.columns))).alias("r"))
        .select("r.*")
    )
    return dated.unionByName(undated)


def _status_day() -> Column:
    return F.coalesce(S.epoch_to_utc(F.col("last_reported")), F.col("captured_at_utc")).cast("date")


def append_status(rows: DataFrame, path: str, batch_key: str) -> int:
    """Append captures the table does not hold, exact against all history, and give their number.

    Equal captures share their day, so only the very days of this batch are read back: one odd time costs one day.
    """
    fresh = cut_lineage(first_captures(rows).withColumn("day", _status_day()))
    if fresh.isEmpty():
        return 0
    stored = read_stored(rows.sparkSession, path, "station_status").filter(F.col("batch_key") != batch_key)
    stored = stored.join(fresh.select("day").distinct(), "day", "left_semi")
    return _write_batch(new_status_rows(fresh.drop("day"), stored), path, "day", _status_day(), batch_key)


def _bucket() -> Column:
    return F.pmod(F.hash("station_id"), F.lit(_BUCKETS))


def versions_of(spark: SparkSession, path: str, stations: DataFrame) -> DataFrame:
    """The stored versions in the hash buckets of the given stations; other buckets are not read."""
    buckets = [r[0] for r in stations.select(_bucket().alias("bucket")).distinct().collect()]  # as many as there are buckets at most
    return read_stored(spark, path, "station_information").filter(F.col("bucket").isin(buckets))


def append_information(rows: DataFrame, path: str, batch_key: str, against: str = "any") -> None:
    """Append station versions that differ from what is stored, the first of equal ones in a batch.

    The table is partitioned by the hash of the station, so a batch reads the buckets of its own stations.
    """
    state = ["station_id", "name", "lat", "lon", "capacity"]
    others = [c for c in rows.columns if c not in state]
    first = cut_lineage(rows.groupBy(*state).agg(F.min_by(F.struct(*others), "captured_at_utc").alias("r")).select(*state, "r.*"))
    stored = versions_of(rows.sparkSession, path, first).filter(F.col("batch_key") != batch_key)
    fresh = new_information_rows(first.select(*rows.columns), stored, against)
    _write_batch(fresh, path, "bucket", _bucket(), batch_key)


def _run(
    stream: DataFrame, each_batch: Callable[[DataFrame, str], None], checkpoint: str, available_now: bool
) -> StreamingQuery:
    def load(batch: DataFrame, batch_id: int) -> None:
        # files are never split over batches, so this sees all copies within a file
        each_batch(batch.dropDuplicates(["doc_id"]), _batch_key(batch.sparkSession, checkpoint, batch_id))

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 minutes")).start()


def snapshot_stream(docs: DataFrame, path: str, checkpoint: str, run_id: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Every parsed status row of every document, as it arrives."""
    _ensure_table(docs.sparkSession, path, "station_status")

    def load(batch: DataFrame, batch_key: str) -> None:
        rows = status_rows(parse_station_status(batch, _DOC_KEYS), run_id, F.col("captured_at_utc"))
        _write_batch(rows, path, "day", _status_day(), batch_key)

    return _run(docs, load, checkpoint, available_now)


def stream_dedupe(docs: DataFrame, path: str, checkpoint: str, run_id: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Status rows once per (station, last_reported), however often and late a document comes back."""
    _ensure_table(docs.sparkSession, path, "station_status")

    def load(batch: DataFrame, batch_key: str) -> None:
        append_status(status_rows(parse_station_status(batch, _DOC_KEYS), run_id, F.col("captured_at_utc")), path, batch_key)

    return _run(docs, load, checkpoint, available_now)


def stream_scd(
    docs: DataFrame, path: str, checkpoint: str, run_id: str = "stream", against: str = "any", available_now: bool = True
) -> StreamingQuery:
    """Station information, appended when it changes."""
    _ensure_table(docs.sparkSession, path, "station_information")

    def load(batch: DataFrame, batch_key: str) -> None:
        rows = information_rows(parse_station_information(batch, _DOC_KEYS), run_id, F.col("captured_at_utc"))
        append_information(rows, path, batch_key, against)

    return _run(docs, load, checkpoint, available_now)


# --- collection runs with their ledger ---------------------------------------------------------

_EVENTS = "run_id string, seq int, run_type string, source string, at_utc timestamp_ntz, status string, rows_ingested bigint, notes string"
_DEFECTS = ("dup_stations", "negativos", "sin_station_id")


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """The ledger events that the streams have written, one partition for each run."""
    spark.createDataFrame([], _EVENTS).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.schema(_EVENTS).parquet(path)


def collection_runs(spark: SparkSession, path: str) -> DataFrame:
    """``ingestion_runs``: a row for each micro-batch with its status, rows and notes."""
    return ledger.current_runs(stored_events(spark, path))


def _in_ledger(batch: DataFrame, ledger_path: str, run_id: str, source: str, work: Callable[[], tuple[int, dict[str, int]]]) -> None:
    """Run ``work`` as one run of the ledger: its start before, ``ok`` with rows and counters or ``error`` after.

    The run is named by stream and batch and its events are one partition: a batch that is repeated replaces them.
    """
    spark = batch.sparkSession
    start = ledger.start_run(spark, run_id, "gbfs", source)
    replace_partitions(start, ledger_path, ["run_id"])
    try:
        rows, counters = work()
        end = ledger.finish_run(spark, run_id, "ok", rows, json.dumps(counters))
    except Exception as error:
        end = ledger.finish_run(spark, run_id, "error", 0, f"{type(error).__name__}: {error}"[:1000])
        replace_partitions(start.unionByName(end), ledger_path, ["run_id"])
        raise
    replace_partitions(start.unionByName(end), ledger_path, ["run_id"])


def stream_collection(
    docs: DataFrame, path: str, ledger_path: str, checkpoint: str, source: str = "stream", available_now: bool = True
) -> StreamingQuery:
    """Status documents into the table, once per (station, last_reported), each micro-batch with its row in the ledger.

    Rows that were really added are counted while they are written. Notes hold the documents and their defects.
    """
    _ensure_table(docs.sparkSession, path, "station_status")

    def load(batch: DataFrame, batch_key: str) -> None:
        def work() -> tuple[int, dict[str, int]]:
            defects = status_quality(batch, _DOC_KEYS).agg(F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _DEFECTS])
            counters = defects.first().asDict()
            rows = status_rows(parse_station_status(batch, _DOC_KEYS), batch_key, F.col("captured_at_utc"))
            return append_status(rows, path, batch_key), counters

        _in_ledger(batch, ledger_path, batch_key, source, work)

    return _run(docs, load, checkpoint, available_now)


def stream_quality(docs: DataFrame, ledger_path: str, checkpoint: str, source: str = "stream", available_now: bool = True) -> StreamingQuery:
    """A row of the ledger for each micro-batch: its documents as rows, its defect counters as notes; nothing else is stored."""

    def load(batch: DataFrame, batch_key: str) -> None:
        def work() -> tuple[int, dict[str, int]]:
            found = status_quality(batch, _DOC_KEYS).agg(F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _DEFECTS])
            counters = found.first().asDict()
            return counters.pop("documents"), counters

        _in_ledger(batch, ledger_path, batch_key, source, work)

    return _run(docs, load, checkpoint, available_now)


# --- windowed aggregates -----------------------------------------------------------------------


def bounded_dedupe(captures: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Duplicates dropped within the watermark only: bounded state, exact while copies arrive in time."""
    timed = captures.withColumn("event_time", F.col("captured_at_utc").cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["station_id", "last_reported"])


def stream_availability(captures: DataFrame, delay: str = "2 hours", capture_minutes: float = CAPTURE_MINUTES) -> DataFrame:
    """Hourly availability as tumbling windows; captures later than ``delay`` are dropped."""
    timed = captures.withColumn("event_time", F.col("captured_at_local").cast("timestamp")).withWatermark("event_time", delay)
    hourly = timed.groupBy("station_id", F.window("event_time", "1 hour")).agg(
        *availability_aggregates(F.col("event_time"), capture_minutes)
    )
    start = F.col("window.start").cast("timestamp_ntz")
    measures = [c for c in hourly.columns if c not in ("station_id", "window")]
    return hourly.select("station_id", start.cast("date").alias("date"), F.hour(start).alias("hour"), *measures)


def stream_demand(trips: DataFrame, delay: str = "5 hours") -> DataFrame:
    """Hourly demand as tumbling windows over both trip ends.

    A trip is known when it ends, so ``delay`` must cover the longest trip.
    """
    ends = trips.select(
        F.inline(
            F.array(
                F.struct(F.col("origin_station_id").alias("station_id"), F.col("retiro_ts").cast("timestamp").alias("event_time"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dest_station_id").alias("station_id"), F.col("arribo_ts").cast("timestamp").alias("event_time"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    hourly = (
        ends.withWatermark("event_time", delay)
        .groupBy("station_id", F.window("event_time", "1 hour"))
        .agg(F.sum("o").alias("salidas"), F.sum("i").alias("llegadas"))
    )
    start = F.col("window.start").cast("timestamp_ntz")
    return hourly.select(
        "station_id",
        start.cast("date").alias("date"),
        F.hour(start).alias("hour"),
        dow(start).alias("dow"),
        "salidas",
        "llegadas",
        (F.col("llegadas") - F.col("salidas")).alias("flujo_neto"),
        F.col("salidas").alias("demanda_atendida"),
    )


def replace_windows(hourly: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Hourly rows as they stand after every batch, open hours included, for ``read_windows``.

    A batch only adds: its rows are partitions of their own, which a repeated batch replaces, and the newest row of an hour
    is found when the table is read. A job that dies at any point has lost nothing and leaves nothing half replaced.
    """
    spark = hourly.sparkSession
    spark.createDataFrame([], _window_schema(hourly)).write.mode("append").partitionBy("date", "batch_key").parquet(path)

    def load(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumns({"written_at": F.localtimestamp(), "batch_key": F.lit(_batch_key(batch.sparkSession, checkpoint, batch_id))})
        replace_partitions(stamped, path, ["date", "batch_key"])

    return (
        hourly.writeStream.outputMode("update")
        .foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _window_schema(hourly: DataFrame) -> str:
    return ", ".join(f"{n} {kind}" for n, kind in hourly.dtypes) + ", written_at timestamp_ntz, batch_key string"


def read_windows(spark: SparkSession, path: str, hourly: DataFrame, days: list[date] | None = None) -> DataFrame:
    """The newest row of every station hour of a table of ``replace_windows``, of all days or of some."""
    rows = spark.read.schema(_window_schema(hourly)).parquet(path)
    if days is not None:
        rows = rows.filter(F.col("date").isin(days))
    keys = ["station_id", "date", "hour"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in hourly.columns if c not in keys]), F.struct("written_at", "batch_key")).alias("r"))
    return newest.select(*keys, "r.*").select(*hourly.columns)


def close_days(spark: SparkSession, path: str, closed: str, hourly: DataFrame, days: list[date]) -> None:
    """Write the rows of days that are over into a table of their own, one partition for each: no batches left to resolve."""
    if days:
        replace_partitions(read_windows(spark, path, hourly, days), closed, ["date"])


def stream_captured_hours(docs: DataFrame, path: str, hours: str, checkpoint: str, run_id: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Captures into the table at ``path`` and hourly availability into ``hours``, however late a capture comes.

    There is no watermark: the days that a batch's captures belong to are computed again from all stored captures of these
    days and replace their partitions, so the table is at any time the batch result over everything that has arrived.
    """
    _ensure_table(docs.sparkSession, path, "station_status")

    def load(batch: DataFrame, batch_key: str) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(status_rows(parse_station_status(batch, _DOC_KEYS), run_id, F.col("captured_at_utc")))
        append_status(rows, path, batch_key)
        local = F.col("captured_at_local").cast("date")
        days = sorted(r[0] for r in rows.filter(local.isNotNull()).select(local).distinct().collect())
        if days:
            stored = read_stored(spark, path, "station_status").filter(local.isin(days))
            replace_partitions(availability_hourly(stored), hours, ["date"])

    return _run(docs, load, checkpoint, available_now)


def append_closed_windows(hourly: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished windows as they close; the file sink commits each batch exactly once."""
    return (
        hourly.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

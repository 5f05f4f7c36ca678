"""Run ledger: append-only events, the current state is the last event of a run."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalflow.schemas import conform

_EVENT = "run_id string, seq int, run_type string, source string, at_utc timestamp_ntz, status string, rows_ingested bigint, notes string"


def new_run_id(prefix: str) -> str:
    """Unique and sortable by time."""
    return f"{prefix}_{datetime.now(UTC):%Y%m%dT%H%M%S}_{uuid.uuid4().hex[:8]}"


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def start_run(spark: SparkSession, run_id: str, run_type: str, source: str | None = None) -> DataFrame:
    return spark.createDataFrame([(run_id, 0, run_type, source, _now(), "running", None, None)], _EVENT)


def finish_run(
    spark: SparkSession, run_id: str, status: str, rows_ingested: int = 0, notes: str | None = None
) -> DataFrame:
    return spark.createDataFrame([(run_id, 1, None, None, _now(), status, rows_ingested, notes)], _EVENT)


def current_runs(events: DataFrame) -> DataFrame:
    """One row per run: type and source of its start, status, counts and notes of its last event."""
    state = events.groupBy("run_id").agg(
        F.min_by(F.struct("run_type", "source", "at_utc"), F.struct("seq", "at_utc")).alias("first"),
        F.max_by(F.struct("status", "rows_ingested", "notes"), F.struct("seq", "at_utc")).alias("last"),
        F.max(F.when(F.col("seq") > 0, F.col("at_utc"))).alias("finished_at_utc"),
    )
    return conform(
        state.select(
            "run_id",
            "first.run_type",
            "first.source",
            F.col("first.at_utc").alias("started_at_utc"),
            "finished_at_utc",
            "last.status",
            "last.rows_ingested",
            "last.notes",
        ),
        "ingestion_runs",
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, one row each."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    combined = counts[0]
    for count in counts[1:]:
        combined = combined.unionByName(count)
    return combined

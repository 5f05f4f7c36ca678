from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pedalflow.plans import monthly

VALID = {"source_file": "a.csv"}


@pytest.fixture
def files(spark):
    def build(*rows):
        return spark.createDataFrame([(f"u/{n}", n, c) for n, c in rows], "url string, file_name string, checksum_sha256 string")

    return build


def counts(spark, out):
    tables = monthly.stored_tables(spark, out)
    return {name: tables[name].count() for name in ("trips_raw", "trips_clean", "trip_rejections", "loaded_files")}


def test_a_file_is_loaded_once_for_each_checksum(spark, tmp_path, raw_trips, files):
    raw = raw_trips(VALID, {**VALID, "bici": ""}, {"source_file": "b.csv"})
    out = str(tmp_path / "out")
    monthly.load_month(spark, raw, files(("a.csv", "1")), out, "r1")
    first = counts(spark, out)
    assert first == {"trips_raw": 2, "trips_clean": 1, "trip_rejections": 1, "loaded_files": 1}
    monthly.load_month(spark, raw, files(("a.csv", "1")), out, "r2")
    assert counts(spark, out) == first
    monthly.load_month(spark, raw, files(("a.csv", "1"), ("b.csv", "1")), out, "r3")
    assert counts(spark, out) == {"trips_raw": 3, "trips_clean": 2, "trip_rejections": 1, "loaded_files": 2}
    monthly.load_month(spark, raw, files(("a.csv", "2")), out, "r4")  # changed at its source: staged, no trip twice
    assert counts(spark, out)["trips_clean"] == 2 and counts(spark, out)["loaded_files"] == 3
    ledger = {r["run_id"]: (r["status"], r["rows_ingested"]) for r in monthly.runs(spark, out).collect()}
    assert ledger == {"r1": ("ok", 1), "r2": ("ok", 0), "r3": ("ok", 1), "r4": ("ok", 0)}


def test_a_load_that_is_repeated_replaces_itself(spark, tmp_path, raw_trips, files):
    raw, out = raw_trips(VALID, {**VALID, "bici": "7"}), str(tmp_path / "out")
    for _ in range(2):
        monthly.load_month(spark, raw, files(("a.csv", "1")), out, "r1")
    assert counts(spark, out) == {"trips_raw": 2, "trips_clean": 2, "trip_rejections": 0, "loaded_files": 1}
    assert monthly.runs(spark, out).count() == 1


def test_a_load_that_fails_is_in_the_ledger(spark, tmp_path, raw_trips, files):
    out = str(tmp_path / "out")
    with pytest.raises(Exception):
        monthly.load_month(spark, raw_trips(VALID).drop("bici"), files(("a.csv", "1")), out, "r1")
    row = monthly.runs(spark, out).first()
    assert row["status"] == "error" and "bici" in row["notes"]
    assert counts(spark, out)["loaded_files"] == 0


def test_the_list_of_files_is_worked_out_once(spark, tmp_path, raw_trips, files):
    read = spark.sparkContext.accumulator(0)

    def seen(url):
        read.add(1)
        return url

    listed = files(("a.csv", "1"), ("b.csv", "1")).withColumn("url", F.udf(seen, "string")("url"))
    monthly.load_month(spark, raw_trips(VALID, {"source_file": "b.csv"}), listed, str(tmp_path / "out"), "r1")
    assert read.value == 2 and counts(spark, str(tmp_path / "out"))["loaded_files"] == 2

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pedalflow.operators import hourly as H
from pedalflow.streaming import streams


def land(folder, name, stations, updated):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"last_updated": updated, "data": {"stations": stations}}))


def entry(sid, bikes, reported, **kw):
    return {"station_id": sid, "num_bikes_available": bikes, "num_docks_available": 5, "last_reported": reported, **kw}


T0 = 1_700_000_000


def test_captures_are_stored_once(spark, tmp_path):
    landing, table, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")

    def poll():
        streams.stream_dedupe(streams.document_stream(spark, str(landing)), table, offsets, "r").awaitTermination()
        return {(r["station_id"], r["last_reported"], r["num_bikes_available"]) for r in streams.read_stored(spark, table, "station_status").collect()}

    land(landing, "1.json", [entry("1", 5, T0), entry("2", -1, T0 + 50), entry("2", 9, T0 + 50)], T0 + 60)
    first = poll()
    assert first == {("1", T0, 5), ("2", T0 + 50, None)}
    land(landing, "2.json", [entry("1", 7, T0), entry("2", 3, T0 + 50)], T0 + 120)  # nothing new
    assert poll() == first
    land(landing, "3.json", [entry("1", 2, T0 + 999), entry("3", 1, None)], T0 + 1000)
    land(landing, "4.json", [entry("1", 8, T0 + 999), entry("3", 1, None)], T0 + 1300)
    got = streams.read_stored(spark, table, "station_status") if poll() else None
    assert got.count() == 5  # captures without a report time always load
    assert got.filter("station_id = '1' AND last_reported = 1700000999").first()["num_bikes_available"] == 2


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    streams._ensure_table(spark, path, "station_status")
    docs = spark.createDataFrame(
        [("d", dt.datetime(2023, 11, 14, 22), json.dumps({"data": {"stations": [entry("1", 5, T0)]}}))],
        "doc_id string, captured_at_utc timestamp_ntz, doc string",
    )
    from pedalflow.operators.upserts import status_rows
    from pedalflow.sources.feeds import parse_station_status

    rows = status_rows(parse_station_status(docs, ("doc_id", "captured_at_utc")), "r", F.col("captured_at_utc"))
    for _ in range(2):
        streams.append_status(rows, path, "s-7")
    assert streams.read_stored(spark, path, "station_status").count() == 1
    streams.append_status(rows, path, "s-8")
    assert streams.read_stored(spark, path, "station_status").count() == 1


def test_a_stream_that_starts_over_keeps_what_is_stored(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "out")
    land(landing, "1.json", [entry("1", 5, T0), entry("2", 6, None)], T0 + 60)

    def poll(offsets):
        streams.stream_dedupe(streams.document_stream(spark, str(landing)), table, str(tmp_path / offsets)).awaitTermination()
        return sorted(r["station_id"] for r in streams.read_stored(spark, table, "station_status").collect())

    assert poll("a") == ["1", "2"]
    land(landing, "2.json", [entry("3", 5, T0 + 5)], T0 + 90)
    assert poll("b") == ["1", "2", "2", "3"]  # undated captures load again, nothing stored is lost


def test_information_is_stored_on_change(spark, tmp_path):
    landing, table, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")

    def poll():
        streams.stream_scd(streams.document_stream(spark, str(landing)), table, offsets).awaitTermination()
        return streams.read_stored(spark, table, "station_information").count()

    station = {"station_id": "1", "name": "A", "lat": 1.5, "lon": 2.5, "capacity": None}
    land(landing, "1.json", [station], T0)
    assert poll() == 1
    land(landing, "2.json", [station], T0 + 1)
    assert poll() == 1
    land(landing, "3.json", [{**station, "capacity": 10}], T0 + 2)
    assert poll() == 2


def test_a_batch_reads_the_versions_of_its_own_stations_only(spark, tmp_path):
    landing, table, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    stations = [{"station_id": str(i), "name": f"S{i}", "lat": 1.5, "lon": 2.5, "capacity": i} for i in range(40)]
    land(landing, "1.json", stations, T0)
    streams.stream_scd(streams.document_stream(spark, str(landing)), table, offsets).awaitTermination()
    everything = streams.read_stored(spark, table, "station_information").inputFiles()
    few = spark.createDataFrame([("3",), ("17",)], "station_id string")
    seen = streams.versions_of(spark, table, few)
    wanted = {r[0] for r in few.select(streams._bucket()).collect()}
    assert {r["bucket"] for r in seen.collect()} == wanted
    assert "PartitionFilters: [bucket" in seen._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket), ", "")
    assert len({f for f in everything if any(f"bucket={b}/" in f for b in wanted)}) <= 2 < len(everything)
    land(landing, "2.json", [{**stations[3], "capacity": 99}, stations[17]], T0 + 9)
    streams.stream_scd(streams.document_stream(spark, str(landing)), table, offsets).awaitTermination()
    assert streams.read_stored(spark, table, "station_information").count() == 41


def test_quality_ledger(spark, tmp_path):
    landing, events = tmp_path / "in", str(tmp_path / "out")
    land(landing, "1.json", [entry("1", -5, T0), entry("1", 5, T0), {"num_bikes_available": 1}], T0)
    streams.stream_quality(streams.document_stream(spark, str(landing)), events, str(tmp_path / "o")).awaitTermination()
    (row,) = streams.collection_runs(spark, events).collect()
    assert (row["run_type"], row["status"], row["rows_ingested"]) == ("gbfs", "ok", 1) and row["finished_at_utc"] is not None
    assert json.loads(row["notes"]) == {"dup_stations": 1, "negativos": 1, "sin_station_id": 1}


def test_a_collection_has_one_ledger_row_for_each_batch(spark, tmp_path, monkeypatch):
    landing, table, events, offsets = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "e"), str(tmp_path / "o")

    def poll():
        streams.stream_collection(streams.document_stream(spark, str(landing)), table, events, offsets, "feed").awaitTermination()
        return sorted((r["status"], r["rows_ingested"], r["source"]) for r in streams.collection_runs(spark, events).collect())

    land(landing, "1.json", [entry("1", 5, T0), entry("2", -1, T0 + 50)], T0 + 60)
    assert poll() == [("ok", 2, "feed")]
    land(landing, "2.json", [entry("1", 7, T0), entry("3", 3, T0 + 50)], T0 + 120)
    whole = streams.append_status
    monkeypatch.setattr(streams, "append_status", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        poll()
    rows = {r["status"]: r for r in streams.collection_runs(spark, events).collect()}
    assert set(rows) == {"ok", "error"} and "ZeroDivisionError" in rows["error"]["notes"]
    monkeypatch.setattr(streams, "append_status", whole)
    assert poll() == [("ok", 1, "feed"), ("ok", 2, "feed")]  # the repeated batch has replaced its error
    assert streams.read_stored(spark, table, "station_status").count() == 3


def test_closed_windows_equal_the_batch_result(spark, tmp_path):
    rows = [("1", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i % 5 or None, i % 3) for i in range(200)]
    schema = "station_id string, captured_at_local timestamp_ntz, num_bikes_available int, num_docks_available int"
    batch = spark.createDataFrame(rows, schema)
    source = str(tmp_path / "src")
    batch.coalesce(1).write.parquet(source)
    hourly = streams.stream_availability(spark.readStream.schema(batch.schema).parquet(source), "2 hours")
    path = str(tmp_path / "out")
    streams.append_closed_windows(hourly, path, str(tmp_path / "o")).awaitTermination()
    last = rows[-1][1] - dt.timedelta(hours=2)
    want = {tuple(r) for r in H.availability_hourly(batch).collect() if dt.datetime.combine(r["date"], dt.time(r["hour"])) + dt.timedelta(hours=1) <= last}
    assert {tuple(r) for r in spark.read.parquet(path).select(*H.availability_hourly(batch).columns).collect()} == want


def test_bounded_dedupe(spark, tmp_path):
    rows = [("1", 10, dt.datetime(2024, 1, 1, 0)), ("1", 10, dt.datetime(2024, 1, 1, 0, 30)), ("1", 11, dt.datetime(2024, 1, 1, 1))]
    batch = spark.createDataFrame(rows, "station_id string, last_reported bigint, captured_at_utc timestamp_ntz")
    source, path = str(tmp_path / "src"), str(tmp_path / "out")
    batch.write.parquet(source)
    kept = streams.bounded_dedupe(spark.readStream.schema(batch.schema).parquet(source))
    streams.append_closed_windows(kept, path, str(tmp_path / "o")).awaitTermination()
    assert sorted(r["last_reported"] for r in spark.read.parquet(path).collect()) == [10, 11]


@pytest.mark.parametrize("files_per_trigger", [1, 2, 10])
def test_documents_do_not_depend_on_the_size_of_a_batch(spark, tmp_path, files_per_trigger):
    for name in ("1.json", "2.json", "3.json", "4.json"):  # equal texts of four files are four documents
        land(tmp_path / "in", name, [entry("1", 5, T0), entry("2", -1, T0 + 50)], T0 + 60)
    docs = streams.document_stream(spark, str(tmp_path / "in"), files_per_trigger=files_per_trigger)
    streams.snapshot_stream(docs, str(tmp_path / "rows"), str(tmp_path / "o1")).awaitTermination()
    assert streams.read_stored(spark, str(tmp_path / "rows"), "station_status").count() == 8
    streams.stream_quality(docs, str(tmp_path / "quality"), str(tmp_path / "o2")).awaitTermination()
    runs = streams.collection_runs(spark, str(tmp_path / "quality")).collect()
    assert (sum(r["rows_ingested"] for r in runs), sum(json.loads(r["notes"])["negativos"] for r in runs)) == (4, 4)


def test_open_hours_are_written_and_corrected(spark, tmp_path):
    schema = "station_id string, captured_at_local timestamp_ntz, num_bikes_available int, num_docks_available int"
    rows = [("1", dt.datetime(2024, 1, 1, 10, m), m // 10, 5) for m in (0, 20, 40)] + [("1", dt.datetime(2024, 1, 1, 23, 55), 0, 5)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # nothing new changes nothing
        hourly = streams.stream_availability(source)
        streams.replace_windows(hourly, out, str(tmp_path / "o")).awaitTermination()
        got = {r["hour"]: (r["n_captures"], r["bikes_max"]) for r in streams.read_windows(spark, out, hourly).collect()}
        assert got == {10: (3, 4), 23: (1, 0)}
    day = [dt.date(2024, 1, 1)]
    streams.close_days(spark, out, str(tmp_path / "closed"), hourly, day)
    closed = spark.read.parquet(str(tmp_path / "closed")).select(*hourly.columns)
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, streams.read_windows(spark, out, hourly, day).collect()))


def test_a_batch_of_windows_replaces_nothing_it_does_not_hold(spark, tmp_path):
    schema = "station_id string, date date, hour int, n bigint"
    path, day = str(tmp_path / "w"), dt.date(2024, 1, 1)
    hourly = spark.createDataFrame([], schema)

    def write(rows, key, at):
        batch = spark.createDataFrame(rows, schema).withColumns({"written_at": F.lit(at), "batch_key": F.lit(key)})
        streams.replace_partitions(batch, path, ["date", "batch_key"])

    write([("1", day, 5, 1), ("2", day, 5, 1)], "s-0", dt.datetime(2024, 1, 2))
    for _ in range(2):
        write([("1", day, 5, 2), ("1", day, 6, 1)], "s-1", dt.datetime(2024, 1, 3))
    got = {(r["station_id"], r["hour"]): r["n"] for r in streams.read_windows(spark, path, hourly).collect()}
    assert got == {("1", 5): 2, ("2", 5): 1, ("1", 6): 1}


def test_a_capture_three_days_late_ends_in_the_batch_result(spark, tmp_path):
    landing, table, hours, offsets = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "h"), str(tmp_path / "o")
    day = 86_400
    files = [("1.json", T0), ("2.json", T0 + 3 * day), ("3.json", T0 + 600), ("4.json", T0 + 3 * day + 300)]
    for name, at in files:
        land(landing, name, [entry("1", at % 7, at), entry("2", 0, at)], at)
        streams.stream_captured_hours(streams.document_stream(spark, str(landing)), table, hours, offsets).awaitTermination()
    want = H.availability_hourly(streams.read_stored(spark, table, "station_status"))
    got = spark.read.parquet(hours).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and sum(r["n_captures"] for r in got.collect()) == 8

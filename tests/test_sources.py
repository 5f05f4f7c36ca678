from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from pedalflow.operators import cleaning as CL
from pedalflow.operators import upserts as U
from pedalflow.sources import csv_files, feeds, ledger, manifest, pages, sinks

HEADER = "Genero_Usuario,Edad_Usuario,Bici,Ciclo_Estacion_Retiro,Fecha_Retiro,Hora_Retiro,Ciclo_EstacionArribo,Fecha_Arribo,Hora_Arribo"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_files_of_any_header_and_encoding(spark, tmp_path):
    a = write(tmp_path / "2026-01.csv", HEADER + '\nM,30,"0,69",85,16/02/2010,12:00:00,26,16/02/2010,12:15:00\n,,,,,,,,\n')
    b = write(tmp_path / "2010-02.csv", "Género_Usuario,Bici,Id_Bici,Estacion_Retiro\nNiño,1,2,3\n", "latin-1")
    c = write(tmp_path / "2011-02.csv", "﻿Género_Usuario,Bici\nNiño,1\n")
    rows = {(r["source_file"], r["bici"]): r for r in csv_files.read_raw_files(spark, [a, b, c]).collect()}
    first = rows["2026-01.csv", "0,69"]
    assert (first["genero_usuario"], first["ciclo_estacion_arribo"], first["hora_arribo"]) == ("M", "26", "12:15:00")
    assert rows["2026-01.csv", ""]["edad_usuario"] == ""
    latin = rows["2010-02.csv", "1"]
    assert (latin["genero_usuario"], latin["ciclo_estacion_retiro"], latin["edad_usuario"]) == ("Niño", "3", None)
    assert rows["2011-02.csv", "1"]["genero_usuario"] == "Niño"


def test_known_encoding_reads_headers_only(spark, tmp_path):
    a = write(tmp_path / "a.csv", "Género_Usuario,Bici\nNiño,1\n", "latin-1")
    b = write(tmp_path / "b.csv", "Bici,Hora_Retiro\n2,x\n", "latin-1")
    rows = {r["bici"]: r for r in csv_files.read_raw_files(spark, [a, b], encoding="ISO-8859-1").collect()}
    assert rows["1"]["genero_usuario"] == "Niño" and rows["2"]["genero_usuario"] is None and rows["2"]["hora_retiro"] == "x"


def test_file_order_decides_which_copy_stays(spark, tmp_path):
    row = "{g},30,7,85,16/02/2010,12:00:00,26,16/02/2010,12:15:00\n"
    path = write(tmp_path / "x.csv", HEADER + "\n" + "".join(row.format(g=g) for g in "ABC"))
    raw = csv_files.read_raw_files(spark, [path])
    assert [r["genero"] for r in CL.trips_clean(raw, "r").collect()] == ["A"]
    assert CL.trip_rejections(raw, "r").count() == 2


def test_staging_appends_with_lineage(spark, raw_trips, tmp_path):
    path = str(tmp_path / "raw")
    for run in ("r1", "r2"):
        sinks.write_table(csv_files.stage_raw(raw_trips({}, {"bici": "2"}), run), path, "append", ["source_file"])
    stored = sinks.read_table(spark, path)
    assert stored.count() == 4 and stored.select("row_hash").distinct().count() == 2


def test_alias_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'historico_id,gbfs_id,nombre_referencia,nota\n# comment, x\n27,L27,"Reforma, 1",n\n28,,x,y\n')
    assert [tuple(r) for r in csv_files.read_aliases(spark, path).collect()] == [("27", "L27")]


def docs(spark, *payloads):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "doc_id int, doc string")


STATUS = {
    "data": {
        "stations": [
            {"station_id": "1", "num_bikes_available": 5, "num_docks_available": 10, "is_installed": 1, "is_renting": True, "is_returning": "1", "last_reported": 1_700_000_000},
            {"station_id": "1", "num_bikes_available": 7, "num_docks_available": 8, "last_reported": 1_700_000_000},
            {"station_id": "2", "num_bikes_available": -3, "num_docks_available": 12, "is_installed": 0, "last_reported": 1_700_000_050},
            {"station_id": "3", "last_reported": 1_700_000_060},
            {"num_bikes_available": 4, "last_reported": 1_700_000_070},
        ]
    }
}


def test_status_documents(spark):
    rows = {r["station_id"]: r for r in feeds.parse_station_status(docs(spark, STATUS)).collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert (rows["1"]["num_bikes_available"], rows["1"]["is_renting"], rows["1"]["is_returning"]) == (5, True, True)
    assert (rows["2"]["num_bikes_available"], rows["2"]["num_docks_available"], rows["2"]["is_installed"]) == (None, 12, False)
    assert rows["3"]["num_bikes_available"] is None and rows["3"]["last_reported"] == 1_700_000_060


def test_status_quality(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in feeds.status_quality(docs(spark, STATUS, {"data": {}}, {"x": 1})).collect()}
    assert got == {0: (1, 1, 1), 1: (0, 0, 0), 2: (0, 0, 0)}


def test_information_documents(spark):
    payload = {"data": {"stations": [{"station_id": 1, "name": "Estación 1", "lat": 19.42, "lon": "-99.16", "capacity": 15.0}, {"station_id": "1", "name": "x"}]}}
    (row,) = feeds.parse_station_information(docs(spark, payload)).collect()
    assert tuple(row) == (0, "1", "Estación 1", 19.42, -99.16, 15, None, None)


def test_feed_discovery(spark):
    feed = [{"name": "station_status", "url": "http://x/status"}, {"name": "nameless"}]
    found, rejected = feeds.discover_feeds(
        docs(
            spark,
            {"data": {"en": {"feeds": [{"name": "station_status", "url": "http://x/en"}]}, "es": {"feeds": feed}}},
            {"data": {"feeds": feed}},
            {"data": {"fr": {"feeds": feed}}},
            {"data": {"feeds": []}},
            {},
            {"data": {"en": {"feeds": feed}, "es": {"ttl": 1}}},  # a block of the language without feeds is not passed over
            {"data": {"en": {"feeds": feed}, "es": {}}},
        )
    )
    assert {r["doc_id"]: (r["name"], r["url"]) for r in found.collect()} == {i: ("station_status", "http://x/status") for i in (0, 1, 2, 6)}
    assert sorted(r["doc_id"] for r in rejected.collect()) == [3, 4, 5]


def test_page_links(spark):
    html = """<a class="x" href="/wp/2026/02/2026-01.csv">a</a><A HREF='2024_enero.zip?v=1'>b</A><a href=../x/2019-03.CSV>c</a>
    <a href="https://other.org/a&amp;b.csv#top">no</a><a href="//cdn.org/d.zip">e</a><a href="/wp/2026/02/2026-01.csv">again</a>
    <!-- <a href="/hidden.csv">h</a> --><a data-href="no.csv" href="page.html">p</a><script>var s='<a href="/s.csv">';</script>"""
    page = spark.createDataFrame([(1, "https://site.org/datos/abiertos/index.html?q=1", html)], "page_id int, url string, html string")
    got = [(r["url"], r["file_name"], r["year"], r["month"]) for r in pages.extract_links(page).orderBy("pos").collect()]
    assert got == [
        ("https://site.org/wp/2026/02/2026-01.csv", "2026-01.csv", 2026, 1),
        ("https://site.org/datos/abiertos/2024_enero.zip?v=1", "2024_enero.zip", 2024, 1),
        ("https://site.org/datos/x/2019-03.CSV", "2019-03.CSV", 2019, 3),
        ("https://cdn.org/d.zip", "d.zip", None, None),
    ]


def test_url_resolution_follows_the_standard(spark):
    from urllib.parse import urljoin

    base = "https://a.org/b/c/d?q#f"
    links = ["g", "./g", "g/", "/g", "//h", "?y", "g?y", "#s", "g#s", "", "..", "../", "../g", "../..", "../../g", "g/./h", "g/../h", "mailto:x@y.z", "http://z/a"]
    df = spark.createDataFrame([(i, link) for i, link in enumerate(links)], "i int, link string")
    got = [r[0] for r in df.orderBy("i").select(pages.resolve_url(F.lit(base), F.col("link"))).collect()]
    assert got == [urljoin(base, link) for link in links]


def manifest_rows(spark, *rows):
    names = "url file_name year month download_status checksum_sha256 local_path".split()
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], "url string, file_name string, year int, month int, download_status string, checksum_sha256 string, local_path string")
    from pedalflow.schemas import conform

    return conform(df, "historical_file_manifest")


def test_manifest_merge_keeps_state(spark):
    old = manifest_rows(spark, {"url": "u1", "file_name": "a", "year": 2020, "month": 1, "download_status": "downloaded", "local_path": "p"}, {"url": "gone", "file_name": "z"})
    found = spark.createDataFrame([("u1", "a2", 2021, 2), ("new", "n", 2019, 5)], "url string, file_name string, year int, month int")
    rows = manifest.merge_manifest(old, found).collect()
    assert [(r["url"], r["file_name"], r["year"], r["download_status"]) for r in rows] == [
        ("new", "n", 2019, "pending"),
        ("u1", "a2", 2021, "downloaded"),
        ("gone", "z", None, None),
    ]
    assert rows[1]["local_path"] == "p"


def test_file_selection(spark):
    rows = manifest_rows(spark, *[{"url": f"u{m}", "file_name": "f", "year": 2024, "month": m} for m in range(1, 7)], {"url": "none", "file_name": "f"})

    def urls(**kw):
        return sorted(r["url"] for r in manifest.select_files(rows, **kw).collect())

    assert urls(latest=2) == ["u5", "u6"]
    assert urls(from_period="2024-03", to_period="2024-04") == ["u3", "u4"]
    assert urls(to_period="2024-04", latest=1) == ["u4"]
    assert urls(months=["2024-01", "2030-01"], latest=1) == ["u1"]
    assert len(urls()) == 6


def test_only_changed_files_are_taken(spark):
    chosen = manifest_rows(spark, *[{"url": u, "file_name": "f", "checksum_sha256": c} for u, c in (("a", "1"), ("b", "2"), ("c", None))])
    loaded = manifest_rows(spark, *[{"url": u, "file_name": "f", "checksum_sha256": c} for u, c in (("a", "1"), ("b", "old"))])
    assert sorted(r["url"] for r in manifest.skip_unchanged(chosen, loaded).collect()) == ["b", "c"]
    assert manifest.skip_unchanged(chosen, loaded, force=True).count() == 3


def test_status_updates_take_the_latest(spark):
    rows = manifest_rows(spark, {"url": "a", "file_name": "f", "download_status": "pending"}, {"url": "b", "file_name": "f", "download_status": "pending"})
    loads = spark.createDataFrame(
        [("a", "error", 500, None, None, None, None, 1), ("a", "downloaded", 200, 9, "x", "p", None, 2)],
        "url string, download_status string, http_status int, size_bytes bigint, checksum_sha256 string, local_path string, last_downloaded_at_utc timestamp_ntz, at int",
    )
    got = {r["url"]: (r["download_status"], r["http_status"]) for r in manifest.apply_status(rows, loads).collect()}
    assert got == {"a": ("downloaded", 200), "b": ("pending", None)}


def test_status_updates_are_dealt_by_url_first_and_keep_any_checksum(spark):
    sums = {"a": "0aff", "b": "0AFF", "c": "abc", "d": "", "e": None, "f": "x"}
    rows = manifest_rows(spark, *[{"url": u, "file_name": "f", "checksum_sha256": "old"} for u in sums])
    loads = spark.createDataFrame(
        [(u, "downloaded", 200, 9, c, "p", None, 1) for u, c in sums.items()],
        "url string, download_status string, http_status int, size_bytes bigint, checksum_sha256 string, local_path string, last_downloaded_at_utc timestamp_ntz, at int",
    )
    got = manifest.apply_status(rows, loads)
    assert {r["url"]: r["checksum_sha256"] for r in got.collect()} == sums
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("REPARTITION_BY_COL") > plan.rindex("max_by")  # the exchange lies below both halves of the aggregate


def test_file_audit_flags_changes(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    write(folder / "a.csv", "hello")
    write(folder / "b.csv", "changed")
    known = manifest_rows(spark, *[{"url": n, "file_name": n, "checksum_sha256": hashlib.sha256(b"hello").hexdigest()} for n in ("a.csv", "b.csv")])
    got = {r["file_name"]: (r["size_bytes"], r["changed"]) for r in manifest.file_audit(spark, str(folder), known).collect()}
    assert got == {"a.csv": (5, False), "b.csv": (7, True)}


def test_manifest_file_round_trip(spark, tmp_path):
    path = write(
        tmp_path / "m.csv",
        "url,file_name,year,month,discovered_at_utc,download_status,http_status,size_bytes,checksum_sha256,local_path,last_downloaded_at_utc\n"
        "u1,a.csv,2024,1,2026-01-01T10:00:00.5,downloaded,200.0,10.0,x,raw/a.csv,ayer\nu2,b.csv,,,,pending,,,,,\n",
    )
    (row,) = manifest.downloaded(manifest.load_manifest(spark, path)).collect()
    assert (row["http_status"], row["size_bytes"], row["last_downloaded_at_utc"]) == (200, 10, None)
    assert row["discovered_at_utc"] == dt.datetime(2026, 1, 1, 10, 0, 0, 500000)


def test_ledger(spark):
    run = ledger.new_run_id("feed")
    events = ledger.start_run(spark, run, "feed", "src").union(ledger.start_run(spark, "open", "x")).union(
        ledger.finish_run(spark, run, "ok", 12, '{"a":1}')
    )
    rows = {r["run_id"]: r for r in ledger.current_runs(events).collect()}
    assert (rows[run]["status"], rows[run]["rows_ingested"], rows[run]["run_type"], rows[run]["source"]) == ("ok", 12, "feed", "src")
    assert rows[run]["finished_at_utc"] >= rows[run]["started_at_utc"]
    assert rows["open"]["status"] == "running" and rows["open"]["finished_at_utc"] is None


def test_replacing_a_run_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, run_id string"), path, ["run_id"])
    for _ in range(2):
        sinks.replace_partitions(spark.createDataFrame([(9, "b")], "v int, run_id string"), path, ["run_id"])
    assert sorted(map(tuple, sinks.read_table(spark, path).select("v", "run_id").collect())) == [(1, "a"), (9, "b")]


def test_information_changes(spark):
    schema = "station_id string, name string, lat double, lon double, capacity int, captured_at_utc timestamp_ntz"
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    stored = spark.createDataFrame([("1", "A", 1.0, 2.0, None, t[0]), ("1", "B", 1.0, 2.0, None, t[1])], schema)
    back = spark.createDataFrame([("1", "A", 1.0, 2.0, None, t[2])], schema)
    assert U.new_information_rows(back, stored).count() == 0  # seen before, so not news
    assert U.new_information_rows(back, stored, against="latest").count() == 1
    assert U.new_information_rows(stored, stored, against="any").count() == 0

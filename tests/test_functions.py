from __future__ import annotations

import datetime as dt
import math
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pedalflow.functions import calendar as C
from pedalflow.functions import geo as G
from pedalflow.functions import scalars as S
from pedalflow.functions import text as T


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v")).alias("x")).collect()]


def test_snake_case_variants():
    assert T.to_snake_case("Ciclo_EstacionArribo") == "ciclo_estacion_arribo"
    assert T.to_snake_case("Ciclo_Estacion_Arribo") == "ciclo_estacion_arribo"
    assert T.to_snake_case("Género_Usuario") == "genero_usuario"
    assert T.to_snake_case("Hora  Retiro!") == "hora_retiro"


def test_header_keeps_the_first_of_equal_names():
    found = T.canonical_header(["Bici", "Id_Bici", "Sexo", "otra"])
    assert found == {"bici": 0, "genero_usuario": 2, "otra": 3}


def test_parse_datetime_formats(spark):
    rows = [
        ("2010-02-16", "12:42:32.160000", dt.datetime(2010, 2, 16, 12, 42, 32, 160000)),
        ("31/07/2026", "23:22:23", dt.datetime(2026, 7, 31, 23, 22, 23)),
        ("05/06/2025", "10:00", dt.datetime(2025, 6, 5, 10)),  # 5 June, never 6 May
        ("1-2-2024", "1:2:3", dt.datetime(2024, 2, 1, 1, 2, 3)),
        (" 04/04/2021 ", "02:30:00 ", dt.datetime(2021, 4, 4, 2, 30)),  # a local DST gap stays as written
        ("30/02/2024", "10:00:00", None),
        ("12/31/2024", "10:00:00", None),
        ("01/01/24", "10:00:00", None),
        ("fecha-mala", "10:00:00", None),
        (None, "10:00:00", None),
        ("01/01/2024", "", None),
        ("01/01/2024", "24:00:00", None),
        ("01/01/2024", "10:60", None),
        ("01/01/2024", "9:5:7.5", dt.datetime(2024, 1, 1, 9, 5, 7, 500000)),
        ("2024-01", "10:00:00", None),
        ("29-2-2024", "23:59:59.999999", dt.datetime(2024, 2, 29, 23, 59, 59, 999999)),
    ]
    df = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(rows)], "i int, d string, t string")
    got = [r[0] for r in df.orderBy("i").select(S.parse_datetime(F.col("d"), F.col("t"))).collect()]
    assert got == [want for _, _, want in rows]


def test_unknown_directive_is_refused():
    with pytest.raises(ValueError):
        S.format_shape("%d/%b/%Y")


def test_clean_id(spark):
    got = column(spark, [" 007 ", "", "NaN", "null", "None", None, "237-238", "\t12"], S.clean_id)
    assert got == ["007", None, None, None, None, None, "237-238", "12"]


def test_coerce_age(spark):
    assert column(spark, ["41", "41.0", "", "nan", None, "2.5", "3.5", "x"], S.coerce_age) == [41, 41, None, None, None, 2, 4, None]


def test_loose_casts(spark):
    assert column(spark, ["5", " 7 ", "5.0", "x", None, "-3"], S.as_int) == [5, 7, 5, None, None, -3]
    assert column(spark, ["true", "1", "sí", "YES", "0", "false", "x", None], S.as_bool) == [
        True, True, True, True, False, False, False, None,
    ]
    assert column(spark, ["19.4", "", None], S.as_float) == [19.4, None, None]


def test_row_hash_is_stable_and_depends_on_the_file(spark):
    df = spark.createDataFrame([("a", None, "f1"), ("a", "", "f1"), ("a", "", "f2")], "x string, y string, f string")
    got = [r[0] for r in df.select(S.row_hash([F.col("x"), F.col("y")], F.col("f"))).collect()]
    assert got[0] == got[1] != got[2] and len(got[0]) == 64


def test_time_conversions(spark):
    summer, winter = dt.datetime(2010, 7, 1, 12), dt.datetime(2024, 7, 1, 12)
    assert column(spark, [summer, winter], S.utc_to_local, "timestamp_ntz") == [dt.datetime(2010, 7, 1, 7), dt.datetime(2024, 7, 1, 6)]
    assert column(spark, [0, 1_700_000_000], S.epoch_to_utc, "bigint") == [dt.datetime(1970, 1, 1), dt.datetime(2023, 11, 14, 22, 13, 20)]
    stamps = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120)]
    want = [t.replace(tzinfo=dt.UTC).isoformat() for t in stamps]
    assert column(spark, stamps, S.iso_utc, "timestamp_ntz") == want


def test_clip_and_percentages(spark):
    assert column(spark, [-1.0, 5.0, 99.0, None], lambda c: S.clip(c, F.lit(0.0), F.lit(10.0)), "double") == [0.0, 5.0, 10.0, None]
    df = spark.createDataFrame([(1, 3), (1, 0), (0, None)], "p int, t int")
    assert [r[0] for r in df.select(S.pct(F.col("p"), F.col("t"), 2)).collect()] == [33.33, 0.0, 0.0]


def test_holidays(spark):
    days = {r["date"] for r in C.holidays(spark, 2024, 2026).collect()}
    assert {dt.date(2025, 9, 16), dt.date(2025, 5, 1), dt.date(2025, 2, 3), dt.date(2025, 3, 17), dt.date(2025, 11, 17)} <= days
    assert dt.date(2025, 7, 4) not in days
    assert len(days) == 21


def test_quincena(spark):
    days = [dt.date(2024, 2, 15), dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2023, 2, 28)]
    assert column(spark, days, C.quincena, "date") == [True, False, True, True]


def test_haversine(spark):
    df = spark.createDataFrame([(19.4, -99.1, 19.41, -99.1), (19.4, -99.1, 19.4, -99.1)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(G.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] == pytest.approx(math.radians(0.01) * G.EARTH_RADIUS_M) and got[1] == 0.0


def reference_name(text: str) -> str:
    ascii_text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii").lower()
    return " ".join("".join(ch if ch.isalnum() else " " for ch in ascii_text).split())


def test_normalize_name(spark):
    names = ["Reforma - Insurgentes", "MÉTRO  Balderas", None, "Niño½ ﬁn", "a–b ßx", "Ångström ² º", "  ", "Łódź"]
    want = ["" if n is None else reference_name(n) for n in names]
    assert want[0] == "reforma insurgentes" and want[1] == "metro balderas"
    assert column(spark, names, T.normalize_name) == want


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=30))
def test_normalize_name_on_latin_text(spark, names):
    assert column(spark, names, T.normalize_name) == [reference_name(n) for n in names]


def test_infer_period(spark):
    names = ["2026-01.csv", "datos_2024_12.zip", "2024_enero.csv", "Septiembre-2019.csv", "sept2018.csv", "2024.csv", "mayo.csv", "x.csv"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    year, month = T.infer_period(F.col("n"))
    got = [tuple(r) for r in df.orderBy("i").select(year, month).collect()]
    assert got == [(2026, 1), (2024, 12), (2024, 1), (2019, 9), (2018, 9), (None, None), (None, None), (None, None)]


def test_normalize_name_folds_what_has_several_letters_or_lies_beyond_the_basic_plane(spark):
    names = ["Plaza Ⅳ", "№7", "⑩ norte", "Bar™", "𝐀𝐛𝐜 x", "㎏ ﬃ Ĳssel", "漢字 😀 y"]
    assert column(spark, names, T.normalize_name) == [reference_name(n) for n in names]
    assert reference_name("Plaza Ⅳ") == "plaza iv"

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pedalflow.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


RAW = {
    "genero_usuario": "M",
    "edad_usuario": "30",
    "bici": "0069",
    "ciclo_estacion_retiro": "85",
    "fecha_retiro": "16/02/2010",
    "hora_retiro": "12:00:00",
    "ciclo_estacion_arribo": "26",
    "fecha_arribo": "16/02/2010",
    "hora_arribo": "12:15:00",
}


@pytest.fixture(scope="session")
def raw_trips(spark):
    """Raw rows from overrides of one valid row; ``source_file`` may be overridden too."""

    def build(*overrides: dict):
        rows = [{**RAW, "source_file": "test.csv", **o, "row_pos": i} for i, o in enumerate(overrides)]
        names = [*RAW, "source_file"]
        schema = ", ".join(f"{n} string" for n in names) + ", row_pos int"
        return spark.createDataFrame([tuple(r[n] for n in [*names, "row_pos"]) for r in rows], schema)

    return build

"""Raw trip files: text columns, one canonical frame whatever the header or encoding of a file."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalflow.functions.scalars import row_hash
from pedalflow.functions.text import canonical_header
from pedalflow.operators.cleaning import KEY_COLUMNS
from pedalflow.schemas import CANONICAL_COLUMNS, conform


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename to canonical names; of columns that map to one name the first stays. No job is run."""
    positions = canonical_header(df.columns)
    numbered = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_c{i}").alias(name) for name, i in positions.items()])


def file_layouts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file: path, header bytes, and whether every line is valid UTF-8.

    The text reader keeps bytes as they are, so one splittable scan answers both questions.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias(
            "at"
        ),
        "value",
    )
    return lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.min_by(F.col("value").cast("binary"), "at").alias("header"),
    )


def _layout_groups(
    spark: SparkSession, paths: Sequence[str], encoding: str | None
) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """Files by (encoding, header): one small row per file reaches the driver, never data."""
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = defaultdict(list)
    if encoding is not None:
        for path in paths:
            first = spark.read.option("encoding", encoding).option("escape", '"').csv(path).first()
            groups[encoding, tuple(c or "" for c in first)].append(path)
        return groups
    for row in file_layouts(spark, paths).orderBy("path").toLocalIterator():
        found = "UTF-8" if row["utf8"] else "ISO-8859-1"
        header = bytes(row["header"]).decode(found).removeprefix("\ufeff")
        groups[found, tuple(next(csv.reader([header])))].append(row["path"])
    return groups


def read_raw_files(
    spark: SparkSession, paths: Sequence[str], multi_line: bool = False, encoding: str | None = None
) -> DataFrame:
    """Canonical text columns plus ``source_file`` and ``row_pos`` (file order).

    Files are read in groups of equal encoding and header. A column the header has but the row leaves
    empty is '', a column the header lacks is NULL. Telling encodings apart takes a scan of all bytes;
    with a known ``encoding`` only the first line of each path (one file each) is looked at.
    """
    frames = []
    for (found, header), files in _layout_groups(spark, paths, encoding).items():
        positions = canonical_header(list(header))
        raw = (
            spark.read.option("header", True)
            .option("encoding", found)
            .option("escape", '"')
            .option("multiLine", multi_line)
            .schema(", ".join(f"_c{i} string" for i in range(len(header))))
            .csv(files)
        )
        named = [
            F.coalesce(F.col(f"_c{positions[c]}"), F.lit("")).alias(c)
            for c in CANONICAL_COLUMNS
            if c in positions
        ]
        frames.append(
            raw.select(
                *named,
                F.col("_metadata.file_name").alias("source_file"),
                F.struct(
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
                ).alias("row_pos"),
            )
        )
    if not frames:
        raise ValueError("no raw files to read")
    return union_raw(frames)


def union_raw(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames with different canonical columns as one; what a frame lacks is NULL."""
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    absent = [c for c in CANONICAL_COLUMNS if c not in combined.columns]
    combined = combined.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else combined
    extra = [c for c in combined.columns if c not in CANONICAL_COLUMNS]
    return combined.select(*CANONICAL_COLUMNS, *extra)


def stage_raw(raw: DataFrame, run_id: str, ingested_at: Column | None = None) -> DataFrame:
    """Raw layer rows: canonical text plus lineage (row hash, file, run, load time)."""
    stamped = raw.withColumns(
        {
            "row_hash": row_hash([F.col(c) for c in KEY_COLUMNS], F.col("source_file")),
            "run_id": F.lit(run_id),
            "ingested_at_utc": F.localtimestamp() if ingested_at is None else ingested_at,
        }
    )
    return conform(stamped, "trips_raw")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Manual station aliases; comment lines and rows without both ids are skipped."""
    rows = (
        spark.read.option("header", True)
        .option("comment", "#")
        .schema("historico_id string, gbfs_id string, nombre_referencia string, nota string")
        .csv(path)
    )
    return rows.select("historico_id", "gbfs_id").dropna()


def read_station_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Historical catalogue: ``historico_id, nombre, lat, lon``."""
    return (
        spark.read.option("header", True)
        .schema("historico_id string, nombre string, lat double, lon double")
        .option("enforceSchema", False)
        .csv(path)
    )

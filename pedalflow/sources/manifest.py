"""The manifest of published files: reading, selecting, merging and auditing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pedalflow.schemas import SCHEMAS, conform

_STATE = ("download_status", "http_status", "size_bytes", "checksum_sha256", "local_path", "last_downloaded_at_utc")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("header", True).schema(
        ", ".join(f"{name} string" for name in SCHEMAS["historical_file_manifest"].names)
    )
    return typed_manifest(text.csv(path))


def typed_manifest(rows: DataFrame) -> DataFrame:
    """Text manifest to declared types; what does not parse becomes NULL."""
    casts = []
    for field in SCHEMAS["historical_file_manifest"].fields:
        kind = field.dataType.simpleString()
        if kind in ("int", "bigint"):  # pandas writes nullable integers as '200.0'
            casts.append(F.col(field.name).try_cast("double").try_cast(kind).alias(field.name))
        else:
            casts.append(F.col(field.name).try_cast(kind).alias(field.name))
    return rows.select(*casts)


def downloaded(manifest: DataFrame) -> DataFrame:
    return manifest.filter((F.col("download_status") == "downloaded") & F.col("local_path").isNotNull())


def period_key() -> Column:
    """year*100 + month, NULL when either is missing."""
    return F.col("year") * 100 + F.col("month")


def _key(period: str) -> int:
    return int(period.replace("-", ""))


def select_files(
    manifest: DataFrame,
    from_period: str | None = None,
    to_period: str | None = None,
    latest: int | None = None,
    months: Sequence[str] | None = None,
) -> DataFrame:
    """Explicit months, else a range, else the ``latest`` N of what is left (ties by url)."""
    keyed = manifest.withColumn("period_key", period_key())
    if months:
        return keyed.filter(F.col("period_key").isin([_key(m) for m in months]))
    chosen = keyed.filter(F.col("period_key").isNotNull())
    if from_period:
        chosen = chosen.filter(F.col("period_key") >= _key(from_period))
    if to_period:
        chosen = chosen.filter(F.col("period_key") <= _key(to_period))
    return latest_files(chosen, latest) if latest else chosen


def latest_files(keyed: DataFrame, n: int) -> DataFrame:
    return keyed.orderBy(F.col("period_key").desc(), F.col("url").desc()).limit(n)


def skip_unchanged(selection: DataFrame, loaded: DataFrame, force: bool = False) -> DataFrame:
    """Selected files whose (url, checksum) pair has not been loaded yet."""
    if force:
        return selection
    known = loaded.select("url", "checksum_sha256")
    same = selection["url"].eqNullSafe(known["url"]) & selection["checksum_sha256"].eqNullSafe(known["checksum_sha256"])
    return selection.join(known, same, "left_anti")


def merge_manifest(existing: DataFrame, discovered: DataFrame, now: Column | None = None) -> DataFrame:
    """Upsert discovered links (url, file_name, year, month).

    Known urls keep their state and take the discovered name and period, new urls are pending,
    vanished urls stay. Sorted by period and name, missing periods last.
    """
    now = F.localtimestamp() if now is None else now
    e, d = existing.alias("e"), discovered.select("url", "file_name", "year", "month").alias("d")
    joined = e.join(d, F.col("e.url") == F.col("d.url"), "full_outer")
    is_new, is_found = F.col("e.url").isNull(), F.col("d.url").isNotNull()
    merged = joined.select(
        F.coalesce("e.url", "d.url").alias("url"),
        *[F.when(is_found, F.col(f"d.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in ("file_name", "year", "month")],
        F.when(is_new, now).otherwise(F.col("e.discovered_at_utc")).alias("discovered_at_utc"),
        F.when(is_new, F.lit("pending")).otherwise(F.col("e.download_status")).alias("download_status"),
        *[F.col(f"e.{c}").alias(c) for c in _STATE[1:]],
    )
    return conform(merged, "historical_file_manifest").orderBy(
        F.asc_nulls_last("year"), F.asc_nulls_last("month"), F.asc_nulls_last("file_name")
    )


def new_manifest_rows(manifest_text: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose url the stored manifest lacks, typed (unparsable fields become NULL)."""
    return typed_manifest(manifest_text).join(stored.select("url"), "url", "left_anti")


def apply_status(manifest: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite the load state of the urls in ``updates`` (url, state columns, ``at``); the latest wins.

    The updates are dealt by url before they are compared: a file has few of them, so combining them in front of the
    shuffle would sort, and spill, all updates of a task and drop hardly any. Those of one url meet in one sorted task.
    A checksum travels as the bytes that its digits stand for, any other text as it is.
    """
    checksum = F.col("checksum_sha256")
    plain = F.lower(F.hex(F.unhex(checksum))) == checksum
    state = [F.when(plain, F.unhex(checksum)).alias("_bytes"), F.when(plain, F.lit(None)).otherwise(checksum).alias("checksum_sha256")]
    packed = updates.select("url", "at", F.struct(*[c for c in _STATE if c != "checksum_sha256"], *state).alias("u"))
    latest = packed.repartition("url").groupBy("url").agg(F.max_by("u", "at").alias("u"))
    joined = manifest.join(latest, "url", "left")
    touched = F.col("u").isNotNull()
    news = {c: F.col(f"u.{c}") for c in _STATE} | {"checksum_sha256": F.coalesce(F.lower(F.hex("u._bytes")), "u.checksum_sha256")}
    fresh = joined.withColumns({c: F.when(touched, news[c]).otherwise(F.col(c)) for c in _STATE})
    return conform(fresh, "historical_file_manifest")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file, read in blocks through its file system: constant memory whatever its size."""
    for batch in batches:
        sums = []
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while block := stream.read(8 << 20):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "size_bytes", "checksum_sha256"])


def file_audit(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Size and SHA-256 per landed file, and whether it differs from the manifest.

    Only names and sizes are listed by the source; every file, of any size, is hashed by the task that holds its row.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))
    hashed = listing.mapInArrow(_digests, "path string, size_bytes long, checksum_sha256 string")
    audit = hashed.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "size_bytes", "checksum_sha256")
    if manifest is None:
        return audit
    expected = manifest.select("file_name", F.col("checksum_sha256").alias("expected_sha256"))
    return audit.join(expected, "file_name", "left").withColumn(
        "changed", ~F.col("checksum_sha256").eqNullSafe(F.col("expected_sha256"))
    )

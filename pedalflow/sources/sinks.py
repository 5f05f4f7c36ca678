"""Table and report writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def clustered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a partition side by side before a partitioned write: few files for each, and a large one is split by size.

    ``REBALANCE`` leaves the number of tasks to adaptive execution, which splits hot partitions and merges small ones.
    """
    return df.hint("rebalance", *by)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Parquet. ``overwrite`` replaces the whole table, ``append`` adds to it."""
    writer = (clustered(df, partition_by) if partition_by else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "static")
    writer.parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], seen: Observation | None = None, counts: Sequence[Column] = ()) -> None:
    """Replace only the partitions present in ``df`` (a run, a target, a window): safe to repeat.

    ``seen`` takes ``counts`` of the rows while they are written. It looks at them after the exchange: adaptive execution
    drops what lies before an exchange that has turned out empty.
    """
    rows = clustered(df, partition_by)
    if seen is not None:
        rows = rows.observe(seen, *counts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown report kind {kind!r}")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)

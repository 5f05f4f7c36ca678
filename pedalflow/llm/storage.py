"""Results of finished stages in the shared folder, and gapless numbering of rows by many tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, whichever comes first: bounds a Python worker's memory with long texts and sets.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, as the cluster names it in ``spark.checkpoint.dir``; without one, an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: later readers neither repeat its work nor depend on any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Replaced:
    """A table that is stored again and again: each new version replaces the one before, of which nothing is left."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def store(self, df: DataFrame) -> DataFrame:
        path, old = f"{shared_folder(self.spark)}/{self.name}-{uuid.uuid4().hex}", self.path
        df.write.parquet(path)
        self.path = path
        if old is not None:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return self.spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to these sizes; they stay set, as results are computed after the operator returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def numbered(df: DataFrame, group: list[str], order: Column, name: str, ties: list[str], bits: int = 10, weight: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of the 64-bit value ``order`` and then ``ties``.

    A group's rows are cut into 2**bits ranges of ``order``, numbered by as many tasks; the counts of the ranges, a
    table of a fixed number of rows for each group, give every range its offset. Rows that ``ties`` does not tell apart
    are numbered in any order. With ``weight`` a row's number is the sum of the weights of all rows before it.
    """
    one = weight if weight is not None else F.lit(1).cast("long")
    rows = df.withColumn("_order", order).withColumn("_range", F.shiftright("_order", 64 - bits)).withColumn("_weight", one)
    if group:  # a partitioning by the group alone would leave a large one in one task
        rows = rows.repartition(*group, "_range")
    counts = rows.groupBy(*group, "_range").agg(F.sum("_weight").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_{i}") for i, c in enumerate(group)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    inner = Window.partitionBy(*group, "_range").orderBy("_order", *ties).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    ranked = rows.withColumn("_rank", F.coalesce(F.sum("_weight").over(inner), F.lit(0)))
    return ranked.join(offsets, same).withColumn(name, F.col("_offset") + F.col("_rank")).select(*df.columns, name)

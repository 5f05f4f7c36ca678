"""Temporal split, median baseline, boosted trees and their predictions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pedalflow.functions import scalars as S
from pedalflow.operators import boosting
from pedalflow.schemas import conform

# Targets and same-hour columns never enter the model.
NON_FEATURES = ("ts", "salidas", "llegadas", "flujo_neto", "station_id")
MISSING_NUMBER = -1.0
HOUR_US = 3_600_000_000

# rows from which on a training task pays, rows that fill one, and the least number of tasks: a round of boosting is six
# short passes, best done by one task on each core
_ROWS_PER_TASK = 1 << 16
_FULL = 16
_LEAST_TASKS = 4


# --- split -------------------------------------------------------------------------------------


def temporal_quantiles(df: DataFrame, val_q: float = 0.6, test_q: float = 0.8) -> DataFrame:
    """One row ``val_start, test_start``: interpolated quantiles of ``ts`` over all rows.

    Rows are counted per distinct time and per hour. Running counts over the hours, one record each, tell which
    hours hold the wanted positions; only the times of those hours, four at most, are put in order.
    """
    us = S.micros(F.col("ts"))
    counted = df.filter(us.isNotNull()).groupBy(us.alias("us")).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("hour_no", F.floor(F.col("us") / HOUR_US))
    running = Window.orderBy("hour_no").rowsBetween(Window.unboundedPreceding, -1)
    hours = counted.groupBy("hour_no").agg(F.sum("n").alias("n"))
    hours = hours.withColumns({"before": F.coalesce(F.sum("n").over(running), F.lit(0)), "rows": F.sum("n").over(Window.partitionBy())})
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("rows") - 1)).alias("at")) for i, q in enumerate((val_q, test_q))])
    ends = F.expr("inline(array(struct(floor(p.at) AS rank, 1 - (p.at - floor(p.at)) AS share), struct(floor(p.at) + 1 AS rank, p.at - floor(p.at) AS share)))")
    wanted = hours.select("hour_no", "before", "n", F.explode(places).alias("p")).select("hour_no", "before", "n", F.col("p.i").alias("i"), ends)
    wanted = wanted.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("n")
    inside = Window.partitionBy("i", "rank").orderBy("us")
    reached = counted.join(wanted, "hour_no").withColumn("after", F.col("before") + F.sum("n").over(inside))
    hits = reached.filter((F.col("rank") < F.col("after")) & (F.col("rank") >= F.col("after") - F.col("n")))

    def instant(i: int) -> Column:
        own = F.when((F.col("i") == i) & (F.col("share") > 0), F.col("us"))
        low, high = F.min(own), F.max(own)
        share = F.max(F.when((F.col("i") == i) & (F.col("rank") == F.col("top")), F.col("share")))
        cut = low + (high - low) * F.coalesce(share, F.lit(0.0))
        return F.timestamp_micros(F.round(cut).cast("bigint")).cast("timestamp_ntz")

    hits = hits.withColumn("top", F.max("rank").over(Window.partitionBy("i")))
    return hits.agg(instant(0).alias("val_start"), instant(1).alias("test_start"))


def assign_split(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """``split``: test from ``test_start``, val from ``val_start``, train before."""
    ts = F.col("ts")
    split = (
        F.when(ts >= bounds.select("test_start").scalar(), F.lit("test"))
        .when(ts >= bounds.select("val_start").scalar(), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return df.withColumn("split", split)


def training_rows(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows before validation starts, as a plain bound on ``ts`` that reaches the scan."""
    return df.filter(F.col("ts") < bounds.select("val_start").scalar())


def temporal_split(df: DataFrame, val_q: float = 0.6, test_q: float = 0.8) -> DataFrame:
    return assign_split(df, temporal_quantiles(df, val_q, test_q))


# --- baseline ----------------------------------------------------------------------------------


#: Grains of the baseline, finest first, with the columns that name one of their groups.
GRAINS = {"station_dow_hour": ("station_id", "dow", "hour"), "station_hour": ("station_id", "hour"), "hour": ("hour",), "all": ()}


def fit_baseline(train: DataFrame, target: str = "salidas") -> DataFrame:
    """Exact medians of the target at every grain: grain, station_id, dow, hour (NULL where the grain has none), median.

    One histogram (station, dow, hour, value → rows) is combined before its shuffle; each of its rows counts at all
    grains, so the coarse ones read counts instead of rows and not even the overall median gathers the data.
    """
    key = ["station_id", "dow", "hour"]
    if not {*key, target} <= {f.name for f in train.schema.fields}:
        raise ValueError(f"the baseline needs the columns {', '.join(key)} and {target}")
    histogram = train.groupBy(*key, F.col(target).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    kinds = {c: histogram.schema[c].dataType for c in key}

    def at(grain: str) -> Column:
        own = [F.when(F.lit(c in GRAINS[grain]), F.col(c)).cast(kinds[c]).alias(c) for c in key]
        return F.struct(F.lit(grain).alias("grain"), *own, "v", "n")

    counted = histogram.select(F.inline(F.array(*[at(g) for g in GRAINS])))
    counted = counted.groupBy("grain", *key, "v").agg(F.sum("n").alias("n"))
    return counted.groupBy("grain", *key).agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("median"))


def medians_at(baseline: DataFrame, grain: str) -> DataFrame:
    """The medians of one grain with the columns that name its groups."""
    return baseline.filter(F.col("grain") == grain).select(*GRAINS[grain], "median")


def predict_baseline(baseline: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` with ``y_pred_baseline``: the finest median that exists.

    The fallbacks are resolved once per distinct (station, dow, hour); the rows then take one join.
    """
    slots = df.select("station_id", "dow", "hour").distinct()
    *named, last = GRAINS
    for grain in named:
        found = medians_at(baseline, grain).withColumnRenamed("median", f"at_{grain}")
        slots = slots.join(found, list(GRAINS[grain]), "left")
    overall = medians_at(baseline, last).select("median").scalar()
    prediction = F.coalesce(*[F.col(f"at_{g}") for g in named], overall).alias("y_pred_baseline")
    return df.join(slots.select("station_id", "dow", "hour", prediction), ["station_id", "dow", "hour"], "left")


# --- boosted trees -----------------------------------------------------------------------------


def feature_columns(df: DataFrame, target: str = "salidas") -> list[str]:
    """Numeric and boolean columns that are known before the predicted hour."""
    numeric = {"int", "bigint", "smallint", "tinyint", "double", "float", "boolean"}
    return [c for c, kind in df.dtypes if kind in numeric and c not in NON_FEATURES and c not in (target, "split")]


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Booleans as 0/1, unknown values as a number outside every feature's range (trees take no NULL)."""
    return df.withColumns({f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING_NUMBER)) for c in columns})


def training_frame(train: DataFrame, columns: Sequence[str], target: str = "salidas") -> DataFrame:
    """Numeric features and the label ``_y``, dealt over as many partitions as the rows fill.

    Every round passes over these partitions several times, so their number follows the data and the cores, not the
    session's shuffle setting. A fixed order inside stable partitions makes row sampling, and so the model, repeatable
    on equally many cores.
    """
    rows, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    tasks = max(_LEAST_TASKS, min(cores, -(-rows // _ROWS_PER_TASK)), -(-rows // (_FULL * _ROWS_PER_TASK)))
    ready = _numbers(train, columns).withColumn("_y", F.col(target).cast("double"))
    return ready.repartition(tasks, "station_id", F.col("ts").cast("date")).sortWithinPartitions("station_id", "ts")


def train_model(
    train: DataFrame,
    target: str = "salidas",
    columns: Sequence[str] | None = None,
    iterations: int = 300,
    learning_rate: float = 0.05,
    seed: int = 42,
) -> tuple[PipelineModel, list[str]]:
    """Gradient-boosted trees on the features and a station code; returns the model and its feature names."""
    columns = list(columns or feature_columns(train, target))
    inputs = [*(f"x_{c}" for c in columns), "x_station_code"]
    stages = [
        StringIndexer(inputCol="station_id", outputCol="_code", stringOrderType="alphabetAsc", handleInvalid="keep"),
        # arithmetic drops the category metadata: the code is one ordered number, not a 1-in-n category
        SQLTransformer(statement="SELECT *, _code + 0.0D AS x_station_code FROM __THIS__"),
        VectorAssembler(inputCols=inputs, outputCol="_x"),
    ]
    trees = GBTRegressor(
        featuresCol="_x",
        labelCol="_y",
        predictionCol="_raw",
        maxIter=iterations,
        maxDepth=5,
        stepSize=learning_rate,
        checkpointInterval=10,
        subsamplingRate=0.9,
        featureSubsetStrategy="0.9",
        seed=seed,
    )
    prepared = Pipeline(stages=stages).fit(_numbers(train, columns))
    ready = prepared.transform(training_frame(train, columns, target)).select(*inputs, "_y").persist()
    try:
        return PipelineModel([*prepared.stages, boosting.fit(trees, ready, "_y")]), columns
    finally:
        ready.unpersist()


def predict_frame(model: PipelineModel, df: DataFrame, columns: Sequence[str], output: str = "y_pred") -> DataFrame:
    """``df`` with the prediction, never negative."""
    scored = model.transform(_numbers(df, columns))
    return scored.select(*df.columns, F.greatest(F.col("_raw"), F.lit(0.0)).alias(output))


def latest_rows(features: DataFrame) -> DataFrame:
    """Rows of the last hour."""
    return features.filter(F.col("ts") == features.agg(F.max("ts")).scalar())


def predict_latest(model: PipelineModel, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Demand expected per station in the last hour, highest first."""
    scored = predict_frame(model, latest_rows(features), columns)
    return predict_ranking(scored.select("station_id", "ts", "y_pred"))


def predict_ranking(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.col("y_pred").desc(), "station_id")


def model_predictions(
    scored: DataFrame, target: str, model_version: str, created_at: Column | None = None
) -> DataFrame:
    """Rows of the predictions table; ``scored`` carries both predictions and the split."""
    return conform(
        scored.withColumns(
            {
                "target": F.lit(target),
                "y_true": F.col(target).cast("double"),
                "model_version": F.lit(model_version),
                "created_at_utc": F.localtimestamp() if created_at is None else created_at,
            }
        ),
        "model_predictions",
    )


def new_model_version(name: str = "spark_gbt") -> str:
    return f"{name}_{datetime.now(UTC):%Y%m%dT%H%M%S}"


@dataclass(frozen=True)
class TrainedForecast:
    model: PipelineModel
    columns: list[str]
    target: str
    version: str
    bounds: DataFrame
    scored: DataFrame

    def predictions(self) -> DataFrame:
        return model_predictions(self.scored, self.target, self.version)


def train(
    features: DataFrame, target: str = "salidas", iterations: int = 300, learning_rate: float = 0.05, seed: int = 42
) -> TrainedForecast:
    """Split by time, fit both predictors on the training part only, score every part."""
    spark = features.sparkSession
    cuts = temporal_quantiles(features)
    # two timestamps, needed by every step below: looked up once and then literals
    bounds = spark.createDataFrame([tuple(cuts.first())], cuts.schema)
    split, training = assign_split(features, bounds), training_rows(features, bounds)
    model, columns = train_model(training, target, feature_columns(features, target), iterations, learning_rate, seed)
    with_baseline = predict_baseline(fit_baseline(training, target), split)
    scored = predict_frame(model, with_baseline, columns, "y_pred_model")
    return TrainedForecast(model, columns, target, new_model_version(), bounds, scored)


def save_model(spark: SparkSession, forecast: TrainedForecast, path: str) -> None:
    forecast.model.write().overwrite().save(f"{path}/model")
    meta = forecast.bounds.select(
        F.lit(forecast.version).alias("model_version"),
        F.lit("spark_gbt").alias("model_name"),
        F.lit(forecast.target).alias("target"),
        F.lit(json.dumps(forecast.columns)).alias("feature_cols"),
        F.col("val_start").cast("string").alias("val_start"),
        F.col("test_start").cast("string").alias("test_start"),
    )
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, str]]:
    meta = spark.read.schema(
        "model_version string, model_name string, target string, feature_cols string, val_start string, test_start string"
    ).json(f"{path}/meta")
    found = meta.first().asDict()
    found["feature_cols"] = json.loads(found["feature_cols"])
    return PipelineModel.load(f"{path}/model"), found

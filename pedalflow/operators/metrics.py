"""Forecast metrics as aggregate expressions, and the reports built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Evaluation segments and labels.
PEAK_HOURS = (7, 8, 9, 17, 18, 19, 20)
TOP_STATIONS = 10
PREDICTORS = {"linea_base": "y_pred_baseline", "modelo": "y_pred_model"}
MODEL_WINS = "el modelo SUPERA a la línea base"
MODEL_LOSES = "el modelo NO supera a la línea base"


def mae(y_true: Column, y_pred: Column) -> Column:
    return F.avg(F.abs(y_true - y_pred))


def rmse(y_true: Column, y_pred: Column) -> Column:
    error = y_true - y_pred
    return F.sqrt(F.avg(error * error))


def wape(y_true: Column, y_pred: Column) -> Column:
    """NaN when the true values sum to zero."""
    scale = F.sum(F.abs(y_true))
    return F.when(scale != 0, F.sum(F.abs(y_true - y_pred)) / scale).otherwise(F.lit(float("nan")))


def mean_bias(y_true: Column, y_pred: Column) -> Column:
    """Positive: overestimates."""
    return F.avg(y_pred - y_true)


def compute_all(y_true: str, y_pred: str, suffix: str = "") -> list[Column]:
    t, p = F.col(y_true), F.col(y_pred)
    named = {"mae": mae(t, p), "rmse": rmse(t, p), "wape": wape(t, p), "sesgo_medio": mean_bias(t, p), "n": F.count(F.lit(1))}
    return [c.alias(name + suffix) for name, c in named.items()]


def metrics_by_group(df: DataFrame, y_true_col: str, y_pred_col: str, group_col: str) -> DataFrame:
    return df.groupBy(group_col).agg(*compute_all(y_true_col, y_pred_col)).orderBy(group_col)


def compare_by_group(predictions: DataFrame, group_col: str) -> DataFrame:
    """Both predictors per group from one aggregation."""
    return predictions.groupBy(group_col).agg(
        *compute_all("y_true", "y_pred_baseline", "_base"), *compute_all("y_true", "y_pred_model", "_modelo")
    )


def stack_predictors(predictions: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per prediction and predictor: ``modelo`` names it, ``y_pred`` holds its value."""
    each = F.array(*[F.struct(F.lit(name).alias("modelo"), F.col(c).alias("y_pred")) for name, c in PREDICTORS.items()])
    return predictions.select(*keep, "y_true", F.inline(each))


def metrics_overall(predictions: DataFrame, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    chosen = predictions.filter(F.col("split").isin(*splits))
    return stack_predictors(chosen, ["split"]).groupBy("split", "modelo").agg(*compute_all("y_true", "y_pred"))


def peak_hours(test: DataFrame) -> DataFrame:
    return test.filter(F.hour("ts").isin(*PEAK_HOURS))


def top_demand_stations(test: DataFrame, n: int = TOP_STATIONS) -> DataFrame:
    totals = test.groupBy("station_id").agg(F.sum("y_true").alias("total"))
    return totals.orderBy(F.col("total").desc(), "station_id").limit(n)


def segment_metrics(rows: DataFrame, segment: str) -> DataFrame:
    return (
        stack_predictors(rows, [])
        .groupBy("modelo")
        .agg(*compute_all("y_true", "y_pred"))
        .select(F.lit(segment).alias("segmento"), "*")
    )


def metrics_peak(test: DataFrame) -> DataFrame:
    return segment_metrics(peak_hours(test), "horas_pico")


def metrics_top(test: DataFrame, n: int = TOP_STATIONS) -> DataFrame:
    best = test.join(top_demand_stations(test, n).select("station_id"), "station_id", "left_semi")
    return segment_metrics(best, f"top_{n}_estaciones")


def evaluation_verdict(overall: DataFrame) -> DataFrame:
    """One row: test MAE of both predictors, improvement in percent and who wins."""
    test = overall.filter(F.col("split") == "test").agg(
        F.max(F.when(F.col("modelo") == "linea_base", F.col("mae"))).alias("mae_base"),
        F.max(F.when(F.col("modelo") == "modelo", F.col("mae"))).alias("mae_modelo"),
    )
    base, model = F.col("mae_base"), F.col("mae_modelo")
    gain = F.when(base != 0, F.bround(100 * (base - model) / base, 2)).otherwise(F.lit(0.0))
    return test.select(
        "mae_base",
        "mae_modelo",
        gain.alias("mejora_pct"),
        F.when(model < base, F.lit(MODEL_WINS)).otherwise(F.lit(MODEL_LOSES)).alias("veredicto"),
    )

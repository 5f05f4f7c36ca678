from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from pedalflow.operators import boosting as BO
from pedalflow.operators import forecast as FC
from tests.test_forecast import series

INPUTS = ["a", "b", "c", "d", "e"]


def table(spark, n=4000, seed=1, tasks=3):
    """Labels that follow the features, some of these with few values, one constant."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 24, n), rng.integers(0, 7, n), rng.integers(0, 2, n)
    d = rng.integers(-1, 30, n) / 4
    y = np.sin(a) * 5 + b * c + np.where(d > 3, 9.0, 0.0) + rng.normal(size=n)
    pdf = pd.DataFrame({"a": a * 1.0, "b": b * 1.0, "c": c * 1.0, "d": d, "e": 4.0, "_y": y})
    return spark.createDataFrame(pdf).repartition(tasks, "a", "b").sortWithinPartitions(*INPUTS, "_y")


def estimator(**more):
    return GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="p", maxIter=6, maxDepth=5, stepSize=0.1, seed=7, checkpointInterval=2, **more)


def scored(model, rows):
    return model.transform(VectorAssembler(inputCols=INPUTS, outputCol="_x").transform(rows))


def test_trees_equal_those_of_spark_without_drawing(spark):
    rows = table(spark).persist()
    plain = estimator(subsamplingRate=1.0, featureSubsetStrategy="1.0")
    got = BO.fit(plain, rows, "_y")
    want = plain.copy({plain.featureSubsetStrategy: "all"}).fit(VectorAssembler(inputCols=INPUTS, outputCol="_x").transform(rows))
    pair = scored(got, rows).select(F.monotonically_increasing_id().alias("i"), "p").toPandas()
    other = scored(want, rows).select("p").toPandas()
    np.testing.assert_allclose(pair["p"], other["p"], rtol=1e-6, atol=1e-6)
    assert got.getNumTrees == want.getNumTrees == 6 and list(got.treeWeights) == list(want.treeWeights)
    np.testing.assert_allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-6)


def test_model_does_not_depend_on_the_order_of_sums(spark, monkeypatch):
    rows = table(spark, tasks=6).persist()
    drawing = estimator(subsamplingRate=0.9, featureSubsetStrategy="0.9")
    one = BO.fit(drawing, rows, "_y")
    monkeypatch.setattr(BO, "_MANY_TASKS", 1)
    two = BO.fit(drawing, rows, "_y")
    assert one.toDebugString == two.toDebugString
    e = scored(one, rows).select(F.sqrt(F.avg((F.col("p") - F.col("_y")) ** 2))).first()[0]
    assert e < rows.agg(F.stddev("_y")).first()[0] / 2


def test_model_is_stored_as_one_of_spark(spark, tmp_path):
    rows = table(spark, n=500)
    model = BO.fit(estimator(subsamplingRate=0.9, featureSubsetStrategy="0.9"), rows, "_y")
    model.write().overwrite().save(str(tmp_path / "gbt"))
    loaded = GBTRegressionModel.load(str(tmp_path / "gbt"))
    assert loaded.toDebugString == model.toDebugString.replace("boosted_trees", loaded.uid)
    assert scored(loaded, rows).select("p").collect() == scored(model, rows).select("p").collect()


def test_rounds_take_one_stage_a_level(spark):
    """A round is a pass for each level and one for the next round's first; before, each level shuffled and every round took ten stages."""
    context = spark.sparkContext

    def stages(rounds):
        context.setJobGroup(f"boost{rounds}", "")
        FC.train_model(series(spark), iterations=rounds)
        context.setJobGroup("rest", "")
        tracker = context.statusTracker()
        return sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"boost{rounds}"))

    assert stages(9) - stages(3) <= 6 * 6


def test_cuts_share_the_rows_and_read_them_all(spark):
    few = np.array([0.0, 1.0, 5.0])
    assert BO.thresholds(few, np.array([9.0, 1.0, 2.0])).tolist() == [0.5, 3.0]
    n = 50_000
    x = np.random.default_rng(3).permutation(n).astype(float) ** 2
    rows = spark.createDataFrame(pd.DataFrame({"x": x, "z": np.where(x == x.max(), 1.0, 0.0)})).repartition(4)
    cuts, rare = BO.feature_cuts(rows)
    shares = np.diff(np.searchsorted(np.sort(x), cuts), prepend=0, append=n) / n
    assert len(cuts) == BO.BINS - 1 and abs(shares * BO.BINS - 1).max() < 0.15
    assert rare.tolist() == [0.5]  # one row of 50,000 has another value


def test_features_with_few_bins_share_a_word():
    cuts = [np.arange(n, dtype=float) for n in (31, 1, 0, 6, 3, 31, 15)]
    layout = BO.layout_of(cuts)
    assert max(word for word, _, _ in layout) == 1
    taken = [(word, bit) for word, shift, bits in layout for bit in range(shift, shift + bits)]
    assert len(set(taken)) == len(taken) == 20 and max(bit for _, bit in taken) < 10


def test_labels_must_be_known(spark):
    rows = table(spark, n=50)
    for bad in (rows.limit(0), rows.withColumn("_y", F.when(F.col("a") > 3, F.col("_y"))), rows.withColumn("_y", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            BO.fit(estimator(subsamplingRate=0.9, featureSubsetStrategy="0.9"), bad, "_y")

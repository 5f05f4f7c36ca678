from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedalflow.llm import quality_classifier as c
from pedalflow.llm.text_arrays import LOWER, NOT_NEWLINE, NOT_SPACE, Hasher
from tests.llm.conftest import ODD

def even():
    return F.col("doc_id") % 4 == 0


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(1)
    stock = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    good = lambda: " ".join(rng.choice(stock) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(30, 200)))
    bad = [
        lambda: good().upper().replace(" ", "!! "),
        lambda: " | ".join(good().split()),
        lambda: f"{rng.choice(stock)} " * 80,
        lambda: " ".join(w + "###" for w in good().split()),
    ]
    return [(i, (good if i % 3 else rng.choice(bad))(), "en") for i in range(600)]


def test_held_out_ranking_and_calibration(spark, documents, sample):
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d, *_ in sample], "doc_id long, quality int")
    out = c.classified(documents(sample), labels, F.col("doc_id") % 5 > 0, even()).where("doc_id % 5 = 0").collect()
    good, bad = ([r["score"] for r in out if (r["doc_id"] % 3 > 0) == want] for want in (True, False))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_normal_equations_of_many_partitions_equal_one(spark, documents, sample):
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d, *_ in sample], "doc_id long, label int")
    stats = c.with_statistics(documents(sample).select("doc_id", "text")).join(labels, "doc_id")
    many, one = (c.fit(stats.repartition(n), even()) for n in (7, 1))
    np.testing.assert_allclose(many["weights"], one["weights"], rtol=1e-6, atol=1e-8)


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    d, n = len(c.STATISTICS), 20_000
    model = {"mean": np.zeros(d), "spread": np.ones(d), "directions": rng.normal(size=(d, n)) / 4, "phases": rng.uniform(0, 2 * np.pi, n)}
    x = rng.normal(size=(6, d))
    z = c._features(x, model)[:, 1 + d :]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 16))
    np.testing.assert_allclose(z @ z.T, want, atol=0.04)


def test_pool_adjacent_equals_the_definition():
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=12), rng.uniform(0.5, 3, 12)
    mean = lambda a, b: np.average(v[a:b], weights=w[a:b])
    want = [max(min(mean(a, b) for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]
    np.testing.assert_allclose(c.pool_adjacent(v, w), want)


def test_statistics_do_not_depend_on_neighbours(sample):
    texts = [t.encode() for _, t, _ in sample[:9]] + [b"", "é ñ\n\nx".encode()]
    words, lines = Hasher(NOT_SPACE, LOWER), Hasher(NOT_NEWLINE)
    together = c.statistics(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), words, lines)
    for i, t in enumerate(texts):
        np.testing.assert_allclose(c.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]), words, lines)[0], together[i])


def test_odd_rows_and_missing_labels(spark, documents):
    docs = documents(ODD).selectExpr("*", "'x' AS score", "2 AS stats")
    none = spark.createDataFrame([(0, None), (99, 1)], "doc_id long, quality int")
    out = c.classified(docs, none, F.lit(True), even()).collect()
    assert len(out) == len(ODD) and {r["score"] for r in out} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    assert {r["score"] for r in c.classified(docs, one, F.lit(True), even()).collect()} == {1.0}
    assert c.classified(docs.where("doc_id = -1"), one, F.lit(True), even()).count() == 0

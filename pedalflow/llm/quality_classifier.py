"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every text are computed once and stored. Cosines of random projections of the standardised statistics
approximate a Gaussian kernel; each task sums the normal equations of its labelled rows, Spark adds the sums up, and the
driver solves one system of a fixed size. Calibration is isotonic regression on rows that took no part in the fit,
through a histogram of a fixed number of bins, with straight lines between the steps so that order is kept.

Defined results: a null or empty text has statistics of 0 and a score like any other; labels that are null or belong to
no document are not learned from, a label given twice counts twice; without labels every score is 0.5, with one class only
the score is its rate; rows that repeat are scored alike; an empty table gives an empty table. Input columns named like
a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedalflow.llm.storage import small_batches, stored
from pedalflow.llm.text_arrays import LOWER, NOT_NEWLINE, NOT_SPACE, Hasher, byte_set, chunks, mix, owner, sums_per_text, windows


@dataclass(frozen=True)
class Params:
    """Production parameters: number of features, width of the kernel in standard deviations, ridge penalty per row,
    the score from which on a text is predicted to be good, bins of the calibration, seed of the projections."""

    features: int = 256
    width: float = 4.0
    ridge: float = 1e-4
    cut: float = 0.3
    bins: int = 1000
    seed: int = 7


_CLASSES = {
    "upper": byte_set(bytes(range(65, 91))),
    "digit": byte_set(bytes(range(48, 58))),
    "symbol": byte_set(b"#*$%&|<>"),
    "exclaim": byte_set(b"!?"),
    "stop": byte_set(b"."),
    "comma": byte_set(b",;:"),
    "pipe": byte_set(b"|"),
    "other": byte_set(b"\"'()[]{}=+-_/\\@~^`"),
    "far": byte_set(bytes(range(128, 256))),
}
_ENDS = byte_set(b".!?")
STATISTICS = [
    "log_bytes",
    "log_words",
    "word_length",
    *(f"{c}_share" for c in _CLASSES),
    "capital_words",
    "shouted_words",
    "words_per_stop",
    "log_lines",
    "words_per_line",
    "lines_again",
    "closed_lines",
    "distinct_words",
    "neighbour_repeats",
    "window_repeats",
    "long_words",
    "short_words",
    "top_word",
]


def statistics(data: np.ndarray, offsets: np.ndarray, words_of: Hasher, lines_of: Hasher) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    texts = len(offsets) - 1
    n_bytes = np.diff(offsets)
    hashes, starts, ends, first = words_of(data, offsets)
    n = np.diff(first)
    text = owner(first)
    some, some_bytes = np.maximum(n, 1), np.maximum(n_bytes, 1)
    per_text = lambda flags: np.bincount(text, flags, minlength=texts)
    length = ends - starts
    out = {"log_bytes": np.log1p(n_bytes), "log_words": np.log1p(n), "word_length": per_text(length) / some}
    for name, members in _CLASSES.items():
        out[f"{name}_share"] = sums_per_text(members[data], offsets) / some_bytes
    upper = np.concatenate(([0], np.cumsum(_CLASSES["upper"][data])))
    caps = upper[ends] - upper[starts]
    opens = upper[starts + 1] - upper[starts]
    out["capital_words"] = per_text(opens) / some
    out["shouted_words"] = per_text((caps >= 2) & (caps * 2 >= length)) / some
    out["words_per_stop"] = np.log1p(n / (1 + sums_per_text(_ENDS[data], offsets)))

    lines, line_start, line_end, first_line = lines_of(data, offsets)
    n_lines = np.diff(first_line)
    some_lines = np.maximum(n_lines, 1)
    line_text = owner(first_line)
    out["log_lines"] = np.log1p(n_lines)
    out["words_per_line"] = np.log1p(n / some_lines)
    distinct = lambda keys, of: np.bincount(of[np.unique(mix(keys ^ mix(of.astype(np.uint64))), return_index=True)[1]], minlength=texts)
    out["lines_again"] = 1 - distinct(lines, line_text) / some_lines
    out["closed_lines"] = np.bincount(line_text, _ENDS[data[line_end - 1]], minlength=texts) / some_lines

    own = mix(hashes ^ mix(text.astype(np.uint64)))
    _, at, count = np.unique(own, return_index=True, return_counts=True)
    out["distinct_words"] = np.bincount(text[at], minlength=texts) / some
    out["neighbour_repeats"] = per_text(np.concatenate(([0], own[1:] == own[:-1]))[: len(own)]) / some
    window, where = windows(hashes, first, 5)
    out["window_repeats"] = 1 - (distinct(window, text[where]) + 1) / (np.bincount(text[where], minlength=texts) + 1)
    out["long_words"] = per_text(length > 12) / some
    out["short_words"] = per_text(length <= 3) / some
    top = np.zeros(texts)
    np.maximum.at(top, text[at], count)
    out["top_word"] = top / some
    return np.column_stack([out[name] for name in STATISTICS])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with an array of statistics of the whole text."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("text", "stats")]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, lines_of = Hasher(NOT_SPACE, LOWER), Hasher(NOT_NEWLINE)
        for batch in batches:
            rows = [statistics(data, offsets, words_of, lines_of) for _, data, offsets in chunks(batch.column("text"))]
            flat = np.concatenate(rows).ravel() if rows else np.empty(0)
            bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            stats = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), stats], names=schema.names)

    return docs.select(*kept, "text").mapInArrow(measure, schema)


def _matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))


#: Standardisation, projections, weights and the calibration line by name.
Model = dict[str, np.ndarray]


def _features(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["spread"], -6, 6)
    waves = np.cos(z @ model["directions"] + model["phases"]) * np.sqrt(2 / len(model["phases"]))
    return np.column_stack((np.ones(len(z)), z, waves))


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` by weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(rows: DataFrame, calibrate: Column, params: Params = Params()) -> Model:
    """A model from rows with ``stats`` and ``label`` (0 or 1); rows where ``calibrate`` holds only calibrate it."""
    size = len(STATISTICS)
    rng = np.random.default_rng(params.seed)
    model = {
        "directions": rng.normal(size=(size, params.features)) / params.width,
        "phases": rng.uniform(0, 2 * np.pi, params.features),
        "mean": np.zeros(size),
        "spread": np.ones(size),
    }
    used = rows.select("stats", F.col("label").cast("double").alias("label"), calibrate.alias("calibrate"))
    moments = used.select(*[F.struct(F.avg(F.col("stats")[i]).alias("m"), F.stddev_pop(F.col("stats")[i]).alias("s")).alias(name) for i, name in enumerate(STATISTICS)], F.avg("label").alias("_rate")).first()
    rate = moments["_rate"]
    if rate is None or rate in (0.0, 1.0):
        return {**model, "weights": np.zeros(1 + size + params.features), "raw": np.zeros(1), "calibrated": np.array([0.5 if rate is None else rate])}
    model["mean"] = np.array([moments[c]["m"] for c in STATISTICS])
    model["spread"] = np.array([moments[c]["s"] or 1.0 for c in STATISTICS])
    model["spread"][model["spread"] < 1e-9] = 1.0

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = 1 + size + params.features
        total, right, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            z, y = _features(_matrix(batch), model), batch.column("label").to_numpy()
            total += z.T @ z
            right += z.T @ y
            n += len(y)
        if n:
            sums = np.column_stack((total, right, np.full(d, float(n))))
            values = pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * (d + 2)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), values], names=["row", "sums"])

    parts = used.where(~F.col("calibrate")).mapInArrow(equations, "row int, sums array<double>")
    cells = parts.select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    d = 1 + size + params.features
    table = np.zeros((d, d + 2))
    found = cells.toArrow()
    table[found["row"].to_numpy(), found["col"].to_numpy()] = found["x"].to_numpy()
    penalty = params.ridge * max(table[0, d + 1], 1.0) * np.eye(d)
    penalty[0, 0] = 1e-9
    model["weights"] = np.linalg.solve(table[:, :d] + penalty, table[:, d])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(_features(_matrix(batch), model) @ model["weights"], -0.5, 1.5)
            bin_ = np.minimum(((raw + 0.5) / 2 * params.bins).astype(np.int64), params.bins - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), batch.column("label")], names=["bin", "label"])

    seen = used.where("calibrate").mapInArrow(bins, "bin long, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()
    if not seen:
        return {**model, "raw": np.array([-0.5, 0.0, 1.0, 1.5]), "calibrated": np.array([0.0, 0.0, 1.0, 1.0])}
    centre = np.array([(r["bin"] + 0.5) / params.bins * 2 - 0.5 for r in seen])
    n = np.array([float(r["n"]) for r in seen])
    good = np.array([r["good"] for r in seen])
    steps = pool_adjacent(good / n, n)
    edges = np.flatnonzero(np.concatenate(([True], steps[1:] != steps[:-1])))
    last = np.append(edges[1:], len(steps))
    middle = np.array([np.average(centre[a:b], weights=n[a:b]) for a, b in zip(edges, last, strict=True)])
    model["raw"] = np.concatenate(([min(-0.5, middle[0] - 0.01)], middle, [max(1.5, middle[-1] + 0.01)]))
    model["calibrated"] = np.concatenate(([steps[0] * 0.5], steps[edges], [(1 + steps[-1]) / 2]))
    return model


def scored(rows: DataFrame, model: Model, params: Params = Params()) -> DataFrame:
    """``rows`` (with ``stats``) with ``score`` and ``predicted`` in place of the statistics."""
    kept = [c for c in rows.columns if c.lower() not in ("stats", "score", "predicted")]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _features(_matrix(batch), model) @ model["weights"]
            values = np.interp(raw, model["raw"], model["calibrated"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values)], names=schema.names)

    return rows.select(*kept, "stats").mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= params.cut).cast("int"))


def classified(docs: DataFrame, labels: DataFrame, training: Column, calibrate: Column, params: Params = Params()) -> DataFrame:
    """``docs`` (with ``doc_id``) with score and prediction, learned from its rows that have a label and are ``training``."""
    stats = stored(with_statistics(docs), "statistics")
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).where("label IN (0, 1)")
    known = stats.join(marks, F.col("doc_id") == F.col("_id")).where(training)
    return scored(stats, fit(known, calibrate, params), params)

"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of one to three letters, words padded with a blank on either side, letters in
lower case. Spark counts the n-grams of all training texts; a language's profile is its first ``size`` n-grams by count.
A text is compared with each profile by the out-of-place distance: how far the ranks of its own most frequent n-grams
lie from their ranks in the profile, ``size`` for those that are not in it. The nearest language wins.

Profiles are at most ``size`` rows for each language, which bounds what is broadcast.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text when nothing was
learned; rows without a language are not learned from; equal distances go to the first language by name, equal counts
to the smaller n-gram; rows that repeat are judged alike; an empty table gives an empty table. Input columns named like
a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pedalflow.llm.storage import small_batches
from pedalflow.llm.text_arrays import chunks

SIZE = 300
UNKNOWN = "und"
_BITS = 21
_ABSENT = (1 << _BITS) - 1
_CODE_POINTS = 0x110000


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each text begins."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    except UnicodeDecodeError:  # broken bytes: each text is decoded by itself
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return points, begins


def _letter(point: int) -> int:
    """The lower-case letter of a code point, 0 for anything else."""
    c = chr(point)
    return ord(low) if c.isalpha() and len(low := c.lower()) == 1 else point if c.isalpha() else 0


def grams(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, n-gram and count of all n-grams of the texts, by group and n-gram; ``group`` numbers each text's group."""
    points, begins = _code_points(data, offsets)
    seen = np.zeros(_CODE_POINTS, bool)
    seen[points] = True
    used = np.flatnonzero(seen)
    letters = np.array([_letter(int(p)) for p in used], np.int64)
    alphabet = np.unique(np.append(letters, [0, _ABSENT]))
    table = np.zeros(_CODE_POINTS, np.int32)
    table[used] = np.searchsorted(alphabet, letters)

    texts = len(begins) - 1
    text = np.repeat(np.arange(texts), np.diff(begins))
    codes = np.zeros(len(points) + texts + 1, np.int32)
    codes[np.arange(len(points)) + text + 1] = table[points]
    owner = np.zeros(len(codes), np.int64)
    owner[np.arange(len(points)) + text + 1] = group[text]
    stay = np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))
    codes, owner = codes[stay].astype(np.int64), owner[stay]

    base = len(alphabet)
    absent = base - 1
    one = codes != 0
    a, b = codes[:-1], codes[1:]
    two = (a != 0) | (b != 0)
    x, y, z = codes[:-2], codes[1:-1], codes[2:]
    three = y != 0
    keys = np.concatenate(
        (
            (absent * base + absent) * base + codes[one],
            ((absent * base + a) * base + b)[two],
            ((x * base + y) * base + z)[three],
        )
    )
    whose = np.concatenate((owner[one], np.where(a != 0, owner[:-1], owner[1:])[two], owner[1:-1][three]))
    full = np.sort(whose * base**3 + keys)
    first = np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1]))) if len(full) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(full)))
    keys = full[first]
    wide = (alphabet[keys // base**2 % base] << (2 * _BITS)) | (alphabet[keys // base % base] << _BITS) | alphabet[keys % base]
    return keys // base**3, wide, count


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, codes = np.unique(np.array(batch.column("lang").to_pylist(), dtype=str), return_inverse=True)
        for rows, data, offsets in chunks(batch.column("text")):
            which, gram, n = grams(data, offsets, codes[rows])
            yield pa.RecordBatch.from_arrays([pa.array(names[which].tolist(), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])


def profiles(training: DataFrame, size: int = SIZE) -> DataFrame:
    """lang, gram and rank (from 0) of the most frequent n-grams of each language; needs columns lang and text."""
    small_batches(training.sparkSession)
    rows = training.where("lang IS NOT NULL").select("lang", "text")
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(by_count) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def predicted(docs: DataFrame, known: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: 1 for the ranks of the profile itself, 0 for nothing in common."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = [(r["lang"], r["gram"], r["rank"]) for r in known.collect()]  # at most ``size`` for each language
    names = sorted({lang for lang, _, _ in rows})
    all_grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
    ranks = np.full((len(all_grams) + 1, len(names)), -1, np.int32)
    for lang, gram, rank in rows:
        ranks[np.searchsorted(all_grams, gram), names.index(lang)] = rank
    model = spark.sparkContext.broadcast((names, all_grams, ranks))
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, all_grams, ranks = model.value
        for batch in batches:
            langs, scores = [], []
            for _, data, offsets in chunks(batch.column("text")):
                best, score = nearest(data, offsets, all_grams, ranks, size)
                langs += [names[i] if i >= 0 else UNKNOWN for i in best.tolist()]
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(predict, schema)


def nearest(data: np.ndarray, offsets: np.ndarray, all_grams: np.ndarray, ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its nearest profile, -1 without a letter, and the score."""
    texts = len(offsets) - 1
    text, gram, count = grams(data, offsets, np.arange(texts))
    best, score = np.full(texts, -1), np.zeros(texts)
    if not len(gram) or not ranks.shape[1]:
        return best, score
    # Order by text, count downwards, n-gram: one sort of packed numbers.
    low, mid = int(len(gram)).bit_length(), int(count.max()).bit_length()
    order = np.sort((((text << mid) | (count.max() - count)) << low) | np.arange(len(gram))) & ((1 << low) - 1)
    text, gram = text[order], gram[order]
    begins = np.searchsorted(text, np.arange(texts + 1))
    rank = np.arange(len(gram)) - begins[text]
    top = rank < size
    text, gram, rank = text[top], gram[top], rank[top]
    at = np.minimum(np.searchsorted(all_grams, gram), len(all_grams) - 1)
    at = np.where(all_grams[at] == gram, at, len(all_grams))
    n = np.bincount(text, minlength=texts)
    distance = np.empty((ranks.shape[1], texts))
    for i in range(ranks.shape[1]):
        there = ranks[at, i]
        distance[i] = np.bincount(text, np.where(there < 0, size, np.abs(there - rank)), minlength=texts)
    some = n > 0
    best[some] = np.argmin(distance, axis=0)[some]
    score[some] = 1 - distance.min(axis=0)[some] / (size * n[some])
    return best, score

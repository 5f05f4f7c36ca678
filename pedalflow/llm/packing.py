"""Packing into length buckets: the boundaries that pad least, and batches of a token budget in each bucket.

The lengths of all documents are counted in a histogram of exact lengths; it has at most as many rows as the longest
document has words, however many documents there are. Dynamic programming over it finds the bucket boundaries of least
padding: the cost of a bucket is a Monge array, so the best last boundary moves one way and is found for all lengths by
halving, in m log m steps for m lengths. Inside a bucket documents are numbered in the order of a hash by many tasks, and
every ``budget // boundary`` of them form a batch; a document longer than the budget is a batch by itself.

Words are runs of anything but white space; a null or empty text has none and goes to the first bucket. Rows that repeat
are packed one by one; an empty table gives an empty table. Of the input only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalflow.llm.storage import numbered, stored

BUCKETS = 16
BUDGET = 65_536
_NEVER = 1 << 62
_WORD = r"[^\x20\x09-\x0D]+"


def _least_last(cost: np.ndarray, size: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number j of covered lengths the least cost with one more bucket, and where that bucket begins.

    The beginning never moves back as j grows: all j of one level of halving are looked at together, each between the
    beginnings of its neighbours on the levels before.
    """
    m = len(size)
    best, begin = np.full(m + 1, _NEVER), np.full(m + 1, -1)
    low, high = np.array([least]), np.array([m])  # ranges of j, and of where their bucket may begin
    first, last = np.array([least - 1]), np.array([m - 1])
    while len(low):
        j = (low + high) // 2
        n = np.minimum(last, j - 1) - first + 1
        starts = np.cumsum(n) - n
        i = np.repeat(first - starts, n) + np.arange(n.sum())
        filled = cost[i] + np.repeat(size[j - 1], n) * (np.repeat(total[j], n) - total[i])
        best[j] = np.minimum.reduceat(filled, starts)
        equal = np.flatnonzero(filled == np.repeat(best[j], n))
        begin[j] = i[equal[np.searchsorted(equal, starts)]]
        below, above = low < j, j < high
        low, high, first, last = (
            np.concatenate((low[below], j[above] + 1)),
            np.concatenate((j[below] - 1, high[above])),
            np.concatenate((first[below], begin[j][above])),
            np.concatenate((begin[j][below], last[above])),
        )
    return best, begin


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` of the sorted ``lengths``, the last one among them, that pad the least in total."""
    size = np.array(lengths, np.int64)
    total = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    m = len(size)
    cost = np.full(m + 1, _NEVER)
    cost[0] = 0
    back = []
    for k in range(1, min(buckets, m) + 1):
        cost, begin = _least_last(cost, size, total, k)
        back.append(begin)
    out, j = [], m
    for begin in reversed(back):
        out.append(lengths[j - 1])
        j = int(begin[j])
    return out[::-1]


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch (gapless over all buckets), slot in the batch and padding.

    ``length`` may give another number of tokens than that of the words.
    """
    n = length if length is not None else F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(_WORD))
    rows = stored(docs.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens")), "lengths")
    histogram = rows.groupBy(F.col("n_tokens").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()
    ends = boundaries([r["size"] for r in histogram], [r["n"] for r in histogram], buckets) or [0]
    fits = [max(1, budget // max(end, 1)) for end in ends]
    before, first = [0], -1
    for end, fit in zip(ends, fits, strict=True):
        inside = sum(r["n"] for r in histogram if first < r["size"] <= end)
        before.append(before[-1] - (-inside // fit))
        first = end
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    limits = F.array(*[F.lit(end).cast("long") for end in ends])
    placed = rows.withColumn("bucket", F.size(F.filter(limits, lambda end: end < F.col("n_tokens"))))
    order = numbered(placed, ["bucket"], F.xxhash64("doc_id", "n_tokens"), "place", ["doc_id", "n_tokens"])
    return order.select(
        "doc_id",
        "n_tokens",
        "bucket",
        of(ends).alias("bucket_length"),
        (of(before[:-1]) + F.floor(F.col("place") / of(fits))).cast("long").alias("batch"),
        (F.col("place") % of(fits)).cast("long").alias("slot"),
        (of(ends) - F.col("n_tokens")).alias("padding"),
    )
